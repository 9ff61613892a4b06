"""The audit of filters against a walk through every order, document by document."""
import re
from collections import Counter, defaultdict
from itertools import permutations

from cohort_gaps.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """Rows by part, order and step from the definitions alone."""
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, mark in labels if mark == 1 and i is not None}
    parts = defaultdict(list)
    for doc_id, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                 "E": doc_id is not None and first[text] < doc_id}
        parts[source or ""].append((fails, doc_id in good, doc_id in toxic))
    out, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                gone = [r for r in left if r[0][name]]
                left = [r for r in left if not r[0][name]]
                failing = sum(r[0][name] for r in rows)
                alone = sum(r[0][name] and sum(r[0].values()) == 1 for r in rows)
                shapley[part, name] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone,
                                                   sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(spark, docs, labels, extra=False):
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    if extra:
        for name in ("part", "mask", "digest", "n", "good", "copy_of", "words", "step"):
            table, marks = table.selectExpr("*", f"1 AS {name}"), marks.selectExpr("*", f"2 AS {name}")
    rows = filter_audit.audit(table, marks).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost,
                                              r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_of_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    assert result(spark, docs, labels) == brute(docs, labels)


def test_audit_of_odd_rows(spark):
    """Null ids, texts, sources and labels, repeated rows, one part with nearly all rows, a long text, clashing columns."""
    long = " ".join(f"w{i % 700}" for i in range(60_000))
    many = " ".join(f"w{i}" for i in range(60))
    docs = [(1, None, None), (2, "", ""), (3, "", "a"), (3, "", "a"), (None, "", "a"), (None, many, "hot"), (7, long, "hot"),
            (8, many + " #", "hot"), (9, many.upper(), "hot"), (4, "\x0b\x0c\t", "hot"), (5, "é\u00a0ß", "hot")]
    docs += [(100 + i, many, "hot") for i in range(40)] + [(99, many, "cold")]
    labels = [(3, 1, 0), (3, 0, 1), (8, 1, None), (100, None, None), (None, 1, 1), (101, 1, 1), (9, 0, 1)]
    expected = brute(docs, labels)
    assert result(spark, docs, labels) == expected
    assert result(spark, docs, labels, extra=True) == expected
    assert expected["hot", "EABCD", 1][1] == 40


def test_audit_of_nothing(spark):
    assert result(spark, [], [(1, 1, 1)]) == {}
    assert len(result(spark, [(1, "x", "s")], [])) == 600


def test_potentials_give_the_shapley_values(spark):
    """The grand potential less the one without a filter is its mean over all orders; values add up to the grand worth."""
    counts = spark.createDataFrame([("p", m, 1 + 7 * m % 11, 0, 0) for m in range(32)],
                                   "part string, mask int, n long, n_good long, n_toxic long")
    row = filter_audit.coalitions(counts).first()
    values = [row.potential[31] - row.potential[31 - (1 << i)] for i in range(5)]
    assert sum(values) == 120 * row.worth[31]
    means = Counter()
    for order in permutations(range(5)):
        seen = 0
        for i in order:
            means[i] += row.worth[seen | 1 << i] - row.worth[seen]
            seen |= 1 << i
    assert values == [means[i] for i in range(5)]
