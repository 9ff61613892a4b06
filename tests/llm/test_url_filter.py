"""URL rules against brute force: fixed rules, mined token sets, the index."""
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cohort_gaps.llm import url_filter as uf


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return host, path


def brute_rule(host, path, rules=uf.RULES):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


ODD = [None, "", "no scheme", "http://", "http://A.B.Example.NET/en/x?y=1#z", "http://example.net", "https://net/",
       "https://net?x", "ftp://x.net/en/", "http://example.net/en", "http://notexample.net/en/", "a://b://c.org/fr/",
       "http://x.org/fr/1", "http://example.com/de/..", "http://\u0130.com/de/", "http://a\nb.net/\n?q\n#f\n", "http://x.net//",
       "http://EXAMPLE.com:80/de/", "http://u@example.com/de/1", "http://org/fr/", "http://.net/", "x://y.net/" + "a/" * 20_000]


def table(spark, rows, kind="page_id long, url string, html string"):
    return spark.createDataFrame(rows, kind)


def none(spark):
    return uf.mine_rules(table(spark, [], "url string, is_bad boolean"))


def test_hosts_paths_and_fixed_rules(spark, sf_dir):
    known = [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows = [(i if i % 5 else None, url, None) for i, url in enumerate(ODD + known + ODD[:6])]
    pages = table(spark, rows)
    for name in ("host", "rule", "verdict", "tokens", "token", "mined", "rule_host", "best"):
        pages = pages.withColumn(name, F.lit("clash"))
    fixed = spark.createDataFrame(list(uf.RULES), "verdict string, host string, path string")
    out = [tuple(r) for r in uf.judge(pages, none(spark), fixed).collect()]
    expected = []
    for i, url, _ in rows:
        host, path = brute_host_path(url)
        rule, verdict = brute_rule(host, path)
        expected.append((i, host, path, rule, verdict or "allow", None))
    assert sorted(out, key=str) == sorted(expected, key=str)


def test_longest_rule_wins_and_block_breaks_ties(spark):
    rules = [("allow", "a.b", "/"), ("block", "b", "/xx"), ("allow", "b", "/xxy"), ("block", "b", "/xxy"), ("allow", "c.a.b", "")]
    fixed = spark.createDataFrame(rules, "verdict string, host string, path string")
    urls = ["u://a.b/", "u://a.b/xx", "u://b/xxyz", "u://z.c.a.b/", "u://c.a.b", "u://q"]
    out = {r.url: (r.rule, r.verdict) for r in uf.match_fixed(table(spark, [(u,) for u in urls], "url string"), fixed).collect()}
    assert out == {u: brute_rule(*brute_host_path(u), rules=rules) for u in urls[:-1]}


@pytest.fixture(scope="module")
def labelled(spark):
    """URLs of many hosts; some tokens, and one pair of tokens that are harmless alone, call for a block."""
    rnd = random.Random(2)
    rows = []
    for _ in range(900):
        host = rnd.choice(["news", "shop", "casino-win", "wiki", "free-bets"])
        section, query = rnd.choice(["en", "de", "live"]), rnd.choice(["", "?ref=ad", "?page=2"])
        bad = "casino" in host or (section == "live" and query == "?ref=ad")
        bad = bad if rnd.random() < 0.98 else not bad
        rows.append((f"http://{host}.example.com/{section}/{rnd.randint(1, 9999)}{query}", bad))
    return rows + [(None, True), ("http://x.example.com/", None), ("plain", True)]


def brute_rules(tokens, least, low):
    """Frequent token sets that are sure, by counting every set of every row."""
    counts, bad, present = {}, {}, {}
    for row, (own, is_bad) in enumerate(tokens):
        for token in own:
            present.setdefault(token, set()).add(row)
    keep, seen = set(), {}
    for token, rows in sorted(present.items(), key=lambda x: (-len(x[0]), x[0]), reverse=False):
        if len(rows) < len(tokens) and frozenset(rows) not in seen:
            seen[frozenset(rows)] = token
            keep.add(token)
    for own, is_bad in tokens:
        own = sorted(set(own) & keep)
        for size in range(1, len(own) + 1):
            for part in combinations(own, size):
                counts[part] = counts.get(part, 0) + 1
                bad[part] = bad.get(part, 0) + is_bad

    def sure(n, hits):
        z2, share = 9.0, hits / n
        return (share + z2 / (2 * n) - 3 * ((share * (1 - share) + z2 / (4 * n)) / n) ** 0.5) / (1 + z2 / n) >= low

    good = {p for p, n in counts.items() if n >= least and bad[p] >= least and sure(n, bad[p])}
    return {p: (counts[p], bad[p]) for p in good
            if not any(tuple(x for x in p if x != out) in good for out in p)}


def test_mined_rules_against_all_sets(spark, labelled):
    frame = table(spark, labelled, "url string, is_bad boolean")
    rules = {tuple(r.tokens): r for r in uf.mine_rules(frame, min_support=0.02).collect()}
    known = [(r.tokens, r.is_bad) for r in frame.filter("url IS NOT NULL AND is_bad IS NOT NULL").select(
        uf.tokens_of("url").alias("tokens"), "is_bad").collect() if r.tokens]
    expected = brute_rules(known, -(-len(known) // 50), 0.5)
    assert {k: (r.n, r.n_block) for k, r in rules.items()} == expected
    assert any("casino" in " ".join(k) for k in rules)
    assert any("live" in " ".join(k) and "ad" in " ".join(k) for k in rules)
    assert all(r.anchor in r.tokens and r.confidence == r.n_block / r.n for r in rules.values())


def test_index_matches_what_all_rules_match(spark, labelled):
    frame = table(spark, labelled, "url string, is_bad boolean")
    rules = uf.mine_rules(frame, min_support=0.02)
    urls = frame.select("url").filter("url IS NOT NULL").distinct()
    mined = {r.url: r.mined for r in uf.match_rules(urls, rules).collect()}
    sets = [(-r.confidence, r.rule, set(r.tokens)) for r in rules.collect()]
    for r in urls.select("url", uf.tokens_of("url").alias("tokens")).collect():
        fits = [s[:2] for s in sets if s[2] <= set(r.tokens)]
        assert mined.get(r.url) == (min(fits)[1] if fits else None)
    assert mined


def test_the_rule_list_comes_before_mined_rules(spark, labelled):
    rules = uf.mine_rules(table(spark, labelled, "url string, is_bad boolean"))
    fixed = spark.createDataFrame(list(uf.RULES), "verdict string, host string, path string")
    pages = table(spark, [(1, "http://casino-win.example.com/en/5", ""), (2, "http://casino-win.example.net/en/5", ""),
                          (3, "http://news.example.com/en/5", ""), (4, None, None)])
    out = {r.page_id: (r.rule, r.verdict) for r in uf.judge(pages, rules, fixed).collect()}
    assert out == {1: (None, "block"), 2: ("example.net/en/", "allow"), 3: (None, "allow"), 4: (None, "allow")}


def test_labels_come_from_the_documents_shown(spark):
    text = "A heading of some length & more than sixty characters of text in all, so it is cut."
    docs = spark.createDataFrame([(1, text), (2, text.replace(" so", "\nso")), (3, "short"), (4, None)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    html = f"<h1>{text[:60].replace('&', '&amp;')}</h1>"
    pages = table(spark, [(1, "u://a/", html), (2, "u://b/", "<h1>short</h1>"), (3, "u://c/", None)])
    assert [tuple(r) for r in uf.labelled_pages(pages, docs, labels).collect()] == [("u://a/", True)]


def test_no_labels_no_rules(spark):
    assert none(spark).count() == 0
    assert uf.report(table(spark, []), spark.createDataFrame([], "doc_id long, text string"),
                     spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
