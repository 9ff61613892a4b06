"""The trigram model of real code points against dictionaries, whether tasks hold all trigrams or hardly any."""
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohort_gaps.llm import perplexity

PAD = perplexity.PAD


def brute_model(texts):
    """log10 probability of each trigram, by modified Kneser-Ney over the characters of the texts."""
    tri = Counter()
    for text in texts:
        own = [PAD, PAD, *map(ord, text)]
        tri.update(zip(own, own[1:], own[2:]))
    counts = {3: tri, 2: Counter(g[1:] for g in tri)}
    counts[1] = Counter(g[1:] for g in counts[2])
    p = {(): 1 / len(counts[1])}
    for order in (1, 2, 3):
        n = Counter(counts[order].values())
        cut = [0, 0.5, 1.0, 1.5]
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            cut = [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))]
        total, left = Counter(), defaultdict(float)
        for g, c in counts[order].items():
            total[g[:-1]] += c
            left[g[:-1]] += cut[min(c, 3)]
        p.update({g: (c - cut[min(c, 3)]) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p[g[1:] if order > 1 else ()]
                  for g, c in counts[order].items()})
    return p


def brute_ppl(text, p):
    own = [PAD, PAD, *map(ord, text)]
    return -sum(math.log10(p[g]) for g in zip(own, own[1:], own[2:])) / len(text)


@pytest.mark.parametrize("held", [perplexity.HELD, 40, 0])
def test_perplexity_of_real_code_points(spark, held):
    rng = np.random.default_rng(4)
    alphabets = {"el": "αβγδεζηθικλμνξοπρστυφχψω ", "zh": "".join(map(chr, range(0x4E00, 0x4E80))), "xx": "ab \n\té😀"}
    rows = [(i, "".join(rng.choice(list(alphabets[lang]), rng.integers(1, 200))), lang)
            for i, lang in enumerate(list(alphabets) * 20)]
    rows += [(100, "", "el"), (101, None, "el"), (102, "ab", None), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = perplexity.measure(docs, perplexity.model(docs), held).collect()
    assert len(found) == len(rows)
    models = {lang: brute_model([t for _, t, own in rows if t and (own or "") == lang]) for lang in [*alphabets, ""]}
    texts = {i: t for i, t, _ in rows}
    for row in found:
        text = texts[row["doc_id"]]
        if text:
            assert math.isclose(row["log_ppl"], brute_ppl(text, models[row["lang"]]), rel_tol=1e-9)
        else:
            assert row["log_ppl"] is None


def test_characters_31_apart_are_told_apart(spark):
    """Greek texts, and one whose letters are moved by 31 places, where the symbols were the same before."""
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("αβγδεζηθικλμ"), rng.integers(3, 8))) for _ in range(200)]
    plain = [(i, " ".join(rng.choice(vocabulary, 120)), "el") for i in range(200)]
    moved = (1000, "".join(c if c == " " else chr(ord(c) + 31) for c in plain[0][1]), "el")
    docs = spark.createDataFrame([*plain, moved], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in perplexity.report(docs).collect()}
    assert kept[0] and not kept[1000]
