"""Words and hashes of byte arrays, unit-wise tokens, and the pipeline."""
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from cohort_gaps.llm import text, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SAMPLE = st.lists(st.one_of(st.none(), st.text(alphabet="ab é🙂\n\t\x0b .'<|endoftext|>Z1", max_size=30)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(SAMPLE)
def test_words_are_those_of_the_pattern(texts):
    seen = 0
    for row, data, offsets in text.slices(pa.array(texts, pa.string())):
        found = text.words(data, offsets)
        hashes = found.hashes()
        for i in range(len(offsets) - 1):
            own = WORD.findall(texts[row + i] or "")
            a, b = found.per_text[i], found.per_text[i + 1]
            assert [bytes(data[s:e]).decode() for s, e in zip(found.starts[a:b], found.ends[a:b])] == own
            assert all((own[x] == own[y]) == (hashes[a + x] == hashes[a + y]) for x in range(len(own)) for y in range(x))
            seen += 1
    assert seen == len(texts)


def test_slices_take_whole_texts(monkeypatch):
    monkeypatch.setattr(text, "SLICE_BYTES", 10)
    column = pa.chunked_array([pa.array(["a" * 25, "", "bb"]).slice(1), pa.array(["c" * 9, "dd", None, "e" * 40])])
    found = [bytes(data[a:b]).decode() for _, data, offsets in text.slices(column) for a, b in zip(offsets, offsets[1:])]
    assert found == ["", "bb", "c" * 9, "dd", "", "e" * 40]
    assert [row for row, _, _ in text.slices(column)] == sorted({row for row, _, _ in text.slices(column)})


def test_previous_stays_inside_a_text():
    values, per_text = np.arange(1, 8), np.array([0, 3, 3, 4, 7])
    assert text.previous(values, per_text, 1).tolist() == [0, 1, 2, 0, 0, 5, 6]
    assert text.previous(values, per_text, 2, 9).tolist() == [9, 9, 1, 9, 9, 9, 5]


@settings(max_examples=150, deadline=None)
@given(SAMPLE)
def test_units_give_the_library_ids(texts):
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        whole = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts] if len(texts) < 3 else [
            tokens.tokenizer(path).encode(t or "", add_special_tokens=False).ids for t in texts]
        if name.startswith("byte"):
            assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode_ids(path, texts)] == whole
        else:
            assert tokens.count_tokens(path, texts) == [len(x) for x in whole]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    from cohort_gaps.session import cut_lineage

    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        out.append(docs)
    return out


def test_pipeline_stages(spark, stages, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert all(s.dtypes == docs.dtypes for s in stages[:-1])
    counts = [docs.count(), *[s.count() for s in stages[:-1]]]
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4] > 0
    lines = [x.strip() for r in stages[1].collect() for x in r["text"].split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())
    packed = stages[4].select("doc_id").distinct().count()
    assert packed == counts[4]


def test_pipeline_run_has_the_rows_of_its_stages(spark, stages, sf_dir):
    columns = ["doc_id", "start", "length", "ids"]
    rows = corpus_pipeline.run(spark, sf_dir).select(columns).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, stages[4].select(columns).collect()))


def test_pipeline_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
        if "text" not in docs.columns:
            break


def test_a_unit_is_looked_up_once_however_often_it_stands_in_a_portion(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    asked, look_up = [], tokens.Units.look_up
    monkeypatch.setattr(tokens.Units, "look_up", lambda self, wanted: asked.extend(wanted) or look_up(self, wanted))
    texts = ["alpha beta, gamma. " * 500 + "end", None, "", " beta  gamma ", "one.\nTwo alpha\n\nbeta é.\nÉta <|endoftext|>"] * 3
    ids = tokens.encode_ids(path, texts)
    whole = [tokens.tokenizer(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == whole
    assert len(asked) < 100
