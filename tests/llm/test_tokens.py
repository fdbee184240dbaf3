import public_tokenizers
import pytest
import sentencepiece

from topicloom.llm import common
from topicloom.llm import op6_tokens as op


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def expected(texts, model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return {i: (len((t or "").encode()), len(sp.encode(t)) if t else 0) for i, t in enumerate(texts)}


@pytest.mark.parametrize("most", [2_000_000, 60, 5])
def test_counts_cache_and_ways_to_leave_rows_out(spark, docs, texts, model, tmp_path, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    cache = str(tmp_path / "cache")
    want = expected(texts, model)
    for _ in range(2):
        got = op.count_tokens(docs, cache, model).collect()
        assert len(got) == len(texts) + 1
        assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want
        stored = spark.read.parquet(cache)
        assert stored.count() == len({t or "" for t in texts})  # a row for each text; the second run misses nothing


def test_only_misses_are_added_and_null_keys_count(spark, model, tmp_path, empty):
    cache = str(tmp_path / "cache")
    a = spark.createDataFrame([(1, "<s> one </s>"), (2, "two")], "doc_id long, text string")
    op.count_tokens(a, cache, model).collect()
    b = spark.createDataFrame([(3, "two"), (4, "three"), (None, "four"), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in op.count_tokens(b, cache, model).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert got == {3: len(sp.encode("two")), 4: len(sp.encode("three")), None: len(sp.encode("four")), 5: 0}
    assert spark.read.parquet(cache).count() == 5
    assert op.count_tokens(empty, cache, model).count() == 0


@pytest.mark.parametrize("most", [2_000_000, 3, 0])
def test_null_and_repeated_keys_are_encoded_once(spark, model, tmp_path, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    cache, sp = str(tmp_path / "cache"), sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = [(None, "same words", "x")] * 50 + [(1, "one", "x")] * 20 + [(1, "other text", "x"), (1, None, "x"), (2, "one", "x"), (3, "", "x")]
    for extra, stored in (([], 4), ([(None, "one more", "x")], 5)):
        d = spark.createDataFrame(rows + extra, "doc_id long, text string, h string").repartition(5)
        got = op.count_tokens(d, cache, model).collect()
        assert len(got) == len(rows + extra)
        want = sorted((i is None, i or 0, len(sp.encode(t)) if t else 0) for i, t, _ in rows + extra)
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == want
        assert spark.read.parquet(cache).count() == stored
