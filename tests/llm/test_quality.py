import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import op5_quality as op


def test_trees_against_a_walk_of_each_row():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = op.fit(x, y, trees=40, depth=3)
    for row, s in zip(x[:50], m.score(x[:50]), strict=True):
        raw = m.start
        for t in range(40):
            at = 0
            while at < 7:
                at = 2 * at + 1 + (row[m.feature[t, at]] > m.threshold[t, at])
            raw += m.leaf[t, at - 7]
        assert s == pytest.approx(1 / (1 + np.exp(-raw)))
    assert ((m.score(x) > 0.5) == y).mean() > 0.95
    assert op.fit(x, np.ones(600)).score(x[:3]) == pytest.approx(1, abs=1e-3)
    assert op.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_held_out_rows_are_told_apart(spark, empty):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        good = rng.random() < 0.8
        text = " ".join(("Abc" if good else "AB$$!") + "x" * rng.randrange(6) for _ in range(rng.randrange(5, 60)))
        rows.append((i, text, int(good)))
    rows += [(601, None, 1), (602, "", 1), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = op.train(docs, labels)
    got = docs.select("doc_id", op.scorer(model, F.col("text")).alias("s"), (op.fold(F.col("doc_id")) == 0).alias("held")).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, _, q in rows}
    for r in got:
        assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["s"] <= 1
    held = [r for r in got if r["held"] and r["doc_id"] < 601]
    assert np.mean([(r["s"] >= 0.3) == truth[r["doc_id"]] for r in held]) > 0.97
    kept = op.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert op.keep_good(empty, labels).count() == 0
    assert op.keep_good(docs, labels.limit(0)).count() == len(rows)


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(50)], "doc_id long, quality int")
    assert op.train(docs, labels).start < -5


def test_a_repeated_key_counts_once_in_the_fit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(op, "fit", lambda x, y: seen.append((x.tolist(), y.tolist())))
    rows = [(i, f"text number {i}") for i in range(20)] + [(1, f"again {i % 2}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    for d in (docs, docs.repartition(5)):
        op.train(d, labels)
    assert len(seen[0][0]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20)) and seen[0] == seen[1]
