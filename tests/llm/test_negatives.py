import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import op12_negatives as op

SCHEMA = "vec_id long, embedding array<float>, label int, row string"


def expected(rows, positives=5, negatives=3):
    """The contract, row by row."""
    sound = []
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in sound:
        if i % 50:
            continue
        scored = sorted((-dot(v, w), j, m) for j, m, w in sound)
        for ps, p, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            fit = [x for x in scored if x[2] != label and 50 * -ps <= 100 * -x[0] <= 95 * -ps][:negatives]
            out += [(i, p, k, j, -ps, -s) for k, (s, j, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in op.hard_negatives(d, F.col("vec_id") % 50 == 0, moved, **kw).collect())


def some_rows(n, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(9, dim))
    rows = [(i, [float(np.float32(x)) for x in (middle[i % 9] + rng.normal(size=dim) * 0.4)], int(rng.integers(4)), "r") for i in range(n)]
    odd = [(1000, None, 1), (1050, [float("nan")] * dim, 1), (1051, [float("inf")] * dim, 1), (1052, [None] * dim, 1), (1053, [0.0] * dim, 1), (1100, [0.0] * dim, 2), (1101, [], 2), (1150, [1.0], 1), (1102, [0.5] * dim, None), (None, [0.5] * dim, 1), (1200, [-1.0] * dim, 9), (1250, [5.0] * dim, 8)]
    return rows + [(*r, "r") for r in odd]


@pytest.mark.parametrize("sizes", [{}, {"cell": 4, "part": 20}])
def test_against_every_pair(spark, monkeypatch, sizes):
    monkeypatch.setattr(op, "CHUNK", 7)
    rows = some_rows(600)
    assert mined(spark, rows, **sizes) == expected(rows)


def test_ties_copies_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 16)
    rng = random.Random(3)
    rows = [(i, [1.0, 1.0, 0.5] if i % 3 == 0 else [rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(3)], rng.randrange(3), "r") for i in range(500)]
    rows += [rows[50], rows[50], rows[51], (51, [0.5, 0.5, 0.5], 2, "r")]
    assert mined(spark, rows, cell=3, part=50) == expected(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1, "r")]) == [] and mined(spark, [(50, [1.0], 1, "r")]) == []


def test_walks_stop_early_and_large_integers(spark):
    rng = np.random.default_rng(5)
    part = {"vector": np.vstack([rng.integers(200, 260, (50, 4)), rng.integers(-9, 9, (5000, 4))]), "id": np.arange(5050), "label": np.zeros(5050, np.int64)}
    members = {"vector": part["vector"][:8], "id": np.arange(8), "label": np.zeros(8, np.int64), "cluster": np.zeros(8, np.int64)}
    walk = op.Walk(members, part, np.full((8, 1), -(2**62)), np.full((8, 1), 2**62), True, 5)
    seen = []
    chunk, walk.chunk = walk.chunk, lambda own, these: (seen.append(len(these)), chunk(own, these))
    found = walk.run()
    assert len(seen) == 1 and len(found[0]) == 40  # the certified end comes in the first chunk
    big = 2.0**20
    rows = [(50, [big, 1.0], 1, "r"), (51, [big, 1.0], 1, "r"), (52, [big * 0.75, 1.0], 2, "r"), (53, [big * 0.75, 2.0], 2, "r")]
    assert mined(spark, rows) == expected(rows) != []
    with pytest.raises(OverflowError):
        op.products(np.full((1, 4), 2**31), np.full((1, 4), 2**31))
