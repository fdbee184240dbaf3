import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from topicloom.llm import op1_simhash as op
from topicloom.llm import components, near_copies
from topicloom.llm.components import connected_components


def brute(text, k=4):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def reach(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_whole_result_against_brute_force(spark, docs, texts):
    got = {r["doc_id"]: r for r in op.near_duplicates(docs).collect()}
    fps = {i: brute(t) for i, t in enumerate(texts)}
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == fps
    pairs = [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 4]
    assert {i: r["component_id"] for i, r in got.items()} == reach(pairs, fps)
    assert op.near_duplicates(docs).count() == len(texts) + 1


def test_keep_one(spark, docs, empty):
    found = op.near_duplicates(docs)
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in found.select("component_id").distinct().collect())
    assert op.keep_one(empty).count() == 0


def test_rows_without_a_key_and_repeated_keys(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (None, a), (None, b), (None, b), (None, f"{b}\n"), (3, c), (5, c), (None, None)]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string").repartition(3)
    for seed in range(3):
        kept = op.keep_one(d.orderBy(F.rand(seed)))
        assert kept.columns == d.columns
        got = sorted((str(r["doc_id"]), (r["text"] or "").strip()) for r in kept.collect())
        assert got == sorted([("3", c), ("5", a), ("None", b), ("None", "")])


def test_unlike_texts_of_one_key_both_stay(spark):
    """Whatever the order of rows: groups are decided by text, and each keeps the row of its least key, then digest."""
    def three(case):
        t, u = (" ".join(f"{case}{x}{i}" for i in range(200)) for x in "tu")
        return t, u, " ".join([*t.split()[:-1], "other"])

    rows, want = [], []
    t, u, near = three("a")
    rows, want = [(3, t), (5, u), (5, near)], [(3, t), (5, u)]
    t, u, near = three("b")
    rows, want = [*rows, (7, t), (7, u)], [*want, (7, t), (7, u)]
    t, u, near = three("c")
    rows, want = [*rows, (10, t), (10, t), (11, t)], [*want, (10, t)]
    t, u, near = three("d")
    rows, want = [*rows, (12, near), (12, t), (None, t)], [*want, (12, min((t, near), key=lambda x: hashlib.sha256(x.encode()).hexdigest()))]
    for order in (rows, rows[::-1], random.Random(1).sample(rows, len(rows))):
        d = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = op.keep_one(d, groups=near_copies.near_copies, prints=near_copies.prints).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_anchors_meet_for_every_pair_within_the_threshold(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(32)
        b = a
        for bit in rng.sample(range(32), rng.randrange(3)):
            b ^= 1 << bit
        rows.append((a, b))
    met = spark.createDataFrame(rows, "a long, b long").select(F.arrays_overlap(op.anchors(F.col("a"), 2), op.anchors(F.col("b"), 2)).alias("x"))
    assert met.where("not x").count() == 0
    assert {len(x) for x in op.flips(2)} == {2, 17}


def test_links_of_clusters_and_of_large_anchors(spark, monkeypatch):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for c in list(fps)[:5]:
        for _ in range(60):
            x = c
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    nodes = [int(np.uint64(x).view(np.int64)) for x in fps]
    expected = reach([(a, b) for a in nodes for b in nodes if a < b and ((a ^ b) % 2**64).bit_count() <= 4], nodes)
    table = spark.createDataFrame([(x,) for x in nodes], "fp long")
    for rows, block in ((1024, 512), (6, 4)):
        monkeypatch.setattr(op, "ANCHOR_ROWS", rows)
        monkeypatch.setattr(op, "BLOCK_ROWS", block)
        roots = {r["node"]: r["root"] for r in connected_components(op.links(table)).collect()}
        assert {n: roots.get(n, n) for n in nodes} == expected


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_of_a_long_path(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    assert {r["node"]: r["root"] for r in connected_components(path).collect()} == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert connected_components(path.limit(0)).count() == 0


def test_components_of_hubs(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(i, hub) for hub in (1000, 7, 2000) for i in range(hub + 1, hub + 300)] + [(1100, 50), (5000, 5001)]
    edges += [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(300)]
    nodes = sorted({x for e in edges for x in e})
    expected = reach([e for e in edges if e[0] != e[1]], nodes)
    table = spark.createDataFrame(edges, "u long, v long")
    for few, least in ((0, 1), (0, 20), (0, 10_000), (100_000, 1)):
        monkeypatch.setattr(components, "FEW", few)
        monkeypatch.setattr(components, "HUB_EDGES", least)
        roots = {r["node"]: r["root"] for r in connected_components(table).collect()}
        assert {n: roots.get(n, n) for n in nodes} == expected
