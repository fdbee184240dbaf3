import random

import pytest

import corpus_pipeline
from topicloom.llm import near_copies as op


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(rng, base, n):
    out = list(base)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return out


@pytest.fixture(scope="module")
def planted():
    """A base text at an even id, and a near or not so near copy with scattered substitutions at the odd one after it."""
    rng = random.Random(4)
    out = []
    for i in range(240):
        base = [f"t{i}w{j}" for j in range(rng.randrange(100, 500))]
        out += [base, changed(rng, base, max(1, round(len(base) * rng.uniform(0.002, 0.03))))]
    return [" ".join(x) for x in out]


def test_pairs_of_similarity_four_fifths_and_more(spark, planted):
    docs = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").select("doc_id").collect()}
    at = [jaccard(sets(planted[i]), sets(planted[i + 1])) for i in range(0, len(planted), 2)]
    near = [2 * i + 1 for i, x in enumerate(at) if x >= 0.8]
    assert len(near) > 80 and sum(0.7 < x < 0.8 for x in at) > 10 and sum(0.8 <= x < 0.9 for x in at) > 20
    assert sum(i not in kept for i in near) >= 0.98 * len(near)
    assert all(2 * i + 1 in kept for i, x in enumerate(at) if x < 0.8) and all(i in kept for i in range(0, len(planted), 2))


def test_a_repeated_line_does_not_link_texts(spark):
    line = "the same line that stands in all of them again and again "
    rows = [(i, line * 80 + " ".join(f"own{i}x{j}" for j in range(100))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert corpus_pipeline.one_of_each(spark, docs, "").count() == 20


@pytest.mark.parametrize("limit", [16, 2])
def test_large_buckets_against_brute_force(spark, monkeypatch, limit):
    """Chains of texts, each similar to the next alone; with limit 2 in rounds."""
    monkeypatch.setattr(op, "ALL", limit)
    rng = random.Random(9)
    texts = [None, "", " \n", "One", "one", "one two"]
    for c in range(4):
        base = [f"c{c}w{j}" for j in range(200)]
        for _ in range(12):
            base = changed(rng, base, rng.randrange(1, 6))
            texts.append(" ".join(base))
    own = list(map(sets, texts))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(own[i], own[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = op.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(root))


def test_a_bucket_of_near_copies_and_a_common_passage(spark):
    """One bucket holds copies with few and with many changes of two bases, cut-off copies and texts that only share a passage; its links are those of all pairs."""
    rng = random.Random(12)
    bases = [[f"b{c}w{j}" for j in range(120)] for c in range(2)]
    made = [changed(rng, b, n) for b in bases for n in [0, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5, 6]]
    made += [b[: rng.randrange(85, 120)] for b in bases for _ in range(6)]
    made += [bases[0][:70] + [f"own{i}x{j}" for j in range(rng.randrange(5, 40))] for i in range(20)]
    texts = [[w.encode() for w in x] for x in made]
    own = {op.print_of(w) - 2**63: op.shingles(w) for w in texts}
    of = sorted(own)
    root = {x: x for x in of}
    for x in of:
        for y in of:
            if x < y and op.similar(own[x], own[y]) and root[x] != root[y]:
                a, b = sorted((root[x], root[y]))
                root = {k: a if r == b else r for k, r in root.items()}
    members = spark.createDataFrame([(1, x, len(of), of[0]) for x in of], "bucket long, fp long, n long, centre long")
    sets = spark.createDataFrame([(x, own[x].tobytes()) for x in of], "fp long, own binary")
    got = {r["node"]: r["root"] for r in op.groups(members, sets).collect()}
    assert 2 < len(set(root.values())) < len(of) - 20
    assert {x: got.get(x, x) for x in of} == root
