"""The pipeline's near duplicates come through op1's anchor points; buckets only follow them."""

import random

import numpy as np

import corpus_pipeline
from topicloom.llm import near_copies as op
from topicloom.llm import op1_simhash


def changed(rng, base, n):
    out = list(base)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return out


def bits(own, word):
    """A fingerprint, bit by bit."""
    hs = [int(op._mix(np.array([x]) * op._TURNS[word])[0]) for x in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def made():
    rng = random.Random(21)
    out = []
    for i in range(40):
        base = [f"t{i}w{j}" for j in range(200)]
        out += [" ".join(base), " ".join(changed(rng, base, 1 + i % 8))]
    return out


def test_the_stage_takes_its_groups_from_anchors(spark, monkeypatch):
    """Without buckets, texts with one or two of 200 words changed are still told from all others, and nothing else is linked."""
    calls = []
    links = op1_simhash.links
    monkeypatch.setattr(op, "links", lambda *a: calls.append(a) or links(*a))
    monkeypatch.setattr(op, "groups", lambda members, sets, roots: roots)
    texts = [*made(), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").select("doc_id").collect()}
    assert len(calls) == op.WORDS
    assert kept >= set(range(0, 81, 2)) and 81 not in kept
    assert not any(2 * i + 1 in kept for i in range(40) if i % 8 < 2)


def test_anchored_pairs_against_all_pairs(spark):
    """Every pair with at most HALF bits apart in a half and BITS in a fingerprint is among the pairs, or linked through others; no pair differs in more."""
    texts = made()
    own = {i: op.shingles(t.encode().split()) for i, t in enumerate(texts)} | {100 + i: op.shingles(texts[0].encode().split()) for i in range(3)}
    sims = {i: op.fingerprints(x) for i, x in own.items()}
    assert all(int(sims[i][w]) == bits(own[i], w) for i in (0, 1, 15, 79) for w in range(op.WORDS))
    rows = [(i, x.view(np.int64).tolist()) for i, x in sims.items()] + [(200, [])]
    got = {(r["u"], r["v"]) for r in op.anchored(spark.createDataFrame(rows, "fp long, sims array<long>")).collect()}
    near = lambda x: x.bit_count() <= op.BITS and min((x & 0xFFFFFFFF).bit_count(), (x >> 32).bit_count()) <= op.HALF
    apart = lambda i, j: [int(a) ^ int(b) for a, b in zip(sims[i], sims[j], strict=True)]
    want = {(i, j) for i in sims for j in sims if i > j and any(map(near, apart(i, j)))}
    root = {i: i for i in sims}
    for u, v in got:
        a, b = sorted((root[u], root[v]))
        root = {k: a if r == b else r for k, r in root.items()}
    assert len(want) > 20 and all(root[i] == root[j] for i, j in want)
    assert all(any(x.bit_count() <= op.BITS for x in apart(u, v)) for u, v in got if u < 100)
