import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from topicloom.llm import op7_lm as op


def toks(t):
    return [*(t or "").encode().lower().split(), b""]


def test_base_scores_against_brute_force(spark, docs, texts, empty):
    learn = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    if zlib.crc32(b"10") % 7 != 2:
        learn.append(texts[10])
    c = Counter(w for t in learn for w in toks(t))
    n, v = sum(c.values()), len(c)
    for frequent in (100_000, 20):
        got = op.score(docs, frequent=frequent, steps=50).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            own = toks(texts[r["doc_id"]])
            assert r["score"] < 0 and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in c for w in own), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
    assert op.score(empty, steps=5).count() == 0


def plain_score(fitted, text):
    """The model's log10 probability of a text, token by token."""
    m, c = fitted.model, {r["word"].encode(): r["n"] for r in fitted.words.collect()}
    slot = lambda w: op.TAILS + fitted.own.index(w) if w in fitted.own else op.tail_of(w)
    tails = [w for w in c if w and w not in fitted.own]
    one = two = 0
    out = 0.0
    for w in toks(text):
        raw = [m.context[0][one] @ m.target[0][s] + m.bias[0][s] + m.context[1][two] @ m.target[1][s] + m.bias[1][s] for s in range(len(m.bias[0]))]
        s = slot(w)
        out += (raw[s] - math.log(sum(map(math.exp, raw)))) / math.log(10)
        if 0 < s < op.TAILS:
            mates = [x for x in tails if op.tail_of(x) == s]
            out += math.log10((c.get(w, 0) + 1) / (sum(c[x] for x in mates) + len(mates) + 1))
        one, two = s, one
    return out


@pytest.mark.parametrize("frequent", [100_000, 12])
def test_scores_against_a_plain_loop(spark, monkeypatch, frequent):
    monkeypatch.setattr(op, "OWN", 10)
    monkeypatch.setattr(op, "SLOTS", op.TAILS + 10)
    rng = random.Random(3)
    some = [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 3) for _ in range(rng.randrange(30))) for _ in range(60)] + [None, ""]
    known = spark.createDataFrame([(t,) for t in some], "text string").selectExpr("cast(text as binary) as text")
    fitted = op.fit(known, frequent, steps=40)
    assert len(fitted.own) == 10
    new = [*some[:5], None, "", "a zz new new2 b", "Q a a"]
    docs = spark.createDataFrame([(None if i % 4 == 3 else i, t) for i, t in enumerate(new)] + [(0, new[0])], "doc_id long, text string").coalesce(1)
    got = op.apply(docs, fitted).collect()
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(plain_score(fitted, t) for t in [*new, new[0]]), rel=1e-4)


def test_probabilities_are_normalised_and_learned(spark):
    rng = random.Random(6)
    langs = [[f"{a}{i}" for i in range(30)] for a in ("aa", "bb", "cc")]
    rows = [(i, " ".join(rng.choice(langs[i % 3]) for _ in range(40))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op.score(docs).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 5 * len(held)
    m = op.train(np.random.default_rng(1).integers(0, 50, (2, 40, 40)), steps=20)
    one, two, whole = m.tables()
    p = np.exp(one[:, None, :] + two[None, :, :] - whole[:, :, None])
    assert p.sum(axis=2) == pytest.approx(1, abs=1e-4)


def test_the_second_position_adds_what_the_first_cannot_know():
    """Each token repeats the one two places before it, which the one before doesn't tell."""
    rng = np.random.default_rng(2)
    pairs, n = np.zeros((2, 6, 6)), 4000
    for _ in range(n):
        a, b = rng.integers(1, 6, 2)
        text = [a, b] * 5 + [0]
        one, two = op.contexts(np.array(text))
        np.add.at(pairs[0], (one, text), 1)
        np.add.at(pairs[1], (two, text), 1)
    one, two, whole = op.train(pairs).tables()
    guess = np.exp(one[2] + two[4] - whole[2, 4])
    assert guess.argmax() == 4 and guess[4] > 0.5


def test_contexts_stop_at_ends():
    one, two = op.contexts(np.array([5, 6, 7, 0, 8, 9, 0]))
    assert list(zip(two, one)) == [(0, 0), (0, 5), (5, 6), (6, 7), (0, 0), (0, 8), (8, 9)]


def test_counts_are_passed_on_when_there_are_many_words(spark, monkeypatch):
    monkeypatch.setattr(op, "FLUSH", 3)
    docs = spark.createDataFrame([("a b c d",), ("a x y z q",)], "text string").selectExpr("cast(text as binary) text")
    got = {r["word"]: r["n"] for r in op.count_words(docs).collect()}
    assert got == {"a": 2, "b": 1, "c": 1, "d": 1, "x": 1, "y": 1, "z": 1, "q": 1, "": 2}
    pairs = {r["cell"]: r["n"] for r in op.count_pairs(docs, [b"a"]).collect()}
    assert sum(n for c, n in pairs.items() if c < op.SLOTS**2) == sum(n for c, n in pairs.items() if c >= op.SLOTS**2) == 11
    assert pairs[op.TAILS] == 2  # "a" begins both texts


def test_each_step_learns_from_all_pairs():
    """Of a million pairs that come once each, one cell more or less changes what is learned."""
    pairs = np.ones((2, op.SLOTS, op.SLOTS))
    models = []
    for extra in (0, 5):
        pairs[:, 700, 800] = 1 + extra
        models.append(op.train(pairs, steps=2))
    assert np.abs(models[0].target - models[1].target)[:, 800].max() > 0
