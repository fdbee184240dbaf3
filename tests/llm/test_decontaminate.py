import random
import re

import pytest

from topicloom.llm import op2_decontaminate as op


def split(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["The", "a", "ßx", "É", "cat", "dog9", "run", "z", "q", "k"]) + rng.choice(["", ",", ".", "!"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(12)] + [(90, None), (91, ""), (None, text(12)), (92, "?!")]
    items.append(items[3])
    docs = [(i, text(rng.randrange(60))) for i in range(20)]
    docs += [(100 + i, f"{text(8)} {t or ''} {text(5)}") for i, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (200, None), (203, " ".join(t or "" for _, t in items))]
    return docs, items


@pytest.mark.parametrize("seed, block, passes", [(1, op.BLOCK_SHINGLES, op.PASSES), (2, 40, 1000), (2, 40, 1), (4, 1, 0)])
def test_against_brute_force(spark, seed, block, passes, monkeypatch):
    """In one pass, in many, and by the shuffle."""
    docs, items = case(seed)
    monkeypatch.setattr(op, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(op, "PASSES", passes)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, win string, row int").repartition(3)
    i = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in op.contamination(d, i).collect()), key=str)
    assert got == brute(docs, items)
    kept = op.remove_contaminated(d, i)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(x[0] for x in brute(docs, items) if not x[2])


def test_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert op.contamination(docs, items).where("n_hit > 0 or n_items > 0").count() == 0
    assert op.contamination(empty, items).count() == 0


def test_rows_without_a_key(spark):
    docs, items = case(3)
    rows = [(None if n % 2 else i, t, "d") for n, (i, t) in enumerate(docs)] + [(None, None, "d"), (None, docs[1][1], "d")]
    d = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    numbered = [(n, r[1]) for n, r in enumerate(rows)]
    hits = {n: n_hit > 0 for n, _, n_hit, _ in brute(numbered, items)}
    hit = {text: hits[n] for n, text in numbered}
    kept = op.remove_contaminated(d, i)
    assert kept.columns == d.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in d.collect() if not hit[r["text"]])
