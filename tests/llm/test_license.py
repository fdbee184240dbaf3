import math
import random
import re

import pytest

from topicloom.llm import op10_license as op


def split(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_base_against_brute_force(spark, docs, texts, empty):
    rng = random.Random(8)
    own = [None, "", "MIT-License MIT license; mit\nLICENSE", "general public public license", "General Public License general public license", "mit licenses", "the apache. license mit license"]
    for _ in range(60):
        own.append(" ".join(rng.choice(["mit", "License", "general", "public", "Apache", "x", "the"]) for _ in range(rng.randrange(40))))
    d = spark.createDataFrame([(i, t, "w") for i, t in enumerate(own)] + [(2, own[2], "w")], "doc_id long, text string, word string")
    got = op.scan(d).collect()
    assert len(got) == len(own) + 1
    for r in got:
        w = split(own[r["doc_id"]])
        places = [(i, label) for p, label in op.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["places"], r["base_labels"]) == (len(w), len(places), sorted({x for _, x in places}))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1
    assert op.scan(docs).where("places > 0").count() == 0
    assert op.scan(empty).count() == 0


@pytest.mark.parametrize("name", sorted(op.TEMPLATES))
def test_templates_are_found_at_their_place(spark, name):
    filler = " ".join(f"word{i}" for i in range(50))
    rows = [(1, f"{filler} {op.TEMPLATES[name]} {filler}"), (2, filler), (3, " ".join(sorted(op.TEMPLATES[name].split())))]
    got = {r["doc_id"]: r for r in op.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert name in got[1]["labels"] and got[1]["score"] > 0.9
    assert got[2]["labels"] == [] and name not in got[3]["labels"]


def test_all_templates_of_one_file(spark):
    """Also behind a stray word of each template, and where all words are in every file, so that their IDF is 0."""
    every = " and then ".join(op.TEMPLATES.values())
    stray = " ".join(w for t in op.TEMPLATES.values() for w in t.split()[::3])
    others = [(10 + i, f"other text {i}") for i in range(20)]
    for rows in ([(1, every), (2, f"{stray} filler {every}"), *others], [(1, every), (2, f"{stray} {every}")]):
        got = {r["doc_id"]: r for r in op.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for i in (1, 2):
            assert set(op.TEMPLATES) <= set(got[i]["labels"]) and got[i]["score"] == pytest.approx(1)


def plain_labels(texts, templates, key_phrases, min_score=op.MIN_SCORE, floor=op.FLOOR):
    """Labels and score of each text from the definitions: every place of every template in every file, by the IDF of the words that stand there over that of all words of the template."""
    words = [split(t) for t in texts]
    says = lambda ws, p: any(ws[i : i + len(p.split())] == p.split() for i in range(len(ws)))
    out = []
    for ws in words:
        labels, best = {label for p, label in op.PHRASES.items() if says(ws, p)}, 0.0
        for name, t in templates.items():
            ts = split(t)
            idf = [math.log((1 + len(texts)) / (1 + sum(x in other for other in map(set, words)))) for x in ts]
            worth = idf if sum(idf) > 1e-9 else [1.0] * len(ts)
            met = max((sum(worth[k] for k in range(len(ts)) if 0 <= at + k < len(ws) and ws[at + k] == ts[k]) for at in range(-len(ts), len(ws))), default=0)
            score = met / sum(worth)
            best = max(best, score)
            if score >= min_score - 1e-9 and all(says(ws, p) for p in key_phrases[name]):
                labels.add(name)
        out.append((sorted(labels), best if best >= floor - 1e-9 else 0.0))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_and_scores_against_brute_force(spark, seed):
    """Whole, partial, repeated, overlapping and broken templates, in any order, with ties; with words and whole templates that no file has."""
    rng = random.Random(seed)
    templates = {"a": "free use of the work is granted to all who keep this notice", "b": "the work is granted as is without any warranty of use", "c": "free free use use granted granted", "unseen": "free use of a most peculiar sort"}
    keys = {"a": ["free use", "this notice"], "b": ["without any warranty"], "c": ["granted granted"], "unseen": ["free use"]}
    texts = [None, "", *[templates[k] for k in "abc"], " ".join(templates[k] for k in "abc") + " " + templates["a"], "the " * 400, "MIT License"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            ws = templates[rng.choice("abc")].split()
            kind = rng.randrange(4)
            if kind == 1:
                ws = ws[: rng.randrange(len(ws))]
            elif kind == 2:
                ws = [w if rng.random() < 0.7 else "other" for w in ws]
            elif kind == 3:
                ws = ["filler", "MIT", "License"] * rng.randrange(3)
            parts += ws
        texts.append(" ".join(parts))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = plain_labels(texts, templates, keys)
    assert any(0 < s < op.MIN_SCORE for _, s in want)
    for r in op.scan(d, templates=templates, key_phrases=keys).collect():
        labels, score = want[r["doc_id"]]
        assert (r["labels"], r["score"]) == (labels, pytest.approx(score, abs=1e-9)), texts[r["doc_id"]]


def test_mentions_are_no_notices_and_unrelated_words_change_nothing(spark):
    bsd = " ".join(op.TEMPLATES["bsd-text"].split()[:14])
    texts = ["see mozilla public license", "see apache license", bsd, f"{bsd} free software", "plain text of the day", "x " * 100_000 + op.TEMPLATES["isc-text"]]
    want = plain_labels(texts, op.TEMPLATES, op.KEY_PHRASES)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in op.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (labels, score) in enumerate(want):
        assert got[i] == (labels, pytest.approx(score, abs=1e-9)), texts[i][:80]
    assert got[0][0] == [] and got[1][0] == ["apache"] and got[2] == got[3] and got[2][1] > op.FLOOR and got[5][0] == ["isc-text"]
