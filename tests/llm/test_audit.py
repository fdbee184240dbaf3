import random
import re
from itertools import permutations

from topicloom.llm import op11_audit as op


def test_swaps_reach_all_orders():
    for n in range(1, 6):
        order, seen = list(range(n)), []
        for level in [*op.adjacent_swaps(n), None]:
            seen.append(tuple(order))
            if level is not None:
                order[level], order[level + 1] = order[level + 1], order[level]
        assert sorted(seen) == sorted(permutations(range(n)))


def test_diagrams_are_reduced():
    d = op.Diagram({m: (1, 0, 0) for m in range(32)})
    assert len(d.nodes) == 6  # all branches alike: a node a level and one end
    d = op.Diagram({0: (1, 0, 0)})
    d.swap(2)
    assert d.order == list("ABDCE") and d.sums[d.root] == (1, 0, 0)


def mask(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]


def test_against_counting(spark):
    rng = random.Random(6)
    texts = [None, "", " \n", "A", "# a", "z" * 60_000, " ".join(f"w{i}" for i in range(30_000)), " ".join(["same"] * 250), " ".join(f"W{i}" for i in range(250)), " ".join(f"é{i}" for i in range(199)), " ".join(f"é{i}\x85b" for i in range(200))]
    texts += [" ".join(rng.choice(["a", "B", "c%", "Dd"]) + str(rng.randrange(400)) for _ in range(rng.randrange(150, 260))) for _ in range(40)]
    rows = [(i, rng.choice(texts), rng.choice([None, "", "en", "de"]), "x") for i in range(150)] + [(None, texts[7], "en", "x"), (None, texts[7], "de", "x")]
    rows += [(7, texts[7], "en", "x"), (7, texts[7], "en", "x"), (7, texts[8], "de", "x")] + [(1000 + i, texts[9], "en", "x") for i in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r[:3]): tuple(r[3:]) for r in op.audit(docs, marks).collect()}

    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    each = [(lang or "", mask(t or "", i is not None and i > least[t or ""]), i in good and i is not None, i in toxic and i is not None) for i, t, lang, _ in rows]
    want = {}
    for part in {p for p, *_ in each}:
        mine = [x[1:] for x in each if x[0] == part]
        removed = {}
        for order in map("".join, permutations("ABCDE")):
            left, gone = mine, []
            for step, f in enumerate(order, 1):
                k = "ABCDE".index(f)
                out = [x for x in left if x[0][k]]
                removed[f] = removed.get(f, 0) + len(out)
                left = [x for x in left if not x[0][k]]
                want[part, order, step] = (len(left), len(out), sum(x[0][k] for x in gone), sum(x[0][k] and sum(x[0]) == 1 for x in mine), sum(x[1] for x in out), sum(x[2] for x in out))
                gone = gone + out
        for (p, order, step), v in want.items():
            if p == part:
                want[p, order, step] = (*v[:6], removed[order[step - 1]])
    assert got == want
    assert op.audit(docs.limit(0), marks).count() == 0
    assert op.audit(docs, marks.limit(0)).count() == len(want)


def test_labels_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 3}", "en") for i in range(30)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2, 1) for i in range(30)], "doc_id long, quality int, toxic int")
    one = sorted(op.audit(docs, marks).collect())
    monkeypatch.setattr(op, "BROADCAST_IDS", 3)
    assert sorted(op.audit(docs, marks).collect()) == one
