"""Catalogue blocks: a tree of any shape comes back whole and in order, no document grows, and what is lost is named."""

import json
import random

import pytest

from topicloom.sources import blocks

T = "domain_id string, topic_id string, title string, parent_topic_id string, ord long"


def tree(seed, n=300):
    """One topic has a third of all as children; ids repeat between domains."""
    rng, rows = random.Random(seed), []
    for d in ("a", "b"):
        for k in range(n):
            up = None if k < 2 else "t1" if k % 3 == 0 else f"t{rng.randrange(min(k, 40))}"
            rows.append((d, f"t{k}", None if k % 50 == 9 else f"{d}: „{k}“\n", up, rng.randrange(10**9) * 1000 + k))
    return rows


def preorder(rows, domain):
    kids = {}
    for r in sorted(rows, key=lambda r: r[4]):
        if r[0] == domain:
            kids.setdefault(r[3], []).append(r)

    def walk(up, depth):
        for r in kids.get(up, []):
            yield r[1], r[2] or "", up, depth
            yield from walk(r[1], depth + 1)

    return list(walk(None, 0))


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_trees_come_back_in_order(spark, tmp_path, rows):
    made = tree(rows)
    names = spark.createDataFrame([("a", "A"), ("b", None), ("c", "no topics")], "domain_id string, display_name string")
    blocks.write_blocks(spark.createDataFrame(random.Random(0).sample(made, len(made)), T), names, ["ord"], str(tmp_path), rows)
    read = blocks.read_blocks(spark, str(tmp_path))
    heads = blocks.read_heads(spark, str(tmp_path))
    flat = blocks.flatten_blocks(read).orderBy("domain_id", "path").collect()
    for d in ("a", "b"):
        assert [(r["topic_id"], r["title"], r["parent_topic_id"], r["depth"]) for r in flat if r["domain_id"] == d] == preorder(made, d)
    assert len(flat) == len(made)
    assert read.selectExpr("max(size(children))").first()[0] <= rows
    assert sorted(map(tuple, heads.select("domain_id", "display_name", "roots").collect())) == [("a", "A", 2), ("b", "", 2), ("c", "no topics", 0)]
    assert blocks.lost_blocks(heads, read).isEmpty()


def test_broken_and_lost_documents_are_named(spark, tmp_path):
    made = [("a", "r", "root", None, 0)] + [("a", f"k{i}", "kid", "r", i) for i in range(1, 8)] + [("a", "below", "x", "k1", 0)]
    blocks.write_blocks(spark.createDataFrame(made, T), spark.createDataFrame([("a", "A"), ("z", "Z")], "domain_id string, display_name string"), ["ord"], str(tmp_path), 3)
    docs = [json.loads(line) for f in (tmp_path / "blocks").glob("part-*") for line in f.read_text().splitlines()]
    lost = tmp_path / "again"
    (lost / "blocks").mkdir(parents=True)
    text = [json.dumps(x) if (x["parent"], x["block"]) != ("r", 0) else json.dumps(x)[:-9] for x in docs if (x["parent"], x["block"]) != ("r", 2)]
    (lost / "blocks" / "x.json").write_text("\n".join([*text, "", "{}"]) + "\n")
    read = blocks.read_blocks(spark, str(lost))
    assert sorted(map(tuple, blocks.lost_blocks(blocks.read_heads(spark, str(tmp_path)), read).collect())) == [("a", "r", 0), ("a", "r", 2)]
    assert {r["topic_id"] for r in blocks.flatten_blocks(read).collect()} == {"r", "k4", "k5", "k6"}


def test_an_empty_catalogue(spark, tmp_path):
    blocks.write_blocks(spark.createDataFrame([], T), spark.createDataFrame([], "domain_id string, display_name string"), ["ord"], str(tmp_path))
    assert blocks.flatten_blocks(blocks.read_blocks(spark, str(tmp_path))).isEmpty()
    assert blocks.lost_blocks(blocks.read_heads(spark, str(tmp_path)), blocks.read_blocks(spark, str(tmp_path))).isEmpty()
