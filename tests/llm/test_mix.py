import math

import pytest
from pyspark.sql import functions as F

from topicloom.llm import op3_mix as op


def test_targets(spark):
    sizes = {"b": 50, "a": 1000, None: 400, "é": 0, "c": 10}
    got = {r["source"]: r["target"] for r in op.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = ["a", "b", "c", "é", None]
    weights, capped, left = dict(zip(order, (5, 2, 1, 5, 2), strict=True)), {}, dict(sizes)
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        goal = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
        above = {s: 3 * sizes[s] for s in left if goal[s] > 3 * sizes[s]}
        if not above:
            break
        capped |= above
        left = {s: v for s, v in left.items() if s not in above}
    assert got == pytest.approx(goal | capped)


def test_mix_is_near_its_targets_and_repeats(spark, docs, empty):
    rows = op.mix(docs).select("doc.source", "doc.doc_id", "size", "source_size", "target", "copies").collect()
    assert len(rows) == docs.count()
    assert max(r["copies"] for r in rows) <= 3
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        taken, most = sum(r["size"] * r["copies"] for r in own), max(r["size"] for r in own)
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(taken - own[0]["target"]) <= most
        assert {r["copies"] for r in own} <= {(k := math.floor(own[0]["target"] / own[0]["source_size"])), k + 1}
    again = op.mix(docs.repartition(7)).select("doc.source", "doc.doc_id", "size", "source_size", "target", "copies").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    out = op.sample(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in rows)
    assert op.mix(empty).count() == 0 and op.sample(empty).columns == empty.columns


def test_null_and_repeated_ids_come_near_the_target(spark):
    """A source of rows without ids, one of a single repeated row, and one of ids that each have several texts."""
    rows = [(None, "null ids", f"w{i} a b c") for i in range(100)] + [(7, "one row", "x y z")] * 200 + [(i % 3, "few ids", "t " * (1 + i % 7)) for i in range(150)]
    d = spark.createDataFrame(rows + [(9, "rest", "r " * 5000)], "doc_id long, source string, text string")
    got = op.mix(d.repartition(6)).select("doc.*", "size", "target", "copies").collect()
    assert len(got) == len(rows) + 1
    for s in ("null ids", "one row", "few ids"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1
    assert op.sample(d).count() == sum(r["copies"] for r in got)


def test_query_equals_its_sql_on_null_and_repeated_rows(spark, docs, tmp_path):
    import duckdb

    docs.select("doc_id", "text", "source").withColumn("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("doc_id"))).union(docs.select("doc_id", "text", "source").where("doc_id % 4 = 0")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6), r[4])
    assert sorted(map(key, op.query(spark, str(tmp_path)).collect())) == sorted(map(key, db.execute(op.ORACLE_SQL).fetchall()))


def test_heavier_documents_are_picked_more(spark):
    n = 4000
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, "s").alias("source"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("q"))
    d = d.union(spark.createDataFrame([(-1, "t", 1.0)], "doc_id long, source string, q double"))
    size = F.when(F.col("source") == "t", 2000).otherwise(1).cast("long")
    rows = op.copies(d, F.col("doc_id"), F.col("source"), size, F.col("q"), cycle=(1, 2)).where("doc.source = 's'").groupBy(F.col("doc.q").alias("q")).agg(F.sum("copies").alias("n")).collect()
    got = {r["q"]: r["n"] for r in rows}
    assert sum(got.values()) == 2000 and got[1.0] > 1.8 * got[0.25]


def test_marks_lower_the_weight(spark):
    rows = spark.createDataFrame([("a b c d",), ("a!! b$$$ c d",), ("",), (None,)], "text string").select(op.quality(F.col("text")).alias("q")).collect()
    assert [r["q"] for r in rows] == [1.0, 4 / 24, 1.0, 1.0]
