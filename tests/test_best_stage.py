"""best_stage on lines that differ only in what a short place leaves out."""

from datetime import datetime

from topicloom.plans import registry

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


def test_lines_that_agree_in_key_and_price(spark, tmp_path):
    day = lambda n: datetime(1995, 3, n)
    # item 1: shipped on two days; item 2: two taxes; item 3: two discounts; item 4: a price that begins another; item 5: the better stage lies later
    lines = [(1, 1, 1, 1, 5.0, 12.34, 0.0, 0.01, "A", "F", day(9)), (1, 1, 1, 1, 5.0, 12.34, 0.0, 0.01, "A", "F", day(2))]
    lines += [(2, 1, 1, 1, 5.0, 12.34, 0.0, 0.05, "A", "F", day(1)), (2, 1, 1, 1, 5.0, 12.34, 0.0, 0.02, "A", "F", day(3))]
    lines += [(3, 1, 1, 1, 5.0, 12.34, 0.07, 0.01, "A", "F", day(1)), (3, 1, 1, 1, 5.0, 12.34, 0.03, 0.01, "A", "F", day(3))]
    lines += [(4, 1, 1, 1, 5.0, 12.3, 0.0, 0.01, "A", "F", day(1)), (4, 1, 1, 1, 5.0, 123.04, 0.0, 0.01, "A", "F", day(1))]
    lines += [(5, 1, 1, 1, 5.0, 12.34, 0.0, 0.01, "A", "F", day(1)), (5, 1, 1, 1, 5.0, 12.34, 0.0, 0.01, "N", "F", day(2))]
    spark.createDataFrame(lines, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT 1L AS p_partkey, 'bolt' AS p_name, 'b' AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("SELECT 1L AS s_suppkey, 1 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("SELECT 1 AS n_nationkey, 1 AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    got = {(r["source_item_id"], r["stage"].rsplit("_")[-1], r["ord"]) for r in registry.queries()["best_stage"](spark, str(tmp_path)).collect()}
    assert got == {
        ("i1-1", "reviewed", "1-1-1-1-1234AF5-1-0-1995-03-02 00:00:00"),
        ("i2-1", "reviewed", "2-1-1-1-1234AF5-2-0-1995-03-03 00:00:00"),
        ("i3-1", "reviewed", "3-1-1-1-1234AF5-1-3-1995-03-03 00:00:00"),
        ("i4-1", "reviewed", "4-1-1-1-12304AF5-1-0-1995-03-01 00:00:00"),
        ("i5-1", "published", "5-1-1-1-1234NF5-1-0-1995-03-02 00:00:00"),
    }
