"""Tables stored in parts: their shuffle files go, and candidates placed in parts are those placed in one."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from topicloom.operators import merges
from topicloom.plans import job_queries, registry
from topicloom.session import discard, scratch, slices, stored

SF = "/root/testdata/sf0.001"


def shuffles(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {os.path.basename(f) for f in files if "/shuffle_" in f}


def test_parts_leave_no_shuffle_files(spark):
    rows = spark.range(30_000).select((F.col("id") % 999).alias("k"), "id")
    had = shuffles(spark)
    path = scratch(spark, "sums")
    sums = stored((part.groupBy("k").agg(F.sum("id").alias("n")) for part in slices(rows, "k", 3)), path=path)
    assert shuffles(spark) <= had
    assert sums.agg(F.count("*"), F.sum("n")).first() == (999, sum(range(30_000)))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    discard(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
@pytest.mark.parametrize("name", ["quarantine_split", "check_accounting", "check_public_allowlist", "quarantine_records", "placement_report", "place_candidates", "materialize_containers", "container_witnesses"])
def test_candidates_in_parts(spark, monkeypatch, name):
    monkeypatch.setattr(job_queries, "PART_LINES", 2000)
    assert job_queries.parts(spark, SF) == 3
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name]).df()
    gone = []
    monkeypatch.setattr(merges, "discard", lambda spark, path: (gone.append(path[-6:]), discard(spark, path)))
    got = registry.queries()[name](spark, SF).toPandas()
    assert gone == ([] if "container" in name else ["part=0", "part=1", "part=2"])  # each as soon as it was placed; containers need no places
    rows = lambda df: sorted(map(tuple, df[sorted(want.columns)].astype(str).values.tolist()))
    assert rows(got) == rows(want)
