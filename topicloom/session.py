"""Session helpers: the shared scratch folder, lineage cuts and tables kept in between."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own, on a local master alone, for other machines couldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="topicloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; spark.cleaner.referenceTracking.cleanCheckpoints removes checkpoints, but what is written here stays until its owner deletes it."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Spark's setting by which the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(rows: DataFrame | Iterable[DataFrame], name: str = "table", path: str | None = None, by: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder; if they come in parts, these are written one after the other. Such a table is smaller than a checkpoint, Spark's joins know its size, and the shuffle files of a part go before the next one
    is begun. With `by`, a folder a value of that column. It is deleted by discard() of its path, or when the driver ends."""
    parts = iter([rows] if isinstance(rows, DataFrame) else rows)
    part = next(parts)
    spark, schema = part.sparkSession, part.schema
    path = path or scratch(spark, name)
    at, fs = _at(spark, path)
    fs.deleteOnExit(at)
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        while part is not None:
            part.write.mode("append").parquet(path, partitionBy=by)
            part = next(parts, None)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(schema).parquet(path)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Delete what stored() has written; nothing that reads it may run later."""
    at, fs = _at(spark, path)
    fs.delete(at, True)


def slices(rows: DataFrame, key: str, n: int) -> list[DataFrame]:
    """rows in n parts by a hash of a key; together they are all rows."""
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == at) for at in range(n)] if n > 1 else [rows]
