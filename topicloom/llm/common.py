"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one long column that may be broadcast; beyond it, joins shuffle.
BROADCAST_IDS = 2_000_000
#: Parts in which a group's rows are numbered.
CHUNKS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own, on a local master alone, for other machines couldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="topicloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Hold Arrow batches to a number of rows and bytes, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. lower() does the same, and faster, where the text is all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    r"""The words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text whose A-Z are lower-cased; no words for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def space_word_count(text: Column) -> Column:
    r"""How many words [^\x20\x09-\x0D]+ a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def text_digest(text: Column) -> Column:
    """What stands for a row that has no key."""
    return F.sha2(utf8(text.cast("string")), 256)


def drop_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of df whose key isn't in ids. ids are broadcast while they are at most BROADCAST_IDS, else both sides shuffle."""
    ids = cut(ids.select(key).where(F.col(key).isNotNull()).distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_anti")


def numbered(rows: DataFrame, group: list[str], row: str = "row") -> DataFrame:
    """rows with `number`, from 0 on within each group (null values are values). `row` tells rows apart and is checkpointed, so that it stays the same; by its hash
    the rows of a group, of whatever size, are dealt into CHUNKS parts that are numbered each for itself after the sizes of the parts before."""
    named = [f"_g{i}" for i in range(len(group))]
    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64(row), F.lit(CHUNKS)).cast("int"))
    sums = dealt.groupBy(*group, "_chunk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    starts = cut(sums.select(*[F.col(g).alias(n) for g, n in zip(group, named, strict=True)], F.col("_chunk").alias("_c"), before.alias("_before")))
    own = F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy(row)) - 1
    same = F.col("_chunk") == F.col("_c")
    for g, n in zip(group, named, strict=True):
        same &= F.col(g).eqNullSafe(F.col(n))
    return dealt.withColumn("_own", own).join(starts, same).withColumn("number", (F.col("_before") + F.col("_own")).cast("long")).drop("_chunk", "_c", "_own", "_before", *named)
