"""Token counts with a digest cache.

A row's content digest is the SHA-256 of its text (null counts as empty; nothing else is normalised, since a tokenizer sees white space
and case). The tokenizer digest covers the model file and the library version. The cache is a Parquet table (content_digest,
tokenizer_digest, n_tokens), partitioned by tokenizer. Rows are joined with it; of the digests that miss, one row each is
encoded, whole, and appended; the counts then come from the cache.

Texts aren't shuffled as long as few rows have to be named to leave the others out: the (key, hash) pairs of the rows to encode, or of those to
skip if these are fewer, are broadcast while they number at most BROADCAST_IDS; beyond that, texts are joined by a shuffle on the pair. Only texts
that no key has just once (rows without a key, rows that repeat) are deduplicated by a shuffle.

Defined results: rows with a null key are counted too; repeated rows get a row each, but a text is encoded once; an empty table gives no
rows and leaves the cache as it was; a count that two runs append is the same count and is read once; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import common
from topicloom.llm.common import bounded_batches, cut, table

CACHE = "content_digest string, n_tokens long, tokenizer_digest string"
LIMIT = 4096


def tokenizer_digest(model: bytes) -> str:
    import sentencepiece

    return hashlib.sha256(model + sentencepiece.__version__.encode()).hexdigest()[:32]


def content_digest(text: Column) -> Column:
    return F.sha2(common.utf8(text), 256)


def encoder(spark: SparkSession, model: bytes):
    """A column function: the number of tokens of a text. The model file goes to the executors once, by broadcast (its size is fixed)."""
    shared = spark.sparkContext.broadcast(model)
    held: list = []

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if not held:
            import sentencepiece

            held.append(sentencepiece.SentencePieceProcessor(model_proto=shared.value))
        return pd.Series([len(held[0].encode(t, num_threads=1)) if t else 0 for t in texts], dtype="int64")

    return count


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at path, created empty if there is none."""
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("tokenizer_digest").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def _to_encode(docs: DataFrame, pairs: DataFrame, misses: DataFrame, key: str) -> DataFrame:
    """docs(key, text, h) with one row for each missing text. `only` is a key that has the text once, and brings its row alone; the texts that have no such key are fetched
    by their hash and their rows are deduplicated. The shorter list, of rows to fetch or of rows to skip, is broadcast if it is short enough."""
    chosen, most = cut(misses.where("only is not null").select(F.col("only").alias("key"), "h")), common.BROADCAST_IDS
    named = pairs.where(F.col("key").isNotNull()).select("key", "h")
    n = chosen.count()
    others = named.count() - n
    docs = docs.withColumnRenamed(key, "key")
    if min(n, others) > most:
        rows = docs.join(chosen, ["key", "h"], "left_semi")
    elif n <= others:
        rows = docs.join(F.broadcast(chosen), ["key", "h"], "left_semi")
    else:
        rows = docs.where("key is not null").join(F.broadcast(named.join(chosen, ["key", "h"], "left_anti")), ["key", "h"], "left_anti")
    again = cut(misses.where("only is null").select("content_digest", "h"))
    n = again.limit(most + 1).count()
    if not n:
        return rows.select("text")
    repeated = docs.withColumn("content_digest", content_digest(F.col("text"))).join(F.broadcast(again) if n <= most else again, ["h", "content_digest"], "left_semi")
    return rows.select("text").union(repeated.select("text", "content_digest").dropDuplicates(["content_digest"]).select("text"))


def count_tokens(docs: DataFrame, cache: str, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, content_digest, n_tokens) for every row of docs; new counts are appended to the cache."""
    spark, own = docs.sparkSession, tokenizer_digest(model)
    docs = docs.select(key, F.col(text).alias("text"), F.xxhash64(common.utf8(F.col(text))).alias("h"))
    slim = cut(docs.select(F.col(key).alias("key"), "h", F.octet_length(common.utf8(F.col("text"))).cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("content_digest")))
    known = open_cache(spark, cache).where(F.col("tokenizer_digest") == own).select("content_digest")
    pairs = slim.groupBy("content_digest", "h", "key").agg(F.count("*").alias("n"))
    once = F.when((F.col("n") == 1) & F.col("key").isNotNull(), F.col("key"))
    misses = cut(pairs.groupBy("content_digest", "h").agg(F.min(once).alias("only")).join(known, "content_digest", "left_anti"))
    if not misses.isEmpty():
        bounded_batches(spark)
        todo = _to_encode(docs, pairs, misses, key)
        fresh = todo.select(content_digest(F.col("text")).alias("content_digest"), encoder(spark, model)(F.coalesce("text", F.lit(""))).alias("n_tokens"))
        fresh.withColumn("tokenizer_digest", F.lit(own)).write.mode("append").partitionBy("tokenizer_digest").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer_digest") == own).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = cut(counts)  # so that the join below reads both sides from shuffles of its own, and a digest that many rows have can be split
    return slim.join(counts, "content_digest").select(F.col("key").alias(key), "n_bytes", "content_digest", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    cache = f"{common.shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    found = count_tokens(table(spark, sf_dir, "documents"), cache, model)
    common.remove(spark, cache)  # the counts are checkpointed
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
