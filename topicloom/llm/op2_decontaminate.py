r"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

A-Z are lower-cased; words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+. A window is `window` consecutive words of an item; an item of
fewer words, but not none, is one window. A document word inside an occurrence of a window is hit.

Steps. (1) Each window is a set of placed shingles (up to three words). Documents are read once; a broadcast of the
benchmark's distinct shingle hashes (in blocks of bounded size, a pass each, if there are many) keeps the few positions that match, with the words around them.
Beyond PASSES blocks positions are shuffled to the shingles instead, once, as (row, place, hash), and the words come back to the rows that have a start.
(2) Shingles are ordered by how often they occur in the documents; containment of the whole window needs its rarest shingle,
so that is the prefix, and windows with a shingle that occurs nowhere are gone. (3) Positions of prefix shingles give window
starts; those that don't fit into the document fall to the length and positional bounds. (4) The words of the
window are compared with the document's.

Defined results: null or wordless documents have n_words 0 and nothing hit; null or wordless items have no windows; repeated
rows of documents each get a row, repeated items count once, items without an id hit words but aren't counted; an empty benchmark leaves all documents clean; other
columns are not read, so their names can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.llm.common import alnum_words, cut, drop_ids, table, text_digest

WINDOW, SHINGLE = 10, 3
#: Distinct shingles of the benchmark that are broadcast at once; more are dealt into blocks, each with its own pass.
BLOCK_SHINGLES = 2_000_000
#: Most passes over the texts; a benchmark of more blocks than that meets them by one shuffle.
PASSES = 4


def grams(words: Column, size: Column, k: int) -> Column:
    """Hash of the k words from each place on."""
    return F.when(size >= k, F.transform(F.sequence(F.lit(1), size - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(item, win, words): the windows of each item; win is their words joined by spaces."""
    words = items.select(F.col(key).cast("string").alias("item"), alnum_words(F.col(text)).alias("w")).where("size(w) > 0").withColumn("n", F.size("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - (window - 1), F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words")).select("item", F.array_join("words", " ").alias("win"), "words").distinct()


def _matches(docs: DataFrame, shingles: DataFrame, ks: list[int], window: int, sentinel: bool) -> DataFrame:
    """Positions of docs(row, key, w, n) with one of shingles(h), of any length in ks, and the words around them; with `sentinel` also one row without a shingle for each document."""
    first = F.array(F.lit(None).cast("bigint")) if sentinel else F.array().cast("array<bigint>")
    at = docs.withColumn("grams", F.concat(first, *[grams(F.col("w"), F.col("n"), k) for k in ks])).select("row", "key", "n", "w", F.posexplode("grams").alias("pos", "h"))
    known = F.broadcast(shingles.select("h").withColumn("hit", F.lit(True)))  # at most BLOCK_SHINGLES and a few
    at_, pos, before = F.col("pos") - int(sentinel), F.col("pos") - int(sentinel), F.lit(0)
    for k in ks[:-1]:  # places of shingles of the next length come after those of this one
        before = before + F.greatest(F.col("n") - (k - 1), F.lit(0))
        pos = F.when(at_ >= before, at_ - before).otherwise(pos)
    near = F.greatest(pos - (window - 1), F.lit(0))
    return (
        at.join(known, "h", "left")
        .where("hit or (pos = 0 and h is null)")
        .select("row", "key", "n", F.when(F.col("hit"), pos).alias("pos"), "h", near.alias("near"), F.when(F.col("hit"), F.slice("w", near + 1, 2 * window)).alias("around"))
    )


def _shuffled(docs: DataFrame, shingles: DataFrame, ks: list[int]) -> DataFrame:
    """(row, pos, h): the positions of docs with one of shingles, of any number. Both sides of the join are plain, so that Spark can split a shingle that very many texts have."""
    parts = [docs.select("row", F.posexplode(grams(F.col("w"), F.col("n"), k)).alias("pos", "h")) for k in ks]
    return reduce(DataFrame.union, parts).join(shingles.select("h").distinct().hint("merge"), "h")


def occurrences(docs: DataFrame, windows: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(row, key, n) of every document, and (row, start, size, win) of every occurrence of a window."""
    placed = cut(
        windows.select("win", "words").distinct()
        .withColumn("size", F.size("words")).withColumn("k", F.least(F.lit(shingle), F.col("size")))
        .select("win", "words", "size", "k", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1), lambda i: F.xxhash64(F.slice("words", i, F.col("k"))))).alias("offset", "h"))
    )
    shingles = cut(placed.select("k", "h").distinct())
    facts = shingles.groupBy("k").count().collect()  # a row for each shingle length, at most `shingle`
    ks = sorted(r["k"] for r in facts) or [shingle]
    blocks = max(1, -(-sum(r["count"] for r in facts) // BLOCK_SHINGLES))
    if blocks > 1:
        docs = cut(docs.select("key", "text"))  # so that all passes number the rows alike
    # the row number, which isn't deterministic, also keeps Spark from splitting the text again for each shingle
    rows = docs.select("key", alnum_words(F.col("text")).alias("w")).select(F.monotonically_increasing_id().alias("row"), "key", "w", F.size("w").alias("n"))
    wide = blocks > PASSES
    if wide:
        rows = cut(rows)  # words that are joined back must be those of the same row
        every, seen = rows.select("row", "key", "n"), cut(_shuffled(rows, shingles, ks))
    else:
        parts = [_matches(rows, shingles.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == block), ks, window, not block) for block in range(blocks)]
        seen = cut(reduce(DataFrame.union, parts))
        every, seen = seen.where("pos is null").select("row", "key", "n"), seen.where("pos is not null")
    often = seen.groupBy("h").agg(F.count("*").alias("often"))
    rare = placed.join(often, "h", "left").groupBy("win", "words", "size").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "offset", "h")).alias("rare"))
    prefix = cut(rare.where("rare.often > 0").select("win", "words", "size", "rare.offset", "rare.h"))
    few = prefix.limit(BLOCK_SHINGLES // 10 + 1).count() <= BLOCK_SHINGLES // 10  # windows carry their words
    starts = seen.join(F.broadcast(prefix) if few else prefix, "h").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
    if wide:
        starts = starts.select("row", "start", "size", "win", "words").join(rows.select("row", "n", "w"), "row").withColumns({"around": F.col("w"), "near": F.lit(0)})
    found = (
        starts.where(F.col("start") + F.col("size") <= F.col("n"))
        .where(F.slice("around", F.col("start") - F.col("near") + 1, F.col("size")) == F.col("words"))
        .select("row", "start", "size", "win")
    )
    return every, found.distinct()


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(key, n_words, n_hit, n_items, items): a row for each row of docs; items are the sorted ids of items with occurring windows."""
    windows = cut(item_windows(items, item_key, item_text, window))
    rows, found = occurrences(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), windows, window, shingle)
    found = cut(found)
    by_start = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("row", "start", (F.col("start") + F.col("size")).alias("stop")).groupBy("row", "start").agg(F.max("stop").alias("stop"), F.lit(0).alias("size"))
    reached = F.greatest("start", F.coalesce(F.max("stop").over(by_start), F.lit(0)))
    hit = spans.withColumn("new", F.greatest(F.col("stop") - reached, F.lit(0))).groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = found.join(windows.select("win", "item"), "win").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return (
        rows.join(hit.join(named, "row"), "row", "left")
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        .select(F.col("key").alias(key), F.col("n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that hold a window of an item. Rows that share a key go together; those without one go by their text."""
    found = cut(contamination(docs, items, key, text).where("n_hit > 0").select(key))
    kept = drop_ids(docs, found, key)
    if found.where(F.col(key).isNull()).isEmpty():
        return kept
    unnamed = docs.where(F.col(key).isNull()).select(F.struct("*").alias("doc"), text_digest(F.col(text)).alias("digest"))
    leaks = contamination(unnamed.select("digest", F.col("doc")[text].alias("text")).distinct(), items, "digest", "text").where("n_hit > 0").select("digest")
    return kept.where(F.col(key).isNotNull()).unionByName(unnamed.join(leaks, "digest", "left_anti").select("doc.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

ORACLE_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[s : s + 9], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, s, size, array_to_string(w[s : s + size - 1], ' ') AS win
       FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM iw))),
f AS (SELECT DISTINCT r, s, dw.size, item FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM f) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
