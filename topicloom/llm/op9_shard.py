"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only.

The law is `bytes`: no shard holds more than (1 + slack) of an even share. A row's place on the ring is the hash of its text, so
equal texts stay together. Each shard owns the arcs that end at its virtual nodes. Rows are summed into places of the ring; a
shard takes its places in the order of the ring, those of over LARGE of a share before all others, until it is full, and what overflows goes on clockwise to the next shard that isn't.
A place whose weight passes half a shard (one text that makes up much of the table) is dealt out by row id, and rows that share id and text by their number. If, in a small
table of large documents, some place fits nowhere, the bound rises until it fits.

Only sums over places of the ring are ordered or moved in the rounds, PLACES rows for each virtual node and a few, however large the table is; slots
come from counts by cell, a few hundred rows or a few thousandths of the table each.

Defined results: a null text has size 1 and the place of an empty one; repeated rows get a slot each; null ids are allowed; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.llm.common import cut, table, utf8

SHARDS, VNODES, SLACK = 8, 64, 0.005
#: Of an even share: what is placed before the rest, what is split, and into which parts.
LARGE, SPLIT, PART = 0.02, 0.5, 0.125
#: Places of the ring: at least 2 ** BITS, and PLACES for each virtual node.
BITS, PLACES = 14, 32
#: A table's rows are numbered in about so many cells beyond the bins.
CELLS, CELL_ROWS = 8192, 256


def bits_of(shards: int, vnodes: int) -> int:
    """The ring's places, as a power of two."""
    return max(BITS, (PLACES * shards * vnodes - 1).bit_length())


def ring(spark: SparkSession, shards: int, vnodes: int, open_shards: list[int]) -> DataFrame:
    """(bin, shard): the owner of each place, going clockwise to the next virtual node of an open shard."""
    bits = bits_of(shards, vnodes)
    top_bin = (1 << bits) - 1
    nodes = (
        spark.range(shards * vnodes)
        .select(F.floor(F.col("id") / vnodes).cast("int").alias("shard"), F.shiftrightunsigned(F.xxhash64(F.floor(F.col("id") / vnodes), F.pmod("id", F.lit(vnodes))), 64 - bits).cast("int").alias("bin"))
        .where(F.col("shard").isin(open_shards))
        .groupBy("bin").agg(F.min("shard").alias("shard"))
    )
    before = F.lag("bin").over(Window.orderBy("bin"))  # at most shards x vnodes rows
    arcs = nodes.withColumn("low", before).withColumn("first", F.coalesce(F.col("low") + 1, F.lit(0)))
    last = nodes.agg(F.max("bin").alias("top"), F.min_by("shard", "bin").alias("shard")).where(F.col("top") < top_bin).select("shard", F.explode(F.sequence(F.col("top") + 1, F.lit(top_bin))).alias("bin"))
    return arcs.select("shard", F.explode(F.sequence("first", "bin")).alias("bin")).union(last).select("bin", "shard")


def place(units: DataFrame, total: int, shards: int, vnodes: int, slack: float) -> DataFrame:
    """units(bin, sub, weight) with their shard. Weights are bytes; `units` has a bounded number of rows. Large units are placed before the others, while shards have room for them."""
    share = total / shards
    bound, load, done = share * (1 + slack), dict.fromkeys(range(shards), 0), []
    large = F.col("weight") > LARGE * share
    for left in (units.where(large), units.where(~large)):
        open_shards = list(range(shards))
        while True:
            room = F.element_at(F.create_map(*[F.lit(x) for s in open_shards for x in (s, float(bound - load[s]))]), F.col("shard"))
            so_far = F.sum("weight").over(Window.partitionBy("shard").orderBy("bin", "sub").rowsBetween(Window.unboundedPreceding, 0))
            tried = cut(left.join(F.broadcast(ring(units.sparkSession, shards, vnodes, open_shards)), "bin").withColumn("fits", so_far <= room))
            facts = tried.groupBy("shard").agg(F.sum(F.when(F.col("fits"), F.col("weight")).otherwise(0)).alias("taken"), F.count_if(~F.col("fits")).alias("over"), F.min(F.when(~F.col("fits"), F.col("weight"))).alias("least")).collect()  # a row a shard
            done.append(tried.where("fits").select("bin", "sub", "shard"))
            for r in facts:
                load[r["shard"]] += r["taken"]
                if r["over"]:
                    open_shards.remove(r["shard"])
            if not any(r["over"] for r in facts):
                break
            if not open_shards:
                bound = max(bound + share / 100, min(load.values()) + min(r["least"] for r in facts if r["over"]))
                open_shards = [s for s in range(shards) if load[s] < bound]
            left = tried.where("not fits").select("bin", "sub", "weight")
    return cut(reduce(DataFrame.union, done))


def numbered(slim: DataFrame, rows: float, weight: float) -> DataFrame:
    """slim with `number`: from 0 on among rows of one key and text where they pass `rows` or `weight`, else null. Such rows are alike, so it doesn't matter which has which number."""
    alike = slim.withColumn("alike", F.xxhash64("key", "h"))
    many = alike.groupBy("alike").agg(F.count("*").alias("n"), F.sum("size").alias("w")).where((F.col("n") > 1) & ((F.col("n") > rows) | (F.col("w") > weight)))
    many = cut(many.select("alike", F.ceil(F.col("n") / rows).alias("chunks")))  # no more rows than the table has cells and shards have parts
    if many.isEmpty():
        return slim.withColumn("number", F.lit(None).cast("long"))
    marked = alike.join(F.broadcast(many), "alike", "left").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")))
    sums = cut(marked.where("chunk is not null").groupBy("alike", "chunk").agg(F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("alike").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    own = F.row_number().over(Window.partitionBy("alike", "chunk").orderBy("row")) - 1
    dealt = marked.where("chunk is not null").withColumn("own", own).join(F.broadcast(sums.select("alike", "chunk", before.alias("before"))), ["alike", "chunk"])
    rest = marked.where("chunk is null").select(*slim.columns, F.lit(None).cast("long").alias("number"))
    return rest.union(dealt.select(*slim.columns, (F.col("before") + F.col("own")).cast("long").alias("number")))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, vnodes: int = VNODES, slack: float = SLACK) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row of docs."""
    body = utf8(F.col(text))
    slim = docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"),
        F.xxhash64(body).alias("h"), F.monotonically_increasing_id().alias("row"),
    ).withColumn("bin", F.shiftrightunsigned("h", 64 - bits_of(shards, vnodes)).cast("int"))
    slim = cut(slim)
    bins = cut(slim.groupBy("bin").agg(F.sum("size").alias("weight"), F.count("*").alias("n")))
    total, rows = bins.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    share, cell = max(1.0, total / shards), max(CELL_ROWS, rows / CELLS)
    subs = F.when(F.col("weight") > SPLIT * share, F.ceil(F.col("weight") / (PART * share))).otherwise(1)
    parts = bins.select("bin", subs.alias("subs"), F.greatest(subs, F.ceil(F.col("n") / cell)).alias("cells"))
    cell_of = F.coalesce(F.pmod("number", F.col("cells")), F.pmod(F.xxhash64("key", "bin"), F.col("cells")))
    cells = numbered(slim, cell, PART * share).join(F.broadcast(parts), "bin").withColumn("cell", cell_of)
    cells = cut(cells.withColumn("sub", F.pmod("cell", F.col("subs"))).drop("cells", "subs", "number"))
    sums = cut(cells.groupBy("bin", "sub", "cell").agg(F.sum("size").alias("weight"), F.count("*").alias("n")))
    placed = place(sums.groupBy("bin", "sub").agg(F.sum("weight").alias("weight")), total, shards, vnodes, slack)
    offset = F.sum("n").over(Window.partitionBy("shard").orderBy("bin", "cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = sums.join(placed, ["bin", "sub"]).select("bin", "cell", "shard", offset.alias("offset"))
    rank = F.row_number().over(Window.partitionBy("bin", "cell").orderBy("h", "key", "size", "crc", "row"))
    found = cells.withColumn("rank", rank).join(F.broadcast(starts), ["bin", "cell"])  # at most a row for each place, CELLS and a few
    return found.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(table(spark, sf_dir, "documents"))


def stage(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
