"""Catalogue trees as documents of bounded size: a head a domain, and the children of a topic in blocks that the topic's own entry counts.

A nested document grows with its domain; here no document holds more than `rows` topics, whatever the size of a domain or of one topic's children, so writers and readers split anywhere. Lines of JSON, many to a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.windows import numbered
from topicloom.session import cut

BLOCK_ROWS = 1000
HEAD = "domain_id string, display_name string, roots bigint, blocks bigint"
BLOCK = "domain_id string, parent string, block bigint, children array<struct<pos:bigint,topic_id:string,title:string,blocks:bigint>>"


def write_blocks(topics: DataFrame, names: DataFrame, order: list[str], path: str, rows: int = BLOCK_ROWS) -> None:
    """topics(domain_id, topic_id, title, parent_topic_id; null for roots) and names(domain_id, display_name) under path/heads and path/blocks. Siblings keep `order`, which must tell them apart; the children of a topic of any
    number are dealt over ranges. Topic ids are unique in a domain; null and missing titles are empty; a domain without topics is a head of none."""
    placed = topics.withColumn("parent", F.coalesce("parent_topic_id", F.lit("")))
    each = cut(numbered(placed, ["domain_id", "parent"], order, "pos").select("domain_id", "parent", "pos", "topic_id", F.coalesce("title", F.lit("")).alias("title")))
    sizes = cut(each.groupBy("domain_id", "parent").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / rows).cast("long")))
    own = sizes.where("parent <> ''").select("domain_id", F.col("parent").alias("topic_id"), "blocks")
    entry = F.struct("pos", "topic_id", "title", F.coalesce("blocks", F.lit(0).cast("long")).alias("blocks"))
    block = F.floor((F.col("pos") - 1) / rows).cast("long")
    entries = each.join(own, ["domain_id", "topic_id"], "left").select("domain_id", "parent", block.alias("block"), entry.alias("entry"))
    docs = entries.groupBy("domain_id", "parent", "block").agg(F.array_sort(F.collect_list("entry")).alias("children"))  # at most `rows` entries
    docs.write.mode("overwrite").json(f"{path}/blocks")
    top = sizes.where("parent = ''").select("domain_id", F.col("n").alias("roots"), "blocks")
    heads = names.join(top, "domain_id", "left").select("domain_id", F.coalesce("display_name", F.lit("")).alias("display_name"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("roots", "blocks")])
    heads.write.mode("overwrite").json(f"{path}/heads")


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEAD).json(f"{path}/heads")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks as written; a line that can't be parsed is left out here, and lost_blocks() tells which block it was."""
    return spark.read.schema(BLOCK).json(f"{path}/blocks", mode="DROPMALFORMED").where("domain_id is not null and parent is not null and block is not null")


def lost_blocks(heads: DataFrame, blocks: DataFrame) -> DataFrame:
    """(domain_id, parent, block): what a head or an entry counts and no document is; parent is empty for a domain's roots."""
    entries = blocks.select("domain_id", F.explode("children").alias("e")).select("domain_id", F.col("e.topic_id").alias("parent"), F.col("e.blocks").alias("n"))
    told = heads.select("domain_id", F.lit("").alias("parent"), F.col("blocks").alias("n")).union(entries).where("n > 0")
    wanted = told.select("domain_id", "parent", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    return wanted.join(blocks.select("domain_id", "parent", "block"), ["domain_id", "parent", "block"], "left_anti")


def flatten_blocks(blocks: DataFrame, max_depth: int = 32) -> DataFrame:
    """(domain_id, topic_id, title, parent_topic_id, depth, path): the tree from its roots, a join a level of parents that have children with their blocks; `path` sorts in pre-order. What hangs below a lost block isn't reached."""
    entries = cut(blocks.select("domain_id", "parent", F.explode("children").alias("e")).select("domain_id", "parent", "e.*"))
    level = entries.where("parent = ''").select("domain_id", "topic_id", "title", F.lit(None).cast("string").alias("parent_topic_id"), F.array("pos").alias("path"), "blocks")
    out = None
    for depth in range(max_depth):
        level = cut(level)
        flat = level.select("domain_id", "topic_id", "title", "parent_topic_id", F.lit(depth).alias("depth"), "path")
        out = flat if out is None else out.union(flat)
        above = level.where("blocks > 0").select("domain_id", F.col("topic_id").alias("parent"), F.col("path").alias("up"))
        if above.isEmpty():
            return out
        level = entries.join(above, ["domain_id", "parent"]).select("domain_id", "topic_id", "title", F.col("parent").alias("parent_topic_id"), F.concat("up", F.array("pos")).alias("path"), "blocks")
    raise ValueError(f"a tree is deeper than {max_depth}")
