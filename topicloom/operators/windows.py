"""First-wins and best-wins records, numbering, paging, and set differences. Winners are aggregates, which combine before the shuffle, so that the records of a hot topic and title never meet in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import casefold, fingerprint, non_empty, normalize_text
from topicloom.session import cut

PAGE = 24
# Campaign stages by priority, and the mapping that counts as explicit.
STAGES = {"0809_campaign_build": 1, "0809_campaign_reviewed": 2, "0809_campaign_published": 3}
EXPLICIT = "explicit_node_alias"


def preference() -> Column:
    """What makes one copy of a statement better than another, as one comparable value: evidence, how much, confidence, an explicit mapping, the length of its body."""
    body = F.char_length(F.concat(F.coalesce("latex", F.lit("")), F.coalesce("plain", F.lit(""))))
    explicit = F.coalesce(F.col("mapping_method") == EXPLICIT, F.lit(False))
    return F.struct((F.col("evidence") > 0).alias("has"), F.col("evidence").alias("n"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), explicit.alias("explicit"), body.alias("length"))


def worse() -> Column:
    """preference() upside down, so that the least is the best; what is missing is worst."""
    p = preference()
    down = lambda c: -F.coalesce(c, F.lit(0))
    yes = lambda c: ~F.coalesce(c, F.lit(False))
    return F.struct(yes(p["has"]).alias("has"), down(p["n"]).alias("n"), down(p["confidence"]).alias("confidence"), yes(p["explicit"]).alias("explicit"), down(p["length"]).alias("length"))


def title_or_print() -> Column:
    """The key of a record within its topic: its title, or the fingerprint of a record without one."""
    key = normalize_text(F.col("title"))
    return F.when(key != "", F.concat(F.lit("t"), key)).otherwise(F.concat(F.lit("f"), fingerprint(F.col("topic_id"), F.col("title"), F.col("latex"), F.col("plain"))))


def dedupe_first(statements: DataFrame) -> DataFrame:
    """All rows with `rn`, 1 for the first by ord (unique) of each topic and title (or fingerprint), 2 for the rest. Only (topic, key, ord) is aggregated; the firsts are joined back by ord, a key of one row."""
    first = statements.groupBy("topic_id", title_or_print().alias("_key")).agg(F.min("ord").alias("ord"))
    return statements.join(first.select("ord", F.lit(1).alias("rn")), "ord", "left").withColumn("rn", F.coalesce("rn", F.lit(2)))


def first_rows(statements: DataFrame) -> DataFrame:
    """The firsts of dedupe_first() alone, in one pass over the rows."""
    keyed = statements.select("topic_id", title_or_print().alias("_key"), "ord", F.struct(*statements.columns).alias("_row"))
    return keyed.groupBy("topic_id", "_key").agg(F.min_by("_row", "ord").alias("_row")).select("_row.*")


def dedupe_best(statements: DataFrame) -> DataFrame:
    """The best row of each topic and title, or id where there is no title, at the place (ord) of the first; the earlier wins ties. Rows without title and id all stay."""
    title = normalize_text(F.col("title"))
    key = F.when(title != "", F.concat(F.lit("t"), title)).otherwise(F.coalesce(F.concat(F.lit("i"), non_empty(F.col("statement_id"))), F.concat(F.lit("o"), F.col("ord").cast("string"))))
    keyed = statements.select("topic_id", key.alias("_key"), "ord", F.struct(worse().alias("p"), F.col("ord").alias("o")).alias("_worse"), F.struct(*statements.columns).alias("_row"))
    best = keyed.groupBy("topic_id", "_key").agg(F.min_by("_row", "_worse").alias("_row"), F.min("ord").alias("first_ord"))
    return best.select("_row.*", "first_ord")


def best_stage(candidates: DataFrame) -> DataFrame:
    """Of each source item the candidate with a body of the highest stage, the first by ord on ties."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), F.col("stage"))
    has_body = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("latex", F.lit("")) != "")
    keyed = candidates.where(has_body).select("source_item_id", F.struct((-F.coalesce(rank, F.lit(0))).alias("rank"), "ord").alias("_at"), F.struct(*candidates.columns).alias("_row"))
    return keyed.groupBy("source_item_id").agg(F.min_by("_row", "_at").alias("_row")).select("_row.*")


def display_numbers(topics: DataFrame) -> DataFrame:
    """(topic_id, number): the root's digits without leading zeros, then 1-based ranks among siblings. One join a level."""
    rank = F.row_number().over(Window.partitionBy("parent_topic_id").orderBy("kind", "pos", "topic_id")).cast("string")
    ranked = cut(topics.where("parent_topic_id is not null").select("topic_id", "parent_topic_id", rank.alias("rank")))
    digits = F.regexp_replace(F.regexp_extract("topic_id", r"\d+", 0), "^0+(?=.)", "")
    levels = [topics.where("parent_topic_id is null").select("topic_id", digits.alias("number"))]
    for _ in range(topics.agg(F.max("depth")).first()[0] or 0):
        up = levels[-1].select(F.col("topic_id").alias("parent_topic_id"), F.col("number").alias("up"))
        levels.append(cut(ranked.join(up, "parent_topic_id").select("topic_id", F.concat("up", F.lit("."), "rank").alias("number"))))
    return reduce(DataFrame.union, levels)


def numbered(rows: DataFrame, keys: list[str], order: list[str], number: str = "number") -> DataFrame:
    """rows with their number, from 1 on, within each group of keys, by `order`. Rows are dealt into ranges of (keys, order), so that a group of any size lies in several; each range numbers its own rows, and starts after those
    before it. (keys, order) must tell rows apart, or ties may fall either way."""
    ranged = cut(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))  # a row for each range that a group touches
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    starts = cut(sizes.select(*keys, "_range", before.alias("_before")))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(starts, [*keys, "_range"]).withColumn(number, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_before")


def statement_page(statements: DataFrame, page: int = 1, size: int = PAGE) -> DataFrame:
    """The first page * size statements of each topic with how many there are and whether more follow."""
    by_topic = Window.partitionBy("topic_id")
    ranked = statements.withColumn("rank", F.row_number().over(by_topic.orderBy("ord"))).withColumn("total", F.count("*").over(by_topic))
    return ranked.where(F.col("rank") <= page * size).withColumn("has_more", F.col("total") > page * size)


def remint_colliding_ids(added: DataFrame, existing: DataFrame, key: str = "statement_id", within: tuple[str, ...] = (), order: str = "ord", parts: tuple[str, ...] | None = None) -> DataFrame:
    """Rows whose id exists, or came earlier in this pass by `order` (unique), get a new id from `parts` (the old id, the topic and the place, if not given); `reminted` marks them. Ids count within the columns `within`.
    Firsts are an aggregate and the ids that exist a join by key, both before the rows are touched."""
    keys = [*within, key]
    first = added.groupBy(*keys).agg(F.min(order).alias(order))
    fresh = first.join(existing.select(*keys).distinct(), keys, "left_anti").select(order, F.lit(False).alias("reminted"))
    out = added.join(cut(fresh), order, "left").withColumn("reminted", F.coalesce("reminted", F.lit(True)))
    new = F.concat(F.lit("stmt_0809_version_"), F.substring(F.sha2(F.concat_ws("\u001f", *[F.col(c).cast("string") for c in parts or (key, "topic_id", order)]), 256), 1, 20))
    return out.withColumn(key, F.when(F.col("reminted"), new).otherwise(F.col(key)))


def sibling_collisions(topics: DataFrame) -> DataFrame:
    """Topics under one parent with equal casefolded titles; white space counts."""
    keyed = topics.withColumn("title_key", casefold(F.coalesce("title", F.lit(""))))
    return keyed.withColumn("n", F.count("*").over(Window.partitionBy("domain_id", "parent_topic_id", "title_key"))).where("n > 1")


def publish_order(domains: DataFrame, anchor: str, after: list[str]) -> DataFrame:
    """domains(domain_id, rank) with their place: named ones directly after an anchor, in their order."""
    moved = F.array_position(F.array(*map(F.lit, after)), F.col("domain_id"))
    at = domains.where(F.col("domain_id") == anchor).agg(F.max("rank").alias("anchor"))
    key = F.when(moved > 0, F.struct(F.col("anchor").alias("r"), moved.alias("k"))).otherwise(F.struct(F.col("rank").alias("r"), F.lit(0).cast("bigint").alias("k")))
    placed = domains.join(F.broadcast(at)).withColumn("_key", key)  # one row
    return placed.withColumn("place", F.row_number().over(Window.orderBy("_key"))).select("domain_id", "place")


def top_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def union_layers(seed: DataFrame, layers: dict[str, DataFrame], seed_count: int, part: str) -> DataFrame:
    """Layers with a label each; of the first, rows before seed_count are the seed. Kept are records whose node's upper case starts with the part."""
    first = seed.withColumn("layer", F.when(F.col("ord") < seed_count, "seed").otherwise("current"))
    rest = [df.withColumn("layer", F.lit(name)) for name, df in layers.items()]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [first, *rest])
    return both.where(F.startswith(F.upper("source_node_id"), F.lit(part)))


def coverage_diff(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Keys that one side lacks, with the side that has them."""
    missing = expected.select(*keys).distinct().join(found.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("missing"))
    return missing.union(found.select(*keys).distinct().join(expected.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("extra")))
