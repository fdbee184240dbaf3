"""Rollups, statistics and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import first_non_empty
from topicloom.operators.windows import numbered
from topicloom.session import cut

BASE = "base_statement_layer"
# The stages whose proposals count.
SUPPORTED = ("0809_campaign_reviewed", "0809_campaign_published")
COUNTS = ("statements", "base", "intermediate")
#: Records of one batch of the order-independent hash.
BATCH = 4096


def direct_counts(topics: DataFrame, statements: DataFrame) -> DataFrame:
    """(topic_id, statements, base, intermediate) for every topic; summed before the join."""
    is_base = F.col("layer_role").eqNullSafe(BASE)
    own = statements.groupBy("topic_id").agg(F.count("*").alias("statements"), F.count_if(is_base).alias("base"), F.count_if(~is_base).alias("intermediate"))
    return topics.select("topic_id").join(own, "topic_id", "left").fillna(0, list(COUNTS))


def subtree_rollup(topics: DataFrame, statements: DataFrame) -> DataFrame:
    """The same counts over each topic's subtree, and how many topics that has. Records are counted by topic; then, from the deepest level (`depth` is the distance from the root) up,
    the sums of children are added to their parents, so that rows shrink by level and each is cut off from those below."""
    sums = [*COUNTS, "topics"]
    own = cut(topics.select("topic_id", "parent_topic_id", "depth").join(direct_counts(topics, statements), "topic_id").withColumn("topics", F.lit(1).cast("long")))
    levels: list[DataFrame] = []
    for depth in range(own.agg(F.max("depth")).first()[0] or 0, -1, -1):
        level = own.where(F.col("depth") == depth)
        if levels:
            below = levels[-1].groupBy(F.col("parent_topic_id").alias("topic_id")).agg(*[F.sum(c).alias(f"{c}_below") for c in sums])
            level = level.join(below, "topic_id", "left").select("topic_id", "parent_topic_id", *[(F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in sums])
            level = cut(level) if depth else level
        levels.append(level.select("topic_id", "parent_topic_id", *sums))
    return reduce(DataFrame.union, levels).select("topic_id", *sums)


def content_kind_counts(statements: DataFrame, by: str = "topic_id") -> DataFrame:
    """(by, kinds): a map from kind to count, sorted by kind; missing and empty kinds are 'unknown'."""
    each = statements.groupBy(by, first_non_empty(F.col("content_kind"), default="unknown").alias("kind")).agg(F.count("*").alias("n"))
    return each.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))


def domain_stats(topics: DataFrame, statements: DataFrame) -> DataFrame:
    """A row a domain: topics, counts, leaves, covered share of leaves, greatest depth, kinds."""
    parents = topics.where("parent_topic_id is not null").select(F.col("parent_topic_id").alias("topic_id"), F.lit(False).alias("leaf")).distinct()
    each = topics.join(direct_counts(topics, statements), "topic_id").join(parents, "topic_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(True)))
    covered = F.count_if(F.col("leaf") & (F.col("statements") > 0))
    out = each.groupBy("domain_id").agg(
        F.count("*").alias("topics"), *[F.sum(c).alias(c) for c in COUNTS], F.count_if("leaf").alias("leaf_topics"),
        F.when(F.count_if("leaf") > 0, covered / F.count_if("leaf")).otherwise(0.0).alias("coverage"), F.max("depth").alias("max_depth"),
    )
    kinds = content_kind_counts(statements.join(topics.select("topic_id", "domain_id"), "topic_id"), "domain_id")
    return out.join(kinds, "domain_id", "left")


def chapter_summaries(topics: DataFrame, statements: DataFrame) -> DataFrame:
    rolled = subtree_rollup(topics, statements).select("topic_id", F.col("topics").alias("subtree_topic_count"), F.col("statements").alias("subtree_statement_count"))
    return topics.where("depth = 1").select("topic_id", "title", "axis").join(rolled, "topic_id")


def subject_stats(subjects: DataFrame, shortcuts: DataFrame, stats: DataFrame) -> DataFrame:
    """subjects(subject_id, items) with the number of items and sums over the distinct domains they resolve to; shortcuts(item, domain_id) go to their owners."""
    items = subjects.select("subject_id", F.explode_outer("items").alias("item")).join(shortcuts, "item", "left").withColumn("domain_id", F.coalesce("domain_id", "item"))
    sums = items.select("subject_id", "domain_id").distinct().join(stats.select("domain_id", "topics", "statements"), "domain_id", "left")
    sums = sums.groupBy("subject_id").agg(F.coalesce(F.sum("topics"), F.lit(0)).alias("topics"), F.coalesce(F.sum("statements"), F.lit(0)).alias("statements"))
    return subjects.select("subject_id", F.size("items").cast("long").alias("collections")).join(sums, "subject_id")


def manifest_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.sum("topics").alias("topics"), F.sum("statements").alias("statements"))


def placement_report(placed: DataFrame) -> DataFrame:
    """placed(domain_id, stage, mapping_method, reason) counted by each column on its own in one pass; a reason marks quarantined rows."""
    long = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in (("domain", "domain_id"), ("stage", "stage"), ("method", "mapping_method"), ("reason", "reason"))]))
    state = F.when(F.col("reason").isNull(), "added").otherwise("quarantined")
    return placed.groupBy("domain_id", "stage", "mapping_method", "reason").agg(F.count("*").alias("n")).select(state.alias("state"), "n", long.alias("d")).groupBy("state", "d.dimension", "d.value").agg(F.sum("n").alias("n")).where("value is not null")


def modal_value(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most common non-empty value of each group, the first seen on ties; '' if there is none."""
    counts = df.where(F.coalesce(F.trim(value), F.lit("")) != "").groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), "first")).alias(value))
    return df.select(*keys).distinct().join(best, keys, "left").fillna("", [value])


GROUP = ["parent", "title_key"]


def cross_source_groups(proposals: DataFrame, least: int = 2) -> DataFrame:
    """proposals(parent, title_key, campaign, source_item_id, stage): (parent, title_key, campaigns, n_items) of the groups of reviewed or published ones from at least `least` campaigns. Items are counted; what they are says
    group_members(). Campaigns, of which there are as many as sources, are a sorted list."""
    open_ = proposals.where(F.col("stage").isin(*SUPPORTED))
    by_campaign = open_.groupBy(*GROUP, "campaign").agg(F.count("*").alias("n"))
    groups = by_campaign.groupBy(*GROUP).agg(F.array_sort(F.collect_list("campaign")).alias("campaigns")).where(F.size("campaigns") >= least)
    items = open_.select(*GROUP, "source_item_id").distinct().groupBy(*GROUP).agg(F.count("*").alias("n_items"))
    return groups.join(items, GROUP)


def group_members(proposals: DataFrame, groups: DataFrame) -> DataFrame:
    """(parent, title_key, source_item_id, number): the distinct items of each group, a row each, numbered in their order."""
    open_ = proposals.where(F.col("stage").isin(*SUPPORTED)).select(*GROUP, "source_item_id").distinct()
    return numbered(open_.join(groups.select(*GROUP), GROUP, "left_semi"), GROUP, ["source_item_id"])


def witness_dedup(rows: DataFrame, keys: list[str], order: str = "ord", groups: DataFrame | None = None) -> DataFrame:
    """Distinct (campaign, locator) of each group, or of those in `groups`, numbered (`pos`) in the order they were first seen. Rows are counted together before they meet the groups."""
    first = rows.groupBy(*keys, "campaign", "locator").agg(F.min(order).alias("at"))
    first = first if groups is None else first.join(groups.select(*keys), keys, "left_semi")
    return numbered(first, keys, ["at", "campaign", "locator"], "pos").withColumn("pos", F.col("pos").cast("int"))


def regenerated(stage: str = "stage"):
    """Whether a statement comes from a stage that is made anew."""
    return F.coalesce(F.startswith(F.col(stage), F.lit("0809_campaign_")) | F.col(stage).isin("convergence_fast_candidate_unreviewed", "convergence_partial_fast_candidate_unreviewed"), F.lit(False))


def collect_preserved(topics: DataFrame, statements: DataFrame, excluded: list[str]) -> DataFrame:
    """A previous snapshot by topic, without excluded domains: first title, preserved and regenerated statements."""
    t = topics.where(~F.col("domain_id").isin(excluded))
    s = statements.groupBy("topic_id").agg(F.count_if(~regenerated()).alias("preserved"), F.count_if(regenerated()).alias("regenerated"))
    return t.groupBy("topic_id").agg(F.min_by("title", F.struct("domain_id", "pos")).alias("title")).join(s, "topic_id", "left").fillna(0, ["preserved", "regenerated"])


def preserved_statements(topics: DataFrame, statements: DataFrame, excluded: list[str]) -> DataFrame:
    """The statements of a previous snapshot that are kept: not made anew, and of a topic of a domain that isn't excluded. A topic that occurs in several domains keeps its statements once."""
    known = topics.where(~F.col("domain_id").isin(excluded)).select("topic_id")
    return statements.where(~regenerated()).join(known, "topic_id", "left_semi")


def preserved_report(topics: DataFrame, statements: DataFrame, excluded: list[str]) -> DataFrame:
    """One row on a previous snapshot: its domains, topics and kept statements, the statements left out by kind of stage, and how often a topic occurs again."""
    t = topics.where(~F.col("domain_id").isin(excluded))
    mine = statements.join(t.select("topic_id"), "topic_id", "left_semi")
    campaign = F.coalesce(F.startswith("stage", F.lit("0809_campaign_")), F.lit(False))
    of_topics = t.groupBy("topic_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("topics"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_topic_occurrences"))
    counts = mine.agg(F.count_if(~regenerated()).alias("statements"), F.count_if(campaign).alias("excluded_campaign_statements"), F.count_if(regenerated() & ~campaign).alias("excluded_convergence_candidates"))
    return t.agg(F.countDistinct("domain_id").alias("domains")).join(of_topics).join(counts)  # one row each


def layer_report(layers: DataFrame) -> DataFrame:
    """Sums of the counters of several merged layers, and how many were partial."""
    counters = [c for c, t in layers.dtypes if t in ("bigint", "int")]
    return layers.agg(F.count("*").alias("layer_count"), F.count_if("partial_run").alias("partial_layer_count"), *[F.sum(c).cast("long").alias(c) for c in counters])


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def protected_hash(records: DataFrame, editable: str, batch: int = BATCH) -> DataFrame:
    """An order-independent SHA-256 of all records without one field: records are hashed and dealt by hash into a power of two of batches of about `batch`; sorted hashes of a
    batch are hashed, and so on over batches until one is left. No task sorts more than a batch or so; equal tables give equal hashes."""
    rows = cut(records.select(F.sha2(F.to_json(F.struct(*[c for c in records.columns if c != editable])), 256).alias("h")))
    bits = max(0, (-(-rows.count() // batch) - 1).bit_length())
    at = rows.withColumn("b", F.shiftrightunsigned(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), 32 - bits))
    step = batch.bit_length() - 1
    while True:
        at = at.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
        if not bits:
            break
        at, bits = at.select((F.shiftrightunsigned("b", min(bits, step))).alias("b"), "h"), max(0, bits - step)
    return at.agg(F.max("h").alias("protected_hash"))


def issue_counts(issues: DataFrame, events: DataFrame) -> DataFrame:
    """One row: issues in all, not resolved, resolved, and events."""
    both = issues.select(F.lit(True).alias("issue"), "status").union(events.select(F.lit(False), F.lit(None).cast("string")))
    done = F.col("status").eqNullSafe("resolved")
    return both.agg(F.count_if("issue").alias("total"), F.count_if(F.col("issue") & ~done).alias("open"), F.count_if(F.col("issue") & done).alias("resolved"), F.count_if(~F.col("issue")).alias("history_events"))
