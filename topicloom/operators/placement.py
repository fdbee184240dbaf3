"""Joins that attach records to topics, redirect ids and resolve routes. No side is broadcast by hint: Spark broadcasts what it knows to be small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import first_non_empty, id_prefixes, in_subtree, normalize_text
from topicloom.session import cut, stored


def attach_exact(records: DataFrame, topics: DataFrame, node: str = "source_node_id") -> DataFrame:
    """Records whose node is a topic, with its topic_id."""
    return records.join(topics.select("topic_id"), F.col(node) == F.col("topic_id"))


def nearest_topics(nodes: DataFrame, topics: DataFrame, node: str = "source_node_id") -> DataFrame:
    """(node, topic_id) of every distinct node that is a topic or has an id prefix that is one, the longest. A node climbs its prefixes once, whatever the number of records that name it. Written, so that what joins it is
    a join of two plain sides, which Spark can split where one node has many records."""
    each = nodes.where(F.col(node).isNotNull()).select(node).distinct()
    chain = each.select(node, F.posexplode(id_prefixes(F.col(node))).alias("length", "topic_id"))
    return stored(chain.join(topics.select("topic_id"), "topic_id", "left_semi").groupBy(node).agg(F.max_by("topic_id", "length").alias("topic_id")), "nearest")


def attach_nearest(records: DataFrame, topics: DataFrame, node: str = "source_node_id") -> DataFrame:
    """Records with topic_id, the topic of their node or else its longest id prefix that is one, and the mapping method; null where no prefix is."""
    found = records.join(nearest_topics(records, topics, node), node, "left")
    method = F.when(F.col("topic_id") == F.col(node), "exact_topic_id").when(F.col("topic_id").isNotNull(), "nearest_canonical_ancestor")
    return found.withColumn("mapping_method", method)


def alias_redirect(records: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Replace an id by its alias target."""
    to = aliases.select(F.col("source_node_id").alias("_from"), F.col("target_node_id").alias("_to"))
    return records.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def alias_map(mappings: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """mappings(source_node_id, primary_target_node_id, target_node_id, target_node_ids, ord) to one target a source: the first non-empty field; blanks and self-references go, the last row wins. With topics, a
    target of any row that isn't one of them is an error, raised when the rows are read, also where a later row wins."""
    target = first_non_empty(F.col("primary_target_node_id"), F.col("target_node_id"), F.try_element_at("target_node_ids", F.lit(1)))
    named = mappings.select("source_node_id", target.alias("target_node_id"), "ord").where("source_node_id <> '' and target_node_id is not null and source_node_id <> target_node_id")
    if topics is not None:
        known = topics.select(F.col("topic_id").alias("target_node_id"), F.lit(True).alias("_known")).distinct()
        what = F.concat(F.lit("alias target outside the tree: "), "source_node_id", F.lit(" -> "), "target_node_id")
        named = named.join(known, "target_node_id", "left").withColumn("target_node_id", F.when(F.col("_known"), F.col("target_node_id")).otherwise(F.raise_error(what).cast("string")))
    return named.groupBy("source_node_id").agg(F.max_by("target_node_id", "ord").alias("target_node_id"))


def resolve_route(routes: DataFrame, defaults: DataFrame, prefixes: DataFrame, aliases: DataFrame) -> DataFrame:
    """routes(key, domain_id, node_id): a legacy domain goes to its default, the longest matching prefix of the node moves the domain, and an alias of that domain moves the node. Prefixes are matched by the node's own chain of prefixes, so the join is by equality."""
    at = routes.join(defaults.select(F.col("legacy_domain_id").alias("_old"), "new_domain_id", "default_node_id"), F.col("domain_id") == F.col("_old"), "left")
    at = at.select("key", F.coalesce("new_domain_id", "domain_id").alias("domain_id"), first_non_empty(F.col("node_id"), F.col("default_node_id")).alias("node_id"))
    chain = at.where("node_id is not null").select("key", F.col("domain_id").alias("_d"), F.posexplode(id_prefixes(F.col("node_id"))).alias("_n", "_p"))
    moved = chain.join(prefixes.select(F.col("old_domain_id").alias("_d"), F.col("node_prefix").alias("_p"), F.col("domain_id").alias("_to")), ["_d", "_p"]).groupBy("key").agg(F.max_by("_to", "_n").alias("_to"))
    at = at.join(moved, "key", "left").select("key", F.coalesce("_to", "domain_id").alias("domain_id"), "node_id")
    to = aliases.select("domain_id", F.col("source_node_id").alias("node_id"), "target_node_id")
    return at.join(to, ["domain_id", "node_id"], "left").select("key", "domain_id", F.coalesce("target_node_id", "node_id").alias("node_id"))


def match_id_or_title(old: DataFrame, new: DataFrame) -> DataFrame:
    """old topics with new_topic_id: the same id, or the one new topic of the same normalised title, or null; roots are left out."""
    by_title = unique_titles(new)
    out = old.where("parent_topic_id is not null").select("topic_id", normalize_text(F.col("title")).alias("title_key"))
    out = out.join(new.select(F.col("topic_id").alias("same")), F.col("topic_id") == F.col("same"), "left").join(by_title, "title_key", "left")
    method = F.when(F.col("same").isNotNull(), "id").when(F.col("only_id").isNotNull(), "title").otherwise("unmapped")
    return out.select("topic_id", F.coalesce("same", "only_id").alias("new_topic_id"), method.alias("method"))


def unique_titles(topics: DataFrame, *within: str) -> DataFrame:
    """(within..., title_key, only_id) of titles that one topic has, over all topics or within other columns. Counted before any join, so that common titles don't gather rows."""
    keyed = topics.select(*within, normalize_text(F.col("title")).alias("title_key"), "topic_id").where("title_key <> ''")
    return keyed.groupBy(*within, "title_key").agg(F.count("*").alias("_n"), F.min("topic_id").alias("only_id")).where("_n = 1").drop("_n")


def unique_children(topics: DataFrame) -> DataFrame:
    """(parent, title_key, topic_id) of the direct children whose title no other child of the parent has."""
    return unique_titles(topics.where("parent_topic_id is not null"), "parent_topic_id").withColumnsRenamed({"parent_topic_id": "parent", "only_id": "topic_id"})


def match_child_title(proposals: DataFrame, topics: DataFrame) -> DataFrame:
    """proposals(parent, title_key, ...) with the topic_id of the one direct child of the parent that has the title."""
    return proposals.join(unique_children(topics), ["parent", "title_key"])


def match_title_same_part(proposals: DataFrame, topics: DataFrame) -> DataFrame:
    """proposals(parent, title_key, ...) with the topic whose title is unique among all topics, if it is in the parent's part."""
    part = lambda c: F.substring_index(c, ".", 1)
    return proposals.join(unique_titles(topics), "title_key").where(part("parent") == part("only_id")).withColumnRenamed("only_id", "topic_id")


def with_live_parent(proposals: DataFrame, topics: DataFrame, aliases: DataFrame, parents: str = "parents") -> DataFrame:
    """proposals with `parent`, the first of a list of parents that is a topic, after aliases; those without one are left out. Each distinct list is resolved once; the small table is stored, so that Spark knows whether to send it to the rows."""
    lists = proposals.select(F.col(parents).alias("_list")).where(F.size("_list") > 0).distinct()
    each = alias_redirect(lists.select("_list", F.posexplode("_list").alias("pos", "parent")), aliases, "parent")
    found = stored(each.join(topics.select(F.col("topic_id").alias("parent")), "parent", "left_semi").groupBy("_list").agg(F.min_by("parent", "pos").alias("parent")), "parents")
    return proposals.withColumn("_list", F.col(parents)).join(found, "_list").select(*proposals.columns, "parent")


def live_parent(proposals: DataFrame, topics: DataFrame, aliases: DataFrame, key: str = "ord", parents: str = "parents") -> DataFrame:
    """(key, parent) of with_live_parent()."""
    return with_live_parent(proposals.select(key, parents), topics, aliases, parents).select(key, "parent")


def orphans(targets: DataFrame, topics: DataFrame, column: str) -> DataFrame:
    """Rows whose target isn't a topic."""
    return targets.join(topics.select(F.col("topic_id").alias(column)), column, "left_anti")


def topic_relations(topics: DataFrame) -> DataFrame:
    """(topic_id, relation, other_id, title): the parent card and the child cards of each topic."""
    up = topics.alias("t").join(topics.alias("o"), F.expr("t.parent_topic_id = o.topic_id"))
    return up.selectExpr("t.topic_id", "'parent' as relation", "o.topic_id as other_id", "o.title").union(up.selectExpr("o.topic_id", "'child'", "t.topic_id", "t.title"))


def ancestors(topics: DataFrame) -> DataFrame:
    """(topic_id, ancestor_id, distance) by the tree, self included. One join a level, cut off from those before; the number of levels is the tree's depth."""
    parents = topics.select(F.col("topic_id").alias("ancestor_id"), F.col("parent_topic_id").alias("up"))
    levels = [topics.select("topic_id", F.col("topic_id").alias("ancestor_id"), F.lit(0).alias("distance"))]
    for n in range(1, (topics.agg(F.max("depth")).first()[0] or 0) + 1):
        up = topics.select("topic_id", F.col("parent_topic_id").alias("up")) if n == 1 else levels[-1].join(parents, "ancestor_id").select("topic_id", "up")
        level = up.where("up is not null").select("topic_id", F.col("up").alias("ancestor_id"), F.lit(n).alias("distance"))
        levels.append(cut(level) if n > 1 else level)
    return reduce(DataFrame.union, levels)


def breadcrumbs(topics: DataFrame) -> DataFrame:
    """(topic_id, path): titles from the root to the topic."""
    titled = ancestors(topics).join(topics.select(F.col("topic_id").alias("ancestor_id"), "title"), "ancestor_id")
    return titled.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("at"), "title"))).alias("p")).select("topic_id", F.col("p.title").alias("path"))


def subject_of_domain(domains: DataFrame, subjects: DataFrame) -> DataFrame:
    """(domain_id, subject_id): the first subject (by pos) whose items contain the domain; null if none does."""
    items = subjects.select("subject_id", "pos", F.explode("items").alias("domain_id"))
    return domains.select("domain_id").join(items, "domain_id", "left").groupBy("domain_id").agg(F.min_by("subject_id", "pos").alias("subject_id"))


def subtree(topics: DataFrame, root: str) -> DataFrame:
    return topics.where(in_subtree(F.col("topic_id"), root))


def first_by(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each group; groups are windows over the keys alone."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
