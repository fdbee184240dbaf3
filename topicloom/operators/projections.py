"""Row-local projections of statements: canonical form, hints, cards, sources, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import clean_values, fingerprint, first_non_empty, in_subtree, stable_id
from topicloom.operators.aggregates import BASE, regenerated

# What marks a boundary note as a failure, and rate classes that aren't shown.
FAILURE = r"failure|not guaranteed|counterexample|diverg"
NO_RATE = ("", "none", "not applicable")


def has_body(title: str = "title", latex: str = "latex", plain: str = "plain") -> Column:
    return first_non_empty(F.col(title)).isNotNull() & first_non_empty(F.col(latex), F.col(plain)).isNotNull()


def strip_regenerated(statements: DataFrame) -> DataFrame:
    return statements.where(~regenerated())


#: List fields of a statement that are empty where they are missing, with their types.
LISTS = {"assumptions_latex": "array<string>", "notation": "array<struct<symbol_latex:string,meaning:string>>", "prerequisite_node_ids": "array<string>", "review_flags": "array<string>"}
SOURCES = "array<struct<source:string,source_title:string,locator:string>>"


def _field(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def normalize_statement(statements: DataFrame) -> DataFrame:
    """The canonical statement: id (from the fingerprint where there is none), default title, the topic it is mapped to, witnesses (references where there are none, each titled by its source), list and
    flag defaults; metadata (stage, source path and what `context` adds) only for the intermediate layer. Columns that the input lacks count as missing."""
    is_base = F.col("layer_role").eqNullSafe(BASE)
    minted = stable_id("stmt_", fingerprint(F.col("topic_id"), F.col("title"), F.col("latex"), F.col("plain")))
    witnesses, refs = _field(statements, "source_witnesses", SOURCES), _field(statements, "source_refs", SOURCES)
    found = F.coalesce(F.when(F.size(witnesses) > 0, witnesses), refs, F.array().cast(SOURCES))
    titled = F.transform(found, lambda w: w.withField("source_title", F.coalesce(w["source_title"], w["source"])))
    own = F.create_map(F.lit("stage"), F.col("stage"), F.lit("source_path"), F.coalesce(_field(statements, "source_path", "string"), F.lit("")))
    context = F.coalesce(_field(statements, "context", "map<string,string>"), F.create_map().cast("map<string,string>"))
    metadata = F.map_concat(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(context), k)), context)
    return statements.select(
        F.coalesce(first_non_empty(F.col("statement_id")), minted).alias("id"), F.lit("knowledge_statement").alias("node_type"), first_non_empty(F.col("title"), default="Untitled statement").alias("title"),
        "topic_id", F.col("topic_id").alias("original_topic_id"), F.array("topic_id").alias("mapped_topic_ids"), F.lit("exact_topic_id").alias("mapping_method"),
        first_non_empty(F.col("layer_role"), default="intermediate_statement_layer").alias("layer_role"), first_non_empty(F.col("content_kind"), default="unknown").alias("content_kind"),
        first_non_empty(F.col("latex"), default="").alias("latex"), first_non_empty(F.col("plain"), default="").alias("plain"), titled.alias("source_witnesses"),
        *[F.coalesce(_field(statements, n, t), F.array().cast(t)).alias(n) for n, t in LISTS.items()], F.coalesce(_field(statements, "proof_included", "boolean"), F.lit(False)).alias("proof_included"),
        F.when(~is_base, metadata).alias("metadata"), "ord",
    )


def classify_convergence(notes: Column, rate: Column, bound: Column) -> Column:
    """failure_boundary by its notes, complexity_bound with a rate or bound, else theorem."""
    has_rate = ~F.lower(F.coalesce(rate, F.lit(""))).isin("", "none")
    return F.when(F.lower(F.array_join(notes, " ")).rlike(FAILURE), "failure_boundary").when(has_rate | first_non_empty(bound).isNotNull(), "complexity_bound").otherwise("theorem")


def placement_hints(fields: dict[str, Column], affected: Column) -> Column:
    """Ordered (method, hint) structs of arrays of ids without blanks; the one affected node counts only if there is no other hint and it is the only one."""

    def named(method: str, values: Column) -> Column:
        return F.transform(clean_values(values), lambda x: F.struct(F.lit(method).alias("method"), F.trim(x).alias("hint")))

    hints, single = F.concat(*[named(m, v) for m, v in fields.items()]), named("campaign_single_affected_node", affected)
    return F.when((F.size(hints) == 0) & (F.size(single) == 1), single).otherwise(hints)


def renumber(topics: DataFrame, old: str, new: str, shift: int) -> DataFrame:
    """Display numbers under a prefix, by whole segments, get another; depths move, not below 0."""
    inside = in_subtree(F.col("number"), old)
    return topics.withColumn("depth", F.when(inside, F.greatest(F.lit(0), F.col("depth") + shift)).otherwise(F.col("depth"))).withColumn("number", F.when(inside, F.concat(F.lit(new), F.substring("number", len(old) + 1, 1_000_000))).otherwise(F.col("number")))


def statement_cards(statements: DataFrame) -> DataFrame:
    """What a card shows: title, conclusion and rate by fallback, up to three badges."""
    rate = F.when(~F.lower(F.coalesce("rate", F.lit(""))).isin(*NO_RATE), F.col("rate"))
    badges = F.slice(F.filter(F.array(first_non_empty(F.col("content_kind")), rate, F.when(F.col("layer_role") == BASE, "base")), lambda x: x.isNotNull()), 1, 3)
    return statements.select("statement_id", first_non_empty(F.col("title"), F.col("statement_id")).alias("title"), first_non_empty(F.col("plain"), F.col("latex"), default="").alias("conclusion"), rate.alias("rate_class"), badges.alias("badges"))


def source_rows(statements: DataFrame, sources: str = "sources") -> DataFrame:
    """A row a source (source, source_title, locator, source_item_id, verified): title and locator by fallback, and a three-valued label."""
    each = statements.select("statement_id", F.explode(sources).alias("s"))
    label = F.when(F.col("s.verified"), "verified").when(~F.col("s.verified"), "not verified").otherwise("not recorded")
    return each.select("statement_id", first_non_empty(F.col("s.source_title"), F.col("s.source"), default="Source").alias("title"), first_non_empty(F.col("s.locator"), F.col("s.source_item_id"), default="").alias("locator"), label.alias("verified"))


def dimension_values(df: DataFrame, key: str, dimensions: str) -> DataFrame:
    """A map of lists as (key, dimension, value) rows without blanks."""
    return df.select(key, F.explode(dimensions).alias("dimension", "_v")).select(key, "dimension", F.explode(clean_values(F.col("_v"))).alias("value"))


def prerequisite_links(statements: DataFrame, owners: DataFrame, ids: str = "prerequisites") -> DataFrame:
    """(statement_id, node_id, domain_id): the domain that owns an id's first segment; null if none does."""
    each = statements.select("statement_id", F.explode(ids).alias("node_id")).withColumn("segment", F.substring_index("node_id", ".", 1))
    return each.join(owners, "segment", "left").select("statement_id", "node_id", "domain_id")


def knowledge_status(topics: DataFrame, counts: DataFrame) -> DataFrame:
    """has_statements, has_children or leaf."""
    parents = topics.where("parent_topic_id is not null").select(F.col("parent_topic_id").alias("topic_id")).distinct().withColumn("_up", F.lit(True))
    label = F.when(F.col("statements") > 0, "has_statements").when(F.col("_up"), "has_children").otherwise("leaf")
    return topics.select("topic_id").join(counts.select("topic_id", "statements"), "topic_id", "left").join(parents, "topic_id", "left").select("topic_id", label.alias("status"))
