"""Snapshot checks: each gives rows (code, failed_count, sample), and a report collects the failing codes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import in_subtree
from topicloom.operators.aggregates import protected_hash
from topicloom.operators.windows import coverage_diff, sibling_collisions


def failures(df: DataFrame, code: str, sample: str) -> DataFrame:
    """One row for the failing rows of a check; the sample is the least of them."""
    return df.agg(F.lit(code).alias("code"), F.count("*").alias("failed_count"), F.min(F.col(sample).cast("string")).alias("sample"))


#: JSON fields that a card reads as lists or objects; the latter four only where a statement has them.
LISTS, OBJECTS = ("assumptions_latex", "source_refs", "boundary_notes", "relations"), ("conclusion", "variant_dimensions")


def render_contract(statements: DataFrame) -> DataFrame:
    """Rows a card can't show, by reason: no title, no body, or a field (raw JSON, where the table has it) that isn't the list or object it must be; a missing field is no failure."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    kinds = {c: k for k, cs in (("ARRAY", LISTS), ("OBJECT", OBJECTS)) for c in cs if dict(statements.dtypes).get(c) == "string"}
    wrong = lambda c, k: ~F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(c)), F.lit(k)), F.lit(False)) & F.col(c).isNotNull()
    typed = [F.when(wrong(c, k), f"{c}_is_no_{'list' if k == 'ARRAY' else 'object'}") for c, k in kinds.items()]
    reasons = F.filter(F.array(F.when(empty("title"), "missing_title"), F.when(empty("latex") & empty("plain"), "missing_body"), *typed), lambda x: x.isNotNull())
    return statements.select("statement_id", F.explode(reasons).alias("reason"))


def public_allowlist(public: DataFrame, allowed: DataFrame) -> DataFrame:
    """Public rows whose (stage, mapping_method) isn't allowed."""
    return public.join(allowed.select("stage", "mapping_method"), ["stage", "mapping_method"], "left_anti")


def accounting(split: DataFrame, declared: dict[str, int] | None = None, layers: DataFrame | None = None) -> DataFrame:
    """One row: candidates = public + quarantined + duplicate titles; which of the declared counts differ from the computed ones; and of layers(declared_records, records, partial_run, declared_partial) how many
    declare another number of records or another kind of run."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = split.agg(F.count("*").alias("candidates"), n("public").alias("public"), n("quarantined").alias("quarantined"), n("duplicate_title").alias("duplicates"))
    out = out.withColumn("balanced", F.col("candidates") == F.col("public") + F.col("quarantined") + F.col("duplicates"))
    if declared is not None:
        wrong = F.filter(F.array(*[F.when(~F.col(k).eqNullSafe(F.lit(v)), k) for k, v in sorted(declared.items())]), lambda x: x.isNotNull())
        out = out.withColumn("misdeclared", F.array_join(wrong, ","))
    if layers is not None:
        bad = ~F.col("declared_records").eqNullSafe(F.col("records")) | ~F.col("declared_partial").eqNullSafe(F.col("partial_run"))
        out = out.join(layers.agg(F.count("*").alias("layers"), F.count_if("partial_run").alias("partial_layers"), F.count_if(bad).alias("misdeclared_layers")))  # one row each
    return out


def stats_stale(declared: DataFrame, computed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, declared, computed) where they differ or one side has no row."""
    fields = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("long").alias(name)) for c in columns])).alias("x")).select(key, "x.*")
    both = fields(declared, "declared").join(fields(computed, "computed"), [key, "field"], "full")
    return both.where(~F.col("declared").eqNullSafe(F.col("computed")))


def structure(
    topics: DataFrame, promoted: dict[str, str] | None = None, moved: dict[str, str] | None = None, parents: dict[str, str] | None = None, titles: dict[str, str] | None = None,
    sizes: dict[str, int] | None = None, routes: DataFrame | None = None,
) -> DataFrame:
    """Codes for repeated ids, missing parents and domains without exactly one root; and, where they are given, for promoted roots (id: domain) that aren't roots of it, moved roots (id: old domain) still in it,
    other parents or titles than expected (id: value), subtrees of another size (root: topics), and routes(topic_id, chapter_id) whose ends aren't topics."""
    ids = topics.groupBy("topic_id").count().where("count > 1")
    lost = topics.where("parent_topic_id is not null").join(topics.select(F.col("topic_id").alias("parent_topic_id")), "parent_topic_id", "left_anti")
    roots = topics.groupBy("domain_id").agg(F.count_if(F.col("parent_topic_id").isNull()).alias("roots")).where("roots <> 1")
    out = [failures(ids, "duplicate_topic_id", "topic_id"), failures(lost, "missing_parent", "topic_id"), failures(roots, "root_count", "domain_id")]

    def expected(values: dict, good: Callable[[Column], Column], code: str) -> None:
        """Each named topic must have a row that is good; a few names, so they are literals."""
        want = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("topic_id"))
        named = topics.where(F.col("topic_id").isin(*values))
        fine = named.groupBy("topic_id").agg(F.bool_and(F.coalesce(good(want), F.lit(False))).alias("fine")).where("fine").select("topic_id")
        out.append(failures(topics.sparkSession.createDataFrame([(k,) for k in values], "topic_id string").join(fine, "topic_id", "left_anti"), code, "topic_id"))

    if promoted:
        expected(promoted, lambda w: F.col("parent_topic_id").isNull() & (F.col("depth") == 0) & (F.col("domain_id") == w), "promoted_root")
    if moved:
        expected(moved, lambda w: F.col("domain_id") != w, "moved_root_in_old_domain")
    if parents:
        expected(parents, lambda w: F.col("parent_topic_id") == w, "unexpected_parent")
    if titles:
        expected(titles, lambda w: F.col("title") == w, "unexpected_title")
    for root, size in (sizes or {}).items():
        n = topics.where(in_subtree(F.col("topic_id"), root)).agg(F.count("*").alias("n")).where(F.col("n") != size)
        out.append(failures(n.select(F.lit(root).alias("topic_id")), "subtree_size", "topic_id"))
    if routes is not None:
        ends = routes.select("topic_id").union(routes.select("chapter_id")).distinct()
        out.append(failures(ends.join(topics.select("topic_id"), "topic_id", "left_anti"), "route_target", "topic_id"))
    return reduce(DataFrame.union, out)


def forbidden_text(topics: DataFrame, phrases: list[str], column: str = "title") -> DataFrame:
    found = reduce(lambda a, b: a | b, [F.contains(F.lower(column), F.lit(p.lower())) for p in phrases])
    return topics.where(found)


def stale_placement(attached: DataFrame, aliases: DataFrame, inside: Column) -> DataFrame:
    """Statements still attached through an aliased node, or by nearest ancestor inside the revised subtree."""
    through = attached.join(aliases.select("source_node_id", F.lit(True).alias("_alias")), "source_node_id", "left")
    code = F.when(F.col("_alias"), "aliased_node").when((F.col("mapping_method") == "nearest_canonical_ancestor") & inside, "ancestor_in_revision")
    return through.withColumn("code", code).where("code is not null").drop("_alias")


def rename_validate(workbook: DataFrame, exported: DataFrame, live: DataFrame, record_count: int | None = None, digest: str | None = None) -> DataFrame:
    """The workbook's checks: as many records as declared, unique ids, nothing but new titles changed (by protected_hash, where a digest is declared), new titles not empty, trimmed and of one line, exact coverage, live titles either old or new, no collisions among siblings."""
    new = F.coalesce("new_title", F.lit(""))
    renamed = workbook.where("topic_id is not null").select("domain_id", "parent_topic_id", "topic_id", F.col("new_title").alias("title"))
    drift = workbook.join(live.select("topic_id", F.col("title").alias("live")), "topic_id").where("not (live <=> current_title or live <=> new_title)")
    one = lambda df: df.select(F.lit("workbook").alias("stable_id"))
    checks = {
        "duplicate_id": workbook.groupBy("stable_id").count().where("count > 1"),
        "empty_title": workbook.where(F.trim(new) == ""),
        "untrimmed_title": workbook.where(F.trim(new) != new),
        "multiline_title": workbook.where(new.rlike(r"[\r\n]")),
        "coverage": coverage_diff(exported, workbook, "stable_id"),
        "title_drift": drift.select("stable_id"),
        "sibling_collision": sibling_collisions(renamed).select(F.col("topic_id").alias("stable_id")),
    }
    if record_count is not None:
        checks["record_count"] = one(workbook.agg(F.count("*").alias("n")).where(F.col("n") != record_count))
    if digest is not None:
        checks["protected_hash"] = one(protected_hash(workbook, "new_title").where(F.col("protected_hash") != digest))
    return reduce(DataFrame.union, [failures(df, code, "stable_id") for code, df in checks.items()])


def report(checks: DataFrame) -> DataFrame:
    """One row: PASS if no check failed, the failing codes and how many rows they have."""
    bad = F.col("failed_count") > 0
    return checks.agg(F.when(F.count_if(bad) == 0, "PASS").otherwise("FAIL").alias("status"), F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("code")))), ",").alias("failing_codes"), F.sum("failed_count").alias("failed_rows"))
