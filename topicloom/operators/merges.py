"""Merge jobs: layers, previous snapshots, candidates, subtree moves and renames. Each is a composition of the joins and windows beside it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import container_id, first_non_empty, in_subtree, item_id, non_empty, normalize_text
from topicloom.operators.aggregates import BASE, GROUP, SUPPORTED, cross_source_groups, modal_value, regenerated, witness_dedup
from topicloom.operators.placement import alias_redirect, attach_nearest, match_child_title, match_id_or_title, match_title_same_part, nearest_topics, subtree, unique_children, with_live_parent
from topicloom.operators.projections import classify_convergence, normalize_statement, placement_hints
from topicloom.operators.windows import best_stage, dedupe_best, dedupe_first, remint_colliding_ids
from topicloom.session import cut, discard, slices, stored
from topicloom.sources.catalog import EVIDENCE

# Which placement makes a candidate of a stage public, and what a convergence layer may call itself.
_BOTH = ("campaign_existing_node", "explicit_node_alias", "campaign_exact_sibling_title", "campaign_cross_source_candidate_container", "campaign_unique_same_part_title")
ALLOWED = {"0809_campaign_published": _BOTH, "0809_campaign_reviewed": (*_BOTH, "campaign_preferred_home")}
LAYER_STATUS = ("SHADOW_FAST_CANDIDATE_UNREVIEWED", "SHADOW_PARTIAL_FAST_CANDIDATE_UNREVIEWED")
CONTAINER_AXIS = "textbook_candidate_topic"


def collect_statements(layers: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layers attached, first-wins deduplicated and normalised; and one row of eight counters."""
    ranked = cut(dedupe_first(attach_nearest(layers, topics)))
    placed, first, is_base = F.col("topic_id").isNotNull(), F.col("rn") == 1, F.col("layer_role").eqNullSafe(BASE)
    counters = {
        "records": F.lit(True), "unmapped": ~placed, "ancestor_mapped": F.col("mapping_method") == "nearest_canonical_ancestor", "attached": placed & first, "base": placed & first & is_base,
        "intermediate": placed & first & ~is_base, "duplicate_base": placed & ~first & is_base, "duplicate_intermediate": placed & ~first & ~is_base,
    }
    return normalize_statement(ranked.where(placed & first)), ranked.agg(*[F.count_if(c).alias(n) for n, c in counters.items()])


def with_title_key(rows: DataFrame) -> DataFrame:
    return rows if "title_key" in rows.columns else rows.withColumn("title_key", normalize_text(F.col("title")))


def without_titles(added: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose topic has no statement of their title yet; untitled rows stay."""
    held = with_title_key(existing).select("topic_id", "title_key").where("title_key <> ''")
    return with_title_key(added).join(held, ["topic_id", "title_key"], "left_anti")


def own_title(order: str = "ord") -> Column:
    """The title key; rows without one are each their own, by `order`, which is unique."""
    return F.when(F.col("title_key") != "", F.concat(F.lit("t"), "title_key")).otherwise(F.concat(F.lit("o"), F.col(order).cast("string")))


def first_titles(rows: DataFrame, order: str = "ord") -> DataFrame:
    """The first of rows(topic_id, title_key) of each topic and title."""
    keyed = rows.select("topic_id", own_title(order).alias("_key"), order, F.struct(*rows.columns).alias("_row"))
    return keyed.groupBy("topic_id", "_key").agg(F.min_by("_row", order).alias("_row")).select("_row.*")


#: Undecided rows that one task finishes by itself.
LOOP_ROWS = 10_000


def accepted(rows: DataFrame, first: str, second: str, order: str = "ord", loop_rows: int = LOOP_ROWS) -> DataFrame:
    """(order) of the rows that are taken if all are looked at by `order` (unique), and each is taken unless one taken before has its first or its second key. A row that isn't taken holds neither key.

    In rounds: rows that are the first undecided ones of both of their keys are taken, and what shares a key with them is dropped; a row can only be beaten by one before it, so this is what a loop would do. Firsts are
    aggregates, and the drops are joins of plain sides. The last undecided rows, a bounded number, are looped over in one task."""
    left, taken = cut(rows.select(order, first, second)), []
    while left.limit(loop_rows + 1).count() > loop_rows:
        leads = [left.groupBy(k).agg(F.min(order).alias(order)).select(order) for k in (first, second)]
        now = cut(left.join(leads[0], order, "left_semi").join(leads[1], order, "left_semi"))
        taken.append(now.select(order))
        left = cut(left.join(now.select(first), first, "left_anti").join(now.select(second), second, "left_anti"))

    def loop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[set, set] = (set(), set())
        for pdf in batches:
            keep = []
            for at, (a, b) in enumerate(zip(pdf[first], pdf[second], strict=True)):
                if a not in held[0] and b not in held[1]:
                    held[0].add(a)
                    held[1].add(b)
                    keep.append(at)
            yield pdf[[order]].iloc[keep]

    rest = left.coalesce(1).sortWithinPartitions(order).mapInPandas(loop, left.select(order).schema)
    return cut(reduce(DataFrame.union, [*taken, rest]))


def merge_preserved(current: DataFrame, preserved: DataFrame, topics: DataFrame) -> DataFrame:
    """Statements of an old snapshot that are added: same-id topics, titles the topic lacks, the first of each; colliding ids are reminted."""
    old = preserved.where(~regenerated()).join(topics.select("topic_id"), "topic_id", "left_semi")
    return remint_colliding_ids(cut(first_titles(without_titles(old, current))), current)


def preserved_titles(topics: DataFrame, old: DataFrame, order: str = "ord") -> DataFrame:
    """topics(topic_id, title, structural_adjustment) with the title they had in old(topic_id, title, order), the first where a topic occurs again, but for topics that a framework adjustment renamed and those whose old title is blank."""
    had = old.groupBy("topic_id").agg(F.min_by("title", order).alias("_old"))
    keeps = F.coalesce(F.trim("_old"), F.lit("")) != ""
    return topics.join(had, "topic_id", "left").withColumn("title", F.when(keeps & ~F.coalesce("structural_adjustment", F.lit(False)), F.col("_old")).otherwise(F.col("title"))).drop("_old")


def moved_by_alias(statements: DataFrame, aliases: DataFrame, topics: DataFrame) -> DataFrame:
    """Statements whose source node is an alias, at its target, with where they were (`relocated_from`) and `late` for those that moved. A target that isn't a topic is an error, raised when the rows are read."""
    to = aliases.select(F.col("source_node_id"), F.col("target_node_id").alias("_to"))
    known = topics.select(F.col("topic_id").alias("_to"), F.lit(True).alias("_known")).distinct()
    moved = statements.join(to, "source_node_id", "left").join(known, "_to", "left")
    checked = F.when(F.col("_to").isNotNull() & F.col("_known").isNull(), F.raise_error(F.concat(F.lit("alias target isn't a topic: "), "_to"))).otherwise(F.coalesce("_to", "topic_id"))
    out = moved.withColumn("relocated_from", F.when(F.col("_to").isNotNull(), F.col("topic_id"))).withColumn("late", F.col("_to").isNotNull())
    return out.withColumn("topic_id", checked.cast("string")).drop("_to", "_known")


def relocate_aliased(statements: DataFrame, aliases: DataFrame, topics: DataFrame) -> DataFrame:
    """moved_by_alias(), behind the statements already there; best-wins within each topic."""
    out = moved_by_alias(statements, aliases, topics).withColumn("_ord", F.col("ord")).withColumn("ord", F.struct("late", "ord"))
    return dedupe_best(out).withColumn("ord", F.col("_ord")).withColumn("first_ord", F.col("first_ord.ord")).drop("_ord", "late")


def install_revision(topics: DataFrame, revision: DataFrame, statements: DataFrame, root: str, revised: DataFrame | None = None, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Replace the subtree at root by its revision, which brings statements of its own (`revised`).

    Gives the topics; the statements, best-wins within each topic: those outside, those of the revision, and of the old subtree those whose source node is an alias or whose topic has the same id or a
    unique title in the revision, unless the revision has their title there or their id anywhere; the (topic_id, new_topic_id, method) of old topics; and a row of counts before and after."""
    old = subtree(topics, root)
    mapped = cut(match_id_or_title(old, revision))
    new_topics = topics.join(old.select("topic_id"), "topic_id", "left_anti").unionByName(revision.select(*topics.columns))
    revised = statements.limit(0) if revised is None else revised.select(*statements.columns)
    inside = statements.join(old.select("topic_id"), "topic_id", "left_semi")
    where_to = mapped.select("topic_id", "new_topic_id")
    named = inside.join(where_to, "topic_id", "left")
    if aliases is not None:
        to = aliases.select("source_node_id", F.col("target_node_id").alias("_to")).join(new_topics.select(F.col("topic_id").alias("_to")), "_to", "left_semi")
        named = named.join(to, "source_node_id", "left").withColumn("new_topic_id", F.coalesce("_to", "new_topic_id")).drop("_to")
    named = cut(named)
    carried = named.where("new_topic_id is not null").withColumn("topic_id", F.col("new_topic_id")).select(*statements.columns)
    fresh = cut(without_titles(carried, revised).join(revised.select("statement_id"), "statement_id", "left_anti").select(*statements.columns))
    outside = statements.join(old.select("topic_id"), "topic_id", "left_anti")
    both = cut(dedupe_best(outside.unionByName(revised).unionByName(fresh)))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = {
        "topics_before": topics, "topics_after": new_topics, "statements_before": statements, "statements_after": both,
        "unmapped_statements": named.where("new_topic_id is null"), "skipped_statements": carried, "carried_statements": fresh,
    }
    report = reduce(lambda a, b: a.join(b), [count(df, n) for n, df in parts.items()])  # one row each
    report = report.withColumn("skipped_statements", F.col("skipped_statements") - F.col("carried_statements"))
    report = report.withColumn("topic_delta", F.col("topics_after") - F.col("topics_before")).withColumn("statement_delta", F.col("statements_after") - F.col("statements_before"))
    return new_topics, both, mapped, report


def layer_gate(status: str | None, tree_mutated: bool | None, record_count: int | None, records: DataFrame) -> None:
    """Raise unless a convergence layer is an unreviewed shadow candidate that says it left the tree alone and declares as many records as it has."""
    if status not in LAYER_STATUS:
        raise ValueError(f"not the status of a candidate layer: {status}")
    if tree_mutated is not False:
        raise ValueError("the layer doesn't say that it left the tree alone")
    if (n := records.count()) != record_count or not n:
        raise ValueError(f"the layer declares {record_count} records and has {n}")


def merge_layer(current: DataFrame, layer: DataFrame, topics: DataFrame, status: str | None, tree_mutated: bool | None, record_count: int | None, loop_rows: int = LOOP_ROWS) -> DataFrame:
    """A convergence layer's records, after layer_gate(), with their outcome: unmapped, duplicate_title, duplicate_id or added.

    Records are taken by ord. A record is added unless its topic has a statement of its title, or any statement has its id, there before or added before it; one that isn't added holds neither title nor id."""
    layer_gate(status, tree_mutated, record_count, layer)
    placed = cut(with_title_key(attach_nearest(layer, topics)))
    titles = with_title_key(current).select("topic_id", "title_key").where("title_key <> ''").distinct().withColumn("_title", F.lit(True))
    ids = current.select("statement_id").distinct().withColumn("_id", F.lit(True))
    slim = placed.where("topic_id is not null").select("ord", "topic_id", "title_key", F.coalesce("statement_id", F.concat(F.lit("\u001f"), F.col("ord").cast("string"))).alias("statement_id"))
    slim = cut(slim.join(cut(titles), ["topic_id", "title_key"], "left").join(cut(ids), "statement_id", "left").withColumn("_own", F.concat_ws("\u001f", "topic_id", own_title())))
    added = accepted(slim.where("_title is null and _id is null"), "_own", "statement_id", loop_rows=loop_rows)
    holders = cut(slim.join(added, "ord").select("_own", F.col("ord").alias("_since")))
    judged = slim.join(holders, "_own", "left").join(added.withColumn("_added", F.lit(True)), "ord", "left")
    outcome = F.when(F.col("_added"), "added").when(F.col("_title") | (F.col("_since") < F.col("ord")), "duplicate_title").otherwise("duplicate_id")
    return placed.join(judged.select("ord", outcome.alias("outcome")), "ord", "left").withColumn("outcome", F.coalesce("outcome", F.lit("unmapped")))


#: What a convergence record may have beside its title and texts, with its type; missing columns count as null.
RECORD = {
    "variant_id": "string", "title": "string", "algorithm_topic_id": "string", "latex": "string", "plain": "string", "theorem_family_id": "string", "assumptions_latex": "array<string>", "boundary_notes": "array<string>",
    "equivalent_formulations_latex": "array<string>", "review_flags": "array<string>", "source_refs": "array<struct<source:string,locator:string>>",
    "conclusion": "struct<conclusion_latex:string,rate_class:string,nonasymptotic_bound_latex:string,epsilon_complexity_latex:string>",
}


def layer_records(raw: DataFrame) -> DataFrame:
    """Records as merge_layer() takes them: the id from the variant, the variant's name for a missing title, the topic that they were proposed for as their node. The fields of RECORD stay."""
    full = raw.withColumns({c: F.col(c).cast(t) if c in raw.columns else F.lit(None).cast(t) for c, t in RECORD.items()})
    own = F.concat(F.lit("stmt_"), F.replace(F.lower("variant_id"), F.lit("-"), F.lit("_")))
    return full.withColumns({"statement_id": own, "title": first_non_empty(F.col("title"), F.col("variant_id"), default="Convergence variant"), "source_node_id": F.coalesce("algorithm_topic_id", F.lit(""))})


def layer_statements(merged: DataFrame, source_path: str, status: str, partial_run: bool) -> DataFrame:
    """The statements that merge_layer() added of layer_records(), in canonical form; the kind follows from boundary notes and rates, witnesses are the references, metadata names the layer."""
    c = F.col("conclusion")
    bound = first_non_empty(c["nonasymptotic_bound_latex"], c["epsilon_complexity_latex"])
    # The stage of a layer by its kind.
    stage = "convergence_partial_fast_candidate_unreviewed" if partial_run else "convergence_fast_candidate_unreviewed"
    lists = {n: F.coalesce(n, F.array().cast(RECORD[n])).alias(n) for n in ("assumptions_latex", "equivalent_formulations_latex", "boundary_notes", "review_flags", "source_refs")}
    about = {"stage": F.lit(stage), "source_path": F.lit(source_path), "source_publication_status": F.lit(status), "partial_run": F.lit(str(partial_run).lower()), "variant_id": F.col("variant_id"), "theorem_family_id": F.col("theorem_family_id")}
    return merged.where("outcome = 'added'").select(
        F.col("statement_id").alias("id"), F.lit("knowledge_statement").alias("node_type"), "title", classify_convergence(lists["boundary_notes"], F.coalesce(c["rate_class"], F.lit("")), bound).alias("content_kind"),
        first_non_empty(F.col("latex"), c["conclusion_latex"], default="").alias("latex"), F.coalesce("plain", F.lit("")).alias("plain"), *lists.values(), F.coalesce(c["conclusion_latex"], F.lit("")).alias("conclusion_latex"), "conclusion",
        lists["source_refs"].alias("source_witnesses"), F.lit("candidate").alias("review_status"), F.lit(False).alias("proof_included"), "topic_id", F.col("source_node_id").alias("original_topic_id"), F.array("topic_id").alias("mapped_topic_ids"), "mapping_method",
        F.lit("intermediate_result").alias("layer_role"), F.create_map(*[x for k, v in about.items() for x in (F.lit(k), v)]).alias("metadata"), "ord",
    )


def layer_merge_report(merged: DataFrame, topics: DataFrame) -> DataFrame:
    """One row: how many records a layer has and what became of them, how many went to an ancestor (whatever became of them), and the added ones by domain, as a map."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    counts = merged.agg(
        F.count("*").alias("source_record_count"), n("added").alias("added_statement_count"), n("duplicate_title").alias("duplicate_title_count"), n("duplicate_id").alias("duplicate_id_count"), n("unmapped").alias("unmapped_count"),
        F.count_if(F.col("mapping_method") == "nearest_canonical_ancestor").alias("ancestor_mapped_count"),
    )
    by_topic = merged.where("outcome = 'added'").groupBy("topic_id").agg(F.count("*").alias("n"))
    each = by_topic.join(topics.select("topic_id", "domain_id"), "topic_id").groupBy("domain_id").agg(F.sum("n").alias("n"))
    return counts.join(each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain_id", "n")))).alias("added_by_domain")))  # one row each


def prepare_candidates(*sources: DataFrame) -> DataFrame:
    """All sources in one (a table of several stages needs no splitting), the best stage of each source item, with its statement id, title key and, where there are fields for them, placement hints in their order."""
    return described(best_stage(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)))


def store_best(candidates: DataFrame, parts: int = 1, path: str | None = None) -> DataFrame:
    """best_stage(), stored in parts by source item, so that only one part is on its way through a shuffle at a time; `part`, from 0 on, says which. What described() adds is left out: it is made again where rows are read."""
    best = (best_stage(rows).withColumn("part", F.lit(at)) for at, rows in enumerate(slices(candidates, "source_item_id", parts)))
    return stored(best, "candidates", path, "part")


#: What described() adds.
DESCRIBED = ("statement_id", "title_key", "placement_hints")


def described(best: DataFrame) -> DataFrame:
    """Candidates with what follows from their own fields: statement id, title key and placement hints."""
    out = best.withColumn("statement_id", item_id(F.col("source_item_id"))).withColumn("title_key", normalize_text(F.col("title")))
    if "placement_hints" in out.columns:
        return out
    one = lambda c: F.array(c)
    fields = {"campaign_existing_node": one("node_hint"), "campaign_preferred_home": one("home_hint"), "campaign_parent_fallback": one("fallback_hint")}
    return out.withColumn("placement_hints", placement_hints(fields, one("affected_hint")))


#: What a candidate may have from its review, with its type; missing columns count as null.
REVIEW = {"review_confidence": "double", "review_flags": "array<string>", "review_decision": "string", "primary_disposition": "string", "preferred_home_node_id": "string", "affected_existing_node_ids": "array<string>", "parent_candidate_ids": "array<string>"}


def candidate_records(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Prepared candidates with the evidence of their campaign's ledger (its last row by ord for a source item) as their one reference, titled by the stem of its path, with review fields, and with a context of where they come from and what
    the review said. A candidate without evidence has no references."""
    fields = [c for c in EVIDENCE if c in ledger.columns]
    last = cut(ledger.groupBy("campaign", "source_item_id").agg(F.max_by(F.struct(*fields), "ord").alias("evidence")))
    out = candidates.withColumns({c: F.col(c).cast(t) if c in candidates.columns else F.lit(None).cast(t) for c, t in REVIEW.items()}).join(last, ["campaign", "source_item_id"], "left")
    stem = F.regexp_extract(F.coalesce(F.col("evidence.source_path") if "source_path" in fields else F.lit(""), F.lit("")), r"([^/]+?)(?:\.[^./]*)?/*$", 1)
    reference = F.struct(F.col("campaign").alias("source"), F.coalesce(non_empty(stem), "campaign").alias("source_title"), *[F.col("evidence")[c].alias(c) for c in fields])
    context = F.struct(
        "campaign", "source_item_id", "review_decision", "primary_disposition", F.struct("preferred_home_node_id", "affected_existing_node_ids").alias("directory_assessment"), F.struct("parent_candidate_ids").alias("new_node_candidate")
    )
    refs = F.when(F.col("evidence").isNotNull(), F.array(reference)).otherwise(F.array().cast(f"array<struct<source:string,source_title:string,{','.join(f'{c}:string' for c in fields)}>>"))
    return out.withColumns({"source_refs": refs, "review_flags": F.coalesce("review_flags", F.array().cast("array<string>")), "context": context}).drop("evidence", *[c for c in REVIEW if c not in ("review_confidence", "review_flags")])


def proposals(candidates: DataFrame, topics: DataFrame, aliases: DataFrame) -> DataFrame:
    """What places and containers need of the candidates that propose a title, with their first live parent."""
    part = ["part"] if "part" in candidates.columns else []
    named = candidates.where("title_key <> ''").select("ord", *part, "source_item_id", "title_key", "title", "stage", "campaign", "locator", "scope_note", "parent_hint", "root_hint")
    return with_live_parent(named.withColumn("parents", F.array("parent_hint", "root_hint")), topics, aliases).drop("parents")


def materialize_containers(proposed: DataFrame, topics: DataFrame) -> DataFrame:
    """A new topic for each group of two campaigns or more without such a child: (parent, title_key, topic_id, parent_topic_id, domain_id, title, axis, depth, scope_note, knowledge_status, campaigns, n_items). Its items and witnesses,
    which may be many, are tables of their own: group_members() and container_witnesses()."""
    groups = cross_source_groups(proposed)
    groups = stored(groups.join(unique_children(topics), GROUP, "left_anti"), "groups")
    own = supported(proposed)  # counted together by group before they are joined
    title = own.groupBy(*GROUP).agg(F.min_by("title", "ord").alias("title"))
    notes = modal_value(own, GROUP, "scope_note", "ord")
    above = topics.select(F.col("topic_id").alias("parent"), "domain_id", (F.col("depth") + 1).alias("depth"))
    joined = groups.join(title, GROUP).join(notes, GROUP).join(above, "parent")
    return joined.select(
        "parent", "title_key", container_id(F.col("parent"), F.col("title_key")).alias("topic_id"), F.col("parent").alias("parent_topic_id"), "domain_id", "title",
        F.lit(CONTAINER_AXIS).alias("axis"), "depth", "scope_note", F.lit("statement_attached").alias("knowledge_status"), "campaigns", "n_items",
    )


def supported(proposed: DataFrame) -> DataFrame:
    """The reviewed or published proposals."""
    return proposed.where(F.col("stage").isin(*SUPPORTED))


def container_witnesses(proposed: DataFrame, containers: DataFrame) -> DataFrame:
    """(topic_id, pos, campaign, locator): a row for each distinct witness of a container, in the order they were first seen."""
    each = witness_dedup(supported(proposed), GROUP, groups=containers)
    return each.join(cut(containers.select(*GROUP, "topic_id")), GROUP).select("topic_id", "pos", "campaign", "locator")


def placed_titles(proposed: DataFrame, topics: DataFrame, containers: DataFrame) -> DataFrame:
    """(parent, title_key, topic_id, method): where a proposal of this title under this parent goes: to the exact child, a container, or a unique title of the part, in this order. Each distinct proposal is resolved once."""
    p = stored(proposed.select("parent", "title_key").distinct(), "proposed")
    by = lambda df, m, pos: df.select("parent", "title_key", F.struct(F.lit(pos).alias("pos"), "topic_id", F.lit(m).alias("method")).alias("to"))
    child = by(match_child_title(p, topics), "campaign_exact_sibling_title", 1)
    box = by(p.join(containers.select("parent", "title_key", "topic_id"), ["parent", "title_key"]), "campaign_cross_source_candidate_container", 2)
    everything = topics.select("topic_id", "title").union(containers.select("topic_id", "title"))
    part = by(match_title_same_part(p, everything), "campaign_unique_same_part_title", 3)
    best = child.union(box).union(part).groupBy("parent", "title_key").agg(F.min("to").alias("to"))
    return stored(best.select("parent", "title_key", "to.topic_id", "to.method"), "titled")


def placed_hints(hints: DataFrame, topics: DataFrame, aliases: DataFrame) -> DataFrame:
    """(original, topic_id, aliased): the topic, or its nearest ancestor, of each distinct hint, after aliases."""
    each = stored(alias_redirect(hints.select("original").distinct().withColumn("hint", F.col("original")), aliases, "hint"), "hints")
    near = nearest_topics(each, topics, "hint")
    return stored(each.join(near, "hint").select("original", "topic_id", (F.col("hint") != F.col("original")).alias("aliased")), "resolved")


def place_candidates(candidates: DataFrame, topics: DataFrame, aliases: DataFrame, containers: DataFrame, proposed: DataFrame, parts: int = 1, drop: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Candidates with topic_id, mapping_method and original_placement_hint: by proposal (exact child, container, unique title in the part, in this order), else by the first of their placement_hints
    that resolves to a topic or an ancestor of it, else no_live_target. A candidate's place hangs on no other candidate, so those of store_best() are placed part by part, which bounds what is on its way through shuffles. Stored
    without the columns `drop`, which can be made again. A part of the candidates that store_best() has put at a path given here is deleted as soon as it is placed."""
    titled = placed_titles(proposed, topics, containers)
    of = lambda df, at: df.where(F.col("part") == at).drop("part") if "part" in df.columns else df

    def each() -> Iterator[DataFrame]:
        for at in range(parts):
            yield placed_part(of(candidates, at), of(proposed, at), titled, topics, aliases).drop(*drop)
            if path:
                discard(candidates.sparkSession, f"{path}/part={at}")

    return stored(each(), "placed")


def placed_part(candidates: DataFrame, proposed: DataFrame, titled: DataFrame, topics: DataFrame, aliases: DataFrame) -> DataFrame:
    """place_candidates() of some candidates and their proposals. Only those that no title has placed look at their hints."""
    none = F.lit("")
    named = proposed.select("ord", "parent", "title_key").join(titled, ["parent", "title_key"]).select("ord", "topic_id", "method", none.alias("original"))
    rest = stored(candidates.select("ord", "placement_hints").join(named.select("ord"), "ord", "left_anti"), "untitled")
    hints = rest.select("ord", F.posexplode("placement_hints").alias("pos", "h")).select("ord", "pos", "h.method", F.col("h.hint").alias("original"))
    found = hints.join(placed_hints(hints, topics, aliases), "original")
    label = F.when(F.col("aliased"), "explicit_node_alias").otherwise(F.col("method"))
    label = F.when(F.col("topic_id") != F.col("original"), F.concat(label, F.lit("_ancestor"))).otherwise(label)
    hinted = found.groupBy("ord").agg(F.min(F.struct("pos", "topic_id", label.alias("method"), "original")).alias("b")).select("ord", "b.topic_id", "b.method", "b.original")
    placed = candidates.join(named.union(hinted), "ord", "left").withColumn("original_placement_hint", F.coalesce("original", none))
    return placed.withColumn("mapping_method", F.coalesce("method", F.lit("no_live_target"))).drop("method", "original")


def quarantine_reason() -> Column:
    """Why a placed candidate may not be public, in order; null if it may."""
    allowed = F.lit(False)
    for stage, methods in ALLOWED.items():
        allowed = allowed | ((F.col("stage") == stage) & F.col("mapping_method").isin(*methods))
    # The reasons.
    return (
        F.when(F.col("mapping_method") == "no_live_target", "no_live_target")
        .when(F.col("stage") == "0809_campaign_build", "builder_only_not_independently_reviewed")
        .when(F.contains("mapping_method", F.lit("ancestor")) | (F.col("mapping_method") == "campaign_parent_fallback"), "missing_or_unresolved_specific_container")
        .when(F.col("mapping_method") == "campaign_single_affected_node", "affected_node_is_not_a_confirmed_primary_owner")
        .when(~allowed, "placement_not_in_public_allowlist")
    )


def quarantine_split(placed: DataFrame, current: DataFrame, domain: Column | None = None) -> DataFrame:
    """Placed candidates with reason, outcome (quarantined, duplicate_title or public) and statement_id. Only admitted rows hold titles, in the order of source_item_id; they all get in, and one whose id the domain has already, or
    was given before, gets a new one (`reminted`). `domain` is the domain of a topic id, its first segment if not given."""
    domain = F.substring_index("topic_id", ".", 1) if domain is None else domain
    judged = placed.withColumn("reason", quarantine_reason())
    open_ = judged.where("reason is null")
    # Firsts before the titles that exist: a topic's title is held by all of its rows or none. What a public row carries is what its new id may need.
    first = first_titles(open_.select("ord", "source_item_id", "statement_id", "topic_id", "title_key", "stage", "latex"), "source_item_id")
    now = stored(with_title_key(current).select("topic_id", "title_key", "statement_id"), "current")
    fresh = stored(without_titles(first, now).withColumn("domain_id", domain).withColumn("_body", normalize_text(F.col("latex"))), "fresh")
    public = remint_colliding_ids(fresh, now.withColumn("domain_id", domain), within=("domain_id",), order="source_item_id", parts=("source_item_id", "topic_id", "title_key", "stage", "_body"))
    to = stored(public.select("ord", F.col("statement_id").alias("_new"), "reminted"), "public")
    outcome = F.when(F.col("_new").isNotNull(), "public").otherwise("duplicate_title")
    told = open_.join(to, "ord", "left").withColumns({"outcome": outcome, "statement_id": F.coalesce("_new", "statement_id"), "reminted": F.coalesce("reminted", F.lit(False))}).drop("_new")
    held = judged.where("reason is not null").withColumns({"outcome": F.lit("quarantined"), "reminted": F.lit(False)})
    return told.unionByName(held)


def quarantine_records(split: DataFrame) -> DataFrame:
    """The record of each quarantined candidate, with all that a reviewer needs to place it by hand; a candidate without a live target has neither method nor attempted topic."""
    lost = F.col("reason") == "no_live_target"
    has = lambda name: F.filter(F.array(name), lambda x: F.trim(x) != "")
    return split.where("outcome = 'quarantined'").select(
        "source_item_id", "campaign", "stage", "reason", F.when(lost, "").otherwise(F.col("mapping_method")).alias("mapping_method"), F.coalesce("topic_id", F.lit("")).alias("attempted_topic_id"),
        "original_placement_hint", F.coalesce("title", F.lit("")).alias("statement_title"), "placement_hints", F.col("confidence").alias("review_confidence"),
        F.struct(has("fallback_hint").alias("parent_candidate_ids"), "scope_note").alias("new_node_candidate"),
        F.struct(F.col("home_hint").alias("preferred_home_node_id"), has("affected_hint").alias("affected_existing_node_ids")).alias("directory_assessment"),
    )


def extract_subtrees(topics: DataFrame, moves: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Topics (with `number`) after the subtrees (root, new domain, its number) became domains of their own: domain, depth and display number follow; the root is promoted and loses its parent. A case
    expression over a few roots and a join of their few numbers: no shuffle of the topics."""
    root, domain = F.lit(None).cast("string"), F.col("domain_id")
    for at, to, _ in moves:
        inside = in_subtree(F.col("topic_id"), at)
        root, domain = F.when(inside, at).otherwise(root), F.when(inside, to).otherwise(domain)
    numbers = {at: n for at, _, n in moves}
    old = topics.where(F.col("topic_id").isin(*numbers)).select(F.col("topic_id").alias("moved_root"), F.col("number").alias("_old"), F.col("depth").alias("_depth"))
    moved = topics.withColumn("moved_root", root).withColumn("domain_id", domain).join(F.broadcast(old), "moved_root", "left")  # a row a move
    gone, new = F.col("moved_root").isNotNull(), F.element_at(F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv]), F.col("moved_root"))
    number = F.when(gone, F.concat(new, F.expr("substring(number, length(_old) + 1)"))).otherwise(F.col("number"))
    depth = F.when(gone, F.greatest(F.lit(0), F.col("depth") - F.col("_depth"))).otherwise(F.col("depth"))
    parent = F.when(~F.coalesce(F.col("topic_id") == F.col("moved_root"), F.lit(False)), F.col("parent_topic_id"))
    return moved.select("topic_id", parent.alias("parent_topic_id"), "domain_id", "title", "axis", depth.alias("depth"), "kind", "pos", number.alias("number"), "moved_root")


def extract_report(moved: DataFrame, statements: DataFrame) -> DataFrame:
    """(moved_root, domain_id, topics_moved, statements_kept) of extract_subtrees()."""
    counts = statements.groupBy("topic_id").agg(F.count("*").alias("n"))
    each = moved.where("moved_root is not null").join(counts, "topic_id", "left")
    return each.groupBy("moved_root", "domain_id").agg(F.count("*").alias("topics_moved"), F.coalesce(F.sum("n"), F.lit(0)).alias("statements_kept"))


def rename_export(topics: DataFrame, paths: DataFrame, domains: DataFrame) -> DataFrame:
    """The workbook: a record a domain (domain_id, display_name) and a record a topic with its path, number of children and current title, in batches by domain. A topic id that repeats is an error, raised when the rows are read."""
    children = topics.where("parent_topic_id is not null").groupBy(F.col("parent_topic_id").alias("topic_id")).agg(F.count("*").alias("child_count"))
    again = topics.groupBy("topic_id").agg(F.count("*").alias("_n"))
    out = topics.join(again, "topic_id").join(paths, "topic_id").join(children, "topic_id", "left").fillna(0, ["child_count"])
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("topic id repeats: "), "topic_id")).cast("string")).otherwise(F.col("topic_id"))
    rows = out.select(F.lit("topic").alias("record_type"), F.concat(F.lit("topic:"), checked).alias("stable_id"), "domain_id", "topic_id", "parent_topic_id", "depth", "path", "child_count", F.col("title").alias("current_title"), F.col("title").alias("new_title"), F.col("domain_id").alias("batch_id"))
    roots = topics.where("parent_topic_id is null").groupBy("domain_id").agg(F.count("*").alias("child_count"))
    named = domains.join(roots, "domain_id", "left").select(
        F.lit("domain").alias("record_type"), F.concat(F.lit("domain:"), "domain_id").alias("stable_id"), "domain_id", F.lit(None).cast("string").alias("topic_id"), F.lit(None).cast("string").alias("parent_topic_id"), F.lit(-1).alias("depth"),
        F.array("display_name").alias("path"), F.coalesce("child_count", F.lit(0)).alias("child_count"), F.col("display_name").alias("current_title"), F.col("display_name").alias("new_title"), F.col("domain_id").alias("batch_id"),
    )
    return named.unionByName(rows)


def rename_apply(occurrences: DataFrame, workbook: DataFrame, restore: bool = False) -> DataFrame:
    """occurrences(file, topic_id, title): every copy of a title set to the new one, or back to the current one; `changed` marks those that differ."""
    to = workbook.where("topic_id is not null").select("topic_id", F.col("current_title" if restore else "new_title").alias("_to"))
    out = occurrences.join(to, "topic_id", "left").withColumn("changed", F.col("_to").isNotNull() & ~F.col("_to").eqNullSafe(F.col("title")))
    return out.withColumn("title", F.coalesce("_to", "title")).drop("_to")
