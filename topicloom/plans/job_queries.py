"""Queries on windows, set operations, merge jobs, checks and the issue log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import text
from topicloom.operators import aggregates as agg
from topicloom.operators import checks, merges
from topicloom.operators import placement as place
from topicloom.operators import windows as win
from topicloom.plans.catalog_queries import KEY_SQL, MATCH_SQL, NORMAL_SQL, REVISED_TREE_SQL, attached, canonical_columns, direct_counts, joined_map, kept, order_subjects, part_domains, revised, revision, with_parts
from topicloom.plans.fixtures import fixture, table
from topicloom.plans.registration import query
from topicloom.session import cut, discard, scratch, stored
from topicloom.sources import catalog as src
from topicloom.streaming import issues as log
from topicloom.streaming import stateful

# --- windows

BEST_SQL = """SELECT *, row_number() OVER (PARTITION BY topic_id, k ORDER BY evidence > 0 DESC, evidence DESC, confidence DESC, mapping_method = 'explicit_node_alias' DESC, length(latex) + length(plain) DESC, ord) AS rn, min(ord) OVER (PARTITION BY topic_id, k) AS first_ord
    FROM (SELECT *, CASE WHEN title_key <> '' THEN 't' || title_key ELSE 'i' || statement_id END AS k FROM attached WHERE topic_id IS NOT NULL)"""


@query("dedupe_best", f"SELECT topic_id, statement_id, first_ord FROM ({BEST_SQL}) WHERE rn = 1")
def dedupe_best(spark, d):
    return win.dedupe_best(attached(spark, d).where("topic_id is not null")).select("topic_id", "statement_id", "first_ord")


@query("dedupe_first", "SELECT topic_id, count(*) FILTER (rn = 1) AS kept, count(*) FILTER (rn > 1 AND layer_role = 'base_statement_layer') AS duplicate_base, count(*) FILTER (rn > 1 AND layer_role <> 'base_statement_layer') AS duplicate_intermediate FROM kept GROUP BY 1")
def dedupe_first(spark, d):
    again, base = F.col("rn") > 1, F.col("layer_role") == agg.BASE
    return win.dedupe_first(attached(spark, d).where("topic_id is not null")).groupBy("topic_id").agg(F.count_if(~again).alias("kept"), F.count_if(again & base).alias("duplicate_base"), F.count_if(again & ~base).alias("duplicate_intermediate"))


STAGE_SQL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_item_id ORDER BY CASE stage WHEN '0809_campaign_published' THEN 3 WHEN '0809_campaign_reviewed' THEN 2 ELSE 1 END DESC, ord) AS rn FROM candidates WHERE title <> '' AND latex <> '') WHERE rn = 1"


@query("best_stage", f"SELECT source_item_id, stage, ord FROM ({STAGE_SQL.replace('FROM candidates', 'FROM whole_candidates')})")
def best_stage(spark, d):
    return win.best_stage(fixture(spark, d, "whole_candidates")).select("source_item_id", "stage", "ord")


@query(
    "display_numbers",
    """WITH r AS (SELECT topic_id, parent_topic_id, depth, row_number() OVER (PARTITION BY parent_topic_id ORDER BY kind, pos, topic_id) AS rank FROM topics WHERE depth > 0)
    SELECT topic_id, substring(topic_id, 2) AS number FROM topics WHERE depth = 0 UNION ALL SELECT topic_id, substring(parent_topic_id, 2) || '.' || rank FROM r WHERE depth = 1
    UNION ALL SELECT a.topic_id, substring(b.parent_topic_id, 2) || '.' || b.rank || '.' || a.rank FROM r a JOIN r b ON a.parent_topic_id = b.topic_id WHERE a.depth = 2""",
)
def display_numbers(spark, d):
    return win.display_numbers(fixture(spark, d, "topics"))


@query("statement_page", "SELECT topic_id, statement_id, total, total > 2 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY ord) AS r, count(*) OVER (PARTITION BY topic_id) AS total FROM attached WHERE topic_id IS NOT NULL) WHERE r <= 2")
def statement_page(spark, d):
    return win.statement_page(attached(spark, d).where("topic_id is not null"), 1, 2).select("topic_id", "statement_id", "total", "has_more")


REMINT_SQL = """WITH n AS (SELECT *, 'stmt_' || (ord % 500) AS id FROM attached WHERE topic_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) > 1 OR id IN (SELECT statement_id FROM statements WHERE ord % 2 = 0) AS again FROM n)
    SELECT ord, again AS reminted, CASE WHEN again THEN 'stmt_0809_version_' || substring(sha256(id || chr(31) || topic_id || chr(31) || ord), 1, 20) ELSE id END AS statement_id FROM r"""


@query("remint_colliding_ids", REMINT_SQL)
def remint_colliding_ids(spark, d):
    a = attached(spark, d).where("topic_id is not null").withColumn("statement_id", F.concat(F.lit("stmt_"), F.col("ord") % 500))
    return win.remint_colliding_ids(a, fixture(spark, d, "statements").where("ord % 2 = 0")).select("ord", "reminted", "statement_id")


@query("sibling_collisions", "SELECT topic_id, n FROM (SELECT topic_id, count(*) OVER (PARTITION BY domain_id, parent_topic_id, lower(title)) AS n FROM topics) WHERE n > 1")
def sibling_collisions(spark, d):
    return win.sibling_collisions(fixture(spark, d, "topics")).select("topic_id", "n")


@query("publish_order", "SELECT topic_id AS domain_id, CAST(row_number() OVER (ORDER BY CASE topic_id WHEN 'R0' THEN 2.1 WHEN 'R4' THEN 2.2 ELSE pos END) AS INT) AS place FROM topics WHERE depth = 0")
def publish_order(spark, d):
    return win.publish_order(fixture(spark, d, "topics").where("depth = 0").select("domain_id", F.col("pos").alias("rank")), "R2", ["R0", "R4"])


@query("top_issues_sample", "SELECT statement_id, source_node_id FROM attached WHERE topic_id IS NULL ORDER BY ord LIMIT 20")
def top_issues_sample(spark, d):
    return win.top_sample(attached(spark, d).where("topic_id is null"), ["ord"], 20).select("statement_id", "source_node_id")


# --- sets


@query("union_layers", "SELECT statement_id, CASE WHEN ord < 1000 THEN 'seed' ELSE 'current' END AS layer, '' AS reason FROM statements WHERE layer_role = 'base_statement_layer' AND starts_with(source_node_id, 'R1') UNION ALL SELECT statement_id, CASE WHEN stage = 'current' THEN 'seed_deferred' ELSE 'new_deferred' END, 'later' FROM statements WHERE layer_role <> 'base_statement_layer' AND starts_with(source_node_id, 'R1')")
def union_layers(spark, d):
    s = fixture(spark, d, "statements")
    late = s.where(F.col("layer_role") != agg.BASE).withColumn("reason", F.lit("later"))
    layers = {"seed_deferred": late.where("stage = 'current'"), "new_deferred": late.where("stage <> 'current'")}
    return win.union_layers(s.where(F.col("layer_role") == agg.BASE), layers, 1000, "R1").select("statement_id", "layer", F.coalesce("reason", F.lit("")).alias("reason"))


@query("coverage_diff", f"WITH rev AS ({REVISED_TREE_SQL}) SELECT topic_id, 'missing' AS side FROM topics WHERE topic_id NOT IN (SELECT topic_id FROM rev) UNION ALL SELECT topic_id, 'extra' FROM rev WHERE topic_id NOT IN (SELECT topic_id FROM topics)")
def coverage_diff(spark, d):
    t = fixture(spark, d, "topics")
    return win.coverage_diff(t, revised(t), "topic_id")


MOVED_SQL = "SELECT * FROM topics WHERE depth = 2 AND pos % 6 = 0"


@query("alias_map_equal", f"WITH m AS ({MOVED_SQL}) SELECT topic_id AS source_node_id, parent_topic_id AS target_node_id, 'missing' AS side FROM m UNION ALL SELECT topic_id, domain_id, 'extra' FROM m")
def alias_map_equal(spark, d):
    t = fixture(spark, d, "topics").where("depth > 0")
    declared = t.select(F.col("topic_id").alias("source_node_id"), F.col("parent_topic_id").alias("target_node_id"))
    computed = t.select(F.col("topic_id").alias("source_node_id"), F.when((F.col("depth") == 2) & (F.col("pos") % 6 == 0), F.col("domain_id")).otherwise(F.col("parent_topic_id")).alias("target_node_id"))
    return win.coverage_diff(declared, computed, "source_node_id", "target_node_id")


@query("published_items_equal", "WITH i AS (SELECT DISTINCT CASE WHEN l_partkey % 50 = 0 THEN 'X' ELSE 'P' END || l_partkey AS id FROM lineitem), p AS (SELECT 'P' || p_partkey AS id FROM part) SELECT id AS domain_id, 'missing' AS side FROM p WHERE id NOT IN (SELECT id FROM i) UNION ALL SELECT id, 'extra' FROM i WHERE id NOT IN (SELECT id FROM p)")
def published_items_equal(spark, d):
    return win.coverage_diff(part_domains(spark, d), order_subjects(spark, d).select(F.explode("items").alias("domain_id")), "domain_id")


# --- merge jobs


@query("collect_statements", "SELECT count(*) AS records, count(*) FILTER (a.topic_id IS NULL) AS unmapped, count(*) FILTER (a.mapping_method = 'nearest_canonical_ancestor') AS ancestor_mapped, count(*) FILTER (k.rn = 1) AS attached, count(*) FILTER (k.rn = 1 AND k.layer_role = 'base_statement_layer') AS base, count(*) FILTER (k.rn = 1 AND k.layer_role <> 'base_statement_layer') AS intermediate, count(*) FILTER (k.rn > 1 AND k.layer_role = 'base_statement_layer') AS duplicate_base, count(*) FILTER (k.rn > 1 AND k.layer_role <> 'base_statement_layer') AS duplicate_intermediate FROM attached a LEFT JOIN kept k USING (ord)")
def collect_statements(spark, d):
    return merges.collect_statements(fixture(spark, d, "statements"), fixture(spark, d, "topics"))[1]


@query("collect_statements_rows", f"SELECT * FROM ({NORMAL_SQL})")
def collect_statements_rows(spark, d):
    return canonical_columns(merges.collect_statements(with_parts(fixture(spark, d, "statements")), fixture(spark, d, "topics"))[0])


PRESERVED_SQL = """now AS (SELECT * FROM kept WHERE rn = 1 AND ord % 2 = 0), old AS (SELECT * FROM attached WHERE topic_id IS NOT NULL AND ord % 2 = 1 AND stage = 'current'),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY topic_id, CASE WHEN title_key <> '' THEN 't' || title_key ELSE 'o' || ord END ORDER BY ord) AS fr FROM old o WHERE title_key = '' OR NOT EXISTS (SELECT 1 FROM now WHERE now.topic_id = o.topic_id AND now.title_key = o.title_key))"""


@query("merge_preserved", f"WITH {PRESERVED_SQL} SELECT topic_id, statement_id, false AS reminted FROM fresh WHERE fr = 1")
def merge_preserved(spark, d):
    current, old = kept(spark, d).where("ord % 2 = 0"), attached(spark, d).where("topic_id is not null and ord % 2 = 1")
    return merges.merge_preserved(current, old, fixture(spark, d, "topics")).select("topic_id", "statement_id", "reminted")


@query("preserved_titles", "SELECT topic_id, CASE WHEN pos % 3 <> 0 AND title <> '' AND depth > 0 THEN 'Old ' || title ELSE title END AS title FROM topics")
def preserved_titles(spark, d):
    t = fixture(spark, d, "topics")
    old = t.where("depth > 0").select("topic_id", F.when(F.col("title") != "", F.concat(F.lit("Old "), "title")).otherwise("").alias("title"), F.lit(0).alias("ord"))
    old = old.union(t.select("topic_id", F.lit("Older").alias("title"), F.lit(1).alias("ord")).where("depth > 0"))  # topics that occur again
    return merges.preserved_titles(t.withColumn("structural_adjustment", F.col("pos") % 3 == 0), old).select("topic_id", "title")


REVISED_SQL = f"""{MATCH_SQL}, ali AS (SELECT topic_id AS source_node_id, 'R2.N2' AS target_node_id FROM topics WHERE depth = 2 AND pos % 10 = 3 AND starts_with(topic_id, 'R2.N2.')),
    inside AS (SELECT a.*, m.new_topic_id FROM attached a JOIN topics t USING (topic_id) LEFT JOIN matched m USING (topic_id) WHERE a.topic_id = 'R2.N2' OR starts_with(a.topic_id, 'R2.N2.')),
    revised AS (SELECT * EXCLUDE (topic_id, new_topic_id, statement_id, title, title_key), new_topic_id AS topic_id, CASE WHEN ord % 8 = 0 THEN statement_id ELSE 'rev_' || ord END AS statement_id, CASE WHEN ord % 3 = 0 THEN 'Revised ' || title ELSE title END AS title, CASE WHEN ord % 3 = 0 THEN lower(trim('Revised ' || title)) ELSE title_key END AS title_key FROM inside WHERE new_topic_id IS NOT NULL AND ord % 4 = 0),
    sent AS (SELECT i.* EXCLUDE (topic_id, new_topic_id), coalesce(ali.target_node_id, new_topic_id) AS topic_id FROM inside i LEFT JOIN ali USING (source_node_id)),
    fresh AS (SELECT * FROM sent WHERE topic_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM revised r WHERE r.topic_id = sent.topic_id AND r.title_key = sent.title_key AND r.title_key <> '') AND statement_id NOT IN (SELECT statement_id FROM revised)),
    everyone AS (SELECT topic_id, statement_id, title_key, evidence, confidence, mapping_method, latex, plain, ord FROM attached WHERE topic_id IS NOT NULL AND ord NOT IN (SELECT ord FROM inside) UNION ALL SELECT topic_id, statement_id, title_key, evidence, confidence, mapping_method, latex, plain, ord FROM revised
        UNION ALL SELECT topic_id, statement_id, title_key, evidence, confidence, mapping_method, latex, plain, ord FROM fresh),
    best AS (SELECT *, row_number() OVER (PARTITION BY topic_id, CASE WHEN title_key <> '' THEN 't' || title_key ELSE 'i' || statement_id END ORDER BY evidence > 0 DESC, evidence DESC, confidence DESC, mapping_method = 'explicit_node_alias' DESC, length(latex) + length(plain) DESC, ord) AS rn FROM everyone)"""


def installed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A revision of one nation that brings some statements of its own, with aliases of some of its old leaves."""
    t, a = fixture(spark, d, "topics"), attached(spark, d).where("topic_id is not null")
    new = place.match_id_or_title(place.subtree(t, "R2.N2"), revision(spark, d)).where("new_topic_id is not null").select("topic_id", "new_topic_id")
    own = a.where("ord % 4 = 0").join(new, "topic_id").withColumn("topic_id", F.col("new_topic_id"))
    own = own.withColumn("statement_id", F.when(F.col("ord") % 8 == 0, F.col("statement_id")).otherwise(F.concat(F.lit("rev_"), "ord"))).withColumn("title", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("Revised "), "title")).otherwise(F.col("title")))
    aliases = place.subtree(t, "R2.N2").where("depth = 2 and pos % 10 = 3").select(F.col("topic_id").alias("source_node_id"), F.lit("R2.N2").alias("target_node_id"))
    return merges.install_revision(t, revision(spark, d), a, "R2.N2", own, aliases)


@query("install_revision", f"WITH {REVISED_SQL} SELECT topic_id, statement_id FROM best WHERE rn = 1")
def install_revision(spark, d):
    return installed(spark, d)[1].select("topic_id", "statement_id")


@query(
    "install_revision_report",
    f"""WITH {REVISED_SQL}, n AS (SELECT (SELECT count(*) FROM topics) AS topics_before, (SELECT count(*) FROM topics WHERE NOT (topic_id = 'R2.N2' OR starts_with(topic_id, 'R2.N2.'))) + (SELECT count(*) FROM rev) AS topics_after,
    (SELECT count(*) FROM attached WHERE topic_id IS NOT NULL) AS statements_before, (SELECT count(*) FROM best WHERE rn = 1) AS statements_after, (SELECT count(*) FROM sent WHERE topic_id IS NULL) AS unmapped_statements,
    (SELECT count(*) FROM sent WHERE topic_id IS NOT NULL) - (SELECT count(*) FROM fresh) AS skipped_statements, (SELECT count(*) FROM fresh) AS carried_statements)
    SELECT *, topics_after - topics_before AS topic_delta, statements_after - statements_before AS statement_delta FROM n""",
)
def install_revision_report(spark, d):
    return installed(spark, d)[3]


RELOCATE_SQL = """WITH m AS (SELECT a.* EXCLUDE (topic_id, ord), CASE WHEN starts_with(source_node_id, 'R1.N1.') AND mapping_method = 'exact_topic_id' THEN 'R1.N6' ELSE topic_id END AS topic_id, ord + CASE WHEN starts_with(source_node_id, 'R1.N1.') AND mapping_method = 'exact_topic_id' THEN 1000000000000000 ELSE 0 END AS ord FROM attached a WHERE topic_id IS NOT NULL),
    b AS (SELECT *, row_number() OVER (PARTITION BY topic_id, CASE WHEN title_key <> '' THEN 't' || title_key ELSE 'i' || statement_id END ORDER BY evidence > 0 DESC, evidence DESC, confidence DESC, mapping_method = 'explicit_node_alias' DESC, length(latex) + length(plain) DESC, ord) AS rn FROM m)
    SELECT topic_id, statement_id FROM b WHERE rn = 1"""


@query("relocate_aliased", RELOCATE_SQL)
def relocate_aliased(spark, d):
    t = fixture(spark, d, "topics")
    aliases = t.where("parent_topic_id = 'R1.N1'").select(F.col("topic_id").alias("source_node_id"), F.lit("R1.N6").alias("target_node_id"))
    return merges.relocate_aliased(attached(spark, d).where("topic_id is not null"), aliases, t).select("topic_id", "statement_id")


LAYER_SQL = """WITH RECURSIVE now AS (SELECT * FROM kept WHERE rn = 1 AND ord % 3 = 0), l AS (SELECT a.* EXCLUDE (statement_id), CASE WHEN ord % 7 = 0 THEN (SELECT min(statement_id) FROM now) ELSE 'stmt_v_' || lower(regexp_extract(source_node_id, 'C[0-9]+')) || '_' || ord % 4 END AS statement_id FROM attached a WHERE ord % 3 <> 0),
    j AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY ord) AS n FROM l WHERE topic_id IS NOT NULL),
    had AS (SELECT topic_id, list(title_key) AS titles FROM now WHERE title_key <> '' GROUP BY 1), ids AS (SELECT min(statement_id) AS id FROM now),
    told AS (SELECT j.topic_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ord, '' AS outcome, coalesce(any_value(had.titles), []) AS titles, [any_value(ids.id)] AS held FROM j LEFT JOIN had USING (topic_id), ids GROUP BY 1
        UNION ALL SELECT topic_id, n, ord, outcome, CASE WHEN outcome = 'added' AND title_key <> '' THEN list_append(titles, title_key) ELSE titles END, CASE WHEN outcome = 'added' THEN list_append(held, statement_id) ELSE held END
        FROM (SELECT j.*, t.titles, t.held, CASE WHEN j.title_key <> '' AND list_contains(t.titles, j.title_key) THEN 'duplicate_title' WHEN list_contains(t.held, j.statement_id) THEN 'duplicate_id' ELSE 'added' END AS outcome FROM told t JOIN j ON t.topic_id = j.topic_id AND j.n = t.n + 1)),
    merged AS (SELECT l.*, coalesce(t.outcome, 'unmapped') AS outcome FROM l LEFT JOIN told t USING (ord))"""


def merged_layer(spark: SparkSession, d: str) -> DataFrame:
    """A layer whose variants share ids and titles within a topic, and some an id that there is."""
    s, now = fixture(spark, d, "statements"), kept(spark, d).where("ord % 3 = 0")
    least = now.agg(F.min("statement_id").alias("least"))
    raw = s.where("ord % 3 <> 0").withColumnRenamed("source_node_id", "algorithm_topic_id").withColumn("variant_id", F.concat(F.lit("V-"), F.regexp_extract("algorithm_topic_id", "C[0-9]+", 0), F.lit("-"), F.col("ord") % 4))
    raw = raw.withColumns(
        {
            "title": F.when(F.col("title") == "", F.lit(None)).otherwise(F.col("title")), "boundary_notes": F.when(F.col("ord") % 5 == 0, F.array(F.lit("It may"), F.lit("DIVERGE"))), "theorem_family_id": F.lit("f"),
            "conclusion": F.struct(F.col("plain").alias("conclusion_latex"), F.when(F.col("ord") % 2 == 0, "linear").alias("rate_class"), F.lit("").alias("nonasymptotic_bound_latex"), F.lit(None).cast("string").alias("epsilon_complexity_latex")),
            "latex": F.when(F.col("ord") % 4 == 1, "").otherwise(F.col("latex")),
        }
    )
    layer = merges.layer_records(raw).withColumn("title", F.coalesce(text.non_empty(F.when(F.col("title") != F.col("variant_id"), F.col("title"))), F.lit("")))  # so that there are rows without a title
    layer = layer.join(F.broadcast(least)).withColumn("statement_id", F.when(F.col("ord") % 7 == 0, F.col("least")).otherwise(F.col("statement_id"))).drop("least")  # one row
    return merges.merge_layer(now, layer, fixture(spark, d, "topics"), merges.LAYER_STATUS[1], False, layer.count(), loop_rows=100)


@query("merge_layer", f"{LAYER_SQL} SELECT ord, outcome FROM merged")
def merge_layer(spark, d):
    return merged_layer(spark, d).select("ord", "outcome")


@query(
    "merge_layer_rows",
    f"""{LAYER_SQL} SELECT statement_id AS id, title, topic_id, source_node_id AS original_topic_id, mapping_method, CASE WHEN ord % 5 = 0 THEN 'failure_boundary' WHEN ord % 2 = 0 THEN 'complexity_bound' ELSE 'theorem' END AS content_kind,
    CASE WHEN ord % 4 = 1 THEN plain ELSE latex END AS latex, plain, CASE WHEN ord % 5 = 0 THEN 'It may,DIVERGE' ELSE '' END AS boundary_notes, 'convergence_partial_fast_candidate_unreviewed' AS stage, 'layers/partial.json' AS source_path, 'V-' || regexp_extract(source_node_id, 'C[0-9]+') || '-' || ord % 4 AS variant_id, ord FROM merged WHERE outcome = 'added'""",
)
def merge_layer_rows(spark, d):
    rows = merges.layer_statements(merged_layer(spark, d), "layers/partial.json", merges.LAYER_STATUS[1], True)
    return rows.select("id", "title", "topic_id", "original_topic_id", "mapping_method", "content_kind", "latex", "plain", F.array_join("boundary_notes", ",").alias("boundary_notes"), *[F.col("metadata")[k].alias(k) for k in ("stage", "source_path", "variant_id")], "ord")


@query(
    "merge_layer_report",
    f"""{LAYER_SQL} SELECT count(*) AS source_record_count, count(*) FILTER (outcome = 'added') AS added_statement_count, count(*) FILTER (outcome = 'duplicate_title') AS duplicate_title_count, count(*) FILTER (outcome = 'duplicate_id') AS duplicate_id_count, count(*) FILTER (outcome = 'unmapped') AS unmapped_count,
    count(*) FILTER (mapping_method = 'nearest_canonical_ancestor') AS ancestor_mapped_count, (SELECT string_agg(d || '=' || n, ',' ORDER BY d) FROM (SELECT split_part(topic_id, '.', 1) AS d, count(*) AS n FROM merged WHERE outcome = 'added' GROUP BY 1)) AS added_by_domain FROM merged""",
)
def merge_layer_report(spark, d):
    report = merges.layer_merge_report(cut(merged_layer(spark, d)), fixture(spark, d, "topics"))
    return report.withColumn("added_by_domain", joined_map("added_by_domain"))


def prepared(spark: SparkSession, d: str) -> DataFrame:
    return merges.prepare_candidates(fixture(spark, d, "candidates"))


@query("prepare_candidates", f"SELECT source_item_id, stage, 'stmt_0809_' || substring(sha256(source_item_id), 1, 20) AS statement_id, {KEY_SQL.format('title')} AS title_key FROM ({STAGE_SQL})")
def prepare_candidates(spark, d):
    return prepared(spark, d).select("source_item_id", "stage", "statement_id", "title_key")


@query(
    "candidate_records",
    f"""WITH k AS ({STAGE_SQL}), e AS (SELECT campaign, source_item_id, max_by(locator, ord) AS locator FROM candidates WHERE stage <> '0809_campaign_build' GROUP BY 1, 2)
    SELECT k.source_item_id, CASE WHEN e.locator IS NULL THEN '' ELSE k.campaign || '|' || CASE WHEN e.locator = 'loc1' THEN k.campaign ELSE 'paper.v1' END || '|' || e.locator END AS reference, k.confidence AS review_confidence, CASE WHEN k.locator = 'loc2' THEN 'check,again' ELSE '' END AS flags,
    k.campaign || '|' || k.stage || '|' || k.home_hint || '|' || k.affected_hint AS context FROM k LEFT JOIN e ON e.campaign = k.campaign AND e.source_item_id = k.source_item_id""",
)
def candidate_records(spark, d):
    k = fixture(spark, d, "candidates")
    path = F.when(F.col("locator") != "loc1", F.concat(F.lit("books/"), "campaign", F.lit("/paper.v1.tex")))
    ledger = k.where("stage <> '0809_campaign_build'").select("campaign", "source_item_id", path.alias("source_path"), "locator", "ord")
    reviewed = prepared(spark, d).withColumns({"review_confidence": F.col("confidence"), "review_flags": F.when(F.col("locator") == "loc2", F.array(F.lit("check"), F.lit("again"))), "review_decision": F.col("stage"), "preferred_home_node_id": F.col("home_hint"), "affected_existing_node_ids": F.array("affected_hint")})
    r = merges.candidate_records(reviewed, ledger)
    ref, of = F.col("source_refs")[0], F.col("context")
    told = F.when(F.size("source_refs") > 0, F.concat_ws("|", ref["source"], ref["source_title"], ref["locator"])).otherwise("")
    return r.select("source_item_id", told.alias("reference"), "review_confidence", F.array_join("review_flags", ",").alias("flags"), F.concat_ws("|", of["campaign"], of["review_decision"], of["directory_assessment"]["preferred_home_node_id"], of["directory_assessment"]["affected_existing_node_ids"][0]).alias("context"))


CANDIDATE_SQL = f"""prep AS (SELECT * EXCLUDE (rn), {KEY_SQL.format('title')} AS title_key FROM ({STAGE_SQL})),
    prop AS (SELECT p.*, CASE WHEN coalesce(a.target_node_id, parent_hint) IN (SELECT topic_id FROM topics) THEN coalesce(a.target_node_id, parent_hint) ELSE root_hint END AS parent FROM prep p LEFT JOIN aliases a ON a.source_node_id = parent_hint),
    ch AS (SELECT parent_topic_id AS parent, lower(title) AS title_key, min(topic_id) AS topic_id FROM topics WHERE depth > 0 GROUP BY 1, 2 HAVING count(*) = 1),
    box AS (SELECT parent, title_key, parent || '.WEB' || upper(substring(sha256(parent || chr(10) || title_key), 1, 12)) AS topic_id, min_by(title, ord) AS title, string_agg(DISTINCT campaign, ',' ORDER BY campaign) AS campaigns, count(DISTINCT source_item_id) AS n_items FROM prop p
        WHERE stage <> '0809_campaign_build' AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.parent = p.parent AND ch.title_key = p.title_key) GROUP BY 1, 2 HAVING count(DISTINCT campaign) >= 2)"""
PLACED_SQL = f"""{CANDIDATE_SQL}, un AS (SELECT lower(title) AS title_key, min(topic_id) AS topic_id FROM (SELECT topic_id, title FROM topics UNION ALL SELECT topic_id, title FROM box) GROUP BY 1 HAVING count(*) = 1),
    listed AS (SELECT ord, list_filter([{{'m': 'campaign_existing_node', 'h': trim(node_hint)}}, {{'m': 'campaign_preferred_home', 'h': home_hint}}, {{'m': 'campaign_parent_fallback', 'h': fallback_hint}}], lambda x: x.h <> '') AS hs, affected_hint FROM prep),
    hints AS (SELECT ord, CASE WHEN len(hs) = 0 AND affected_hint <> '' THEN [{{'m': 'campaign_single_affected_node', 'h': affected_hint}}] ELSE hs END AS hs FROM listed),
    hint AS (SELECT x.ord, i, x.x.m AS m, x.x.h AS original, coalesce(a.target_node_id, x.x.h) AS h FROM (SELECT ord, unnest(hs) AS x, unnest(range(len(hs))) AS i FROM hints) x LEFT JOIN aliases a ON a.source_node_id = x.x.h),
    hp AS (SELECT ord, i, any_value(m) AS m, any_value(original) AS original, any_value(h) AS h, max_by(p, length(p)) AS topic_id FROM (SELECT *, unnest(list_transform(range(1, len(string_split(h, '.')) + 1), lambda i: array_to_string(string_split(h, '.')[1:i], '.'))) AS p FROM hint) WHERE p IN (SELECT topic_id FROM topics) GROUP BY 1, 2),
    options AS (SELECT p.ord, -3 AS pos, ch.topic_id, 'campaign_exact_sibling_title' AS method, '' AS original FROM prop p JOIN ch USING (parent, title_key) UNION ALL SELECT p.ord, -2, box.topic_id, 'campaign_cross_source_candidate_container', '' FROM prop p JOIN box USING (parent, title_key)
        UNION ALL SELECT p.ord, -1, un.topic_id, 'campaign_unique_same_part_title', '' FROM prop p JOIN un USING (title_key) WHERE string_split(p.parent, '.')[1] = string_split(un.topic_id, '.')[1]
        UNION ALL SELECT ord, i, topic_id, CASE WHEN h <> original THEN 'explicit_node_alias' ELSE m END || CASE WHEN topic_id <> original THEN '_ancestor' ELSE '' END, original FROM hp),
    placed AS (SELECT prep.*, o.topic_id, coalesce(o.method, 'no_live_target') AS mapping_method, coalesce(o.original, '') AS original_placement_hint FROM prep LEFT JOIN (SELECT ord, min_by(topic_id, pos) AS topic_id, min_by(method, pos) AS method, min_by(original, pos) AS original FROM options GROUP BY ord) o USING (ord)),
    judged AS (SELECT *, CASE WHEN mapping_method = 'no_live_target' THEN 'no_live_target' WHEN stage = '0809_campaign_build' THEN 'builder_only_not_independently_reviewed' WHEN contains(mapping_method, 'ancestor') OR mapping_method = 'campaign_parent_fallback' THEN 'missing_or_unresolved_specific_container'
        WHEN mapping_method = 'campaign_single_affected_node' THEN 'affected_node_is_not_a_confirmed_primary_owner' WHEN stage = '0809_campaign_published' AND mapping_method = 'campaign_preferred_home' THEN 'placement_not_in_public_allowlist' END AS reason FROM placed),
    split AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'quarantined' WHEN row_number() OVER (PARTITION BY topic_id, title_key, reason IS NULL ORDER BY source_item_id) = 1 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.rn = 1 AND k.topic_id = judged.topic_id AND k.title_key = judged.title_key) THEN 'public' ELSE 'duplicate_title' END AS outcome FROM judged)"""


#: Lines of a part of the candidates, and parts at most.
PART_LINES, PARTS = 1_000_000, 16


def parts(spark: SparkSession, d: str) -> int:
    return max(1, min(PARTS, table(spark, d, "lineitem").count() // PART_LINES))


def proposed(spark: SparkSession, d: str, path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Topics, aliases, candidates (stored at the path), proposals and containers."""
    t, a = stored(fixture(spark, d, "topics"), "topics"), fixture(spark, d, "aliases")
    k = merges.described(merges.store_best(fixture(spark, d, "candidates"), parts(spark, d), path))
    p = merges.proposals(k, t, a)
    return t, a, k, p, stored(merges.materialize_containers(p, t), "containers")


def placed(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "candidates")
    t, a, k, p, boxes = proposed(spark, d, path)
    out = merges.place_candidates(k, t, a, boxes, p, parts(spark, d), merges.DESCRIBED, path)
    discard(spark, path)
    return merges.described(out)


@query("materialize_containers", f"WITH {CANDIDATE_SQL} SELECT box.topic_id, box.parent AS parent_topic_id, t.domain_id, box.title, t.depth + 1 AS depth, 'textbook_candidate_topic' AS axis, 'statement_attached' AS knowledge_status, campaigns, n_items FROM box JOIN topics t ON t.topic_id = box.parent")
def materialize_containers(spark, d):
    return proposed(spark, d)[-1].select("topic_id", "parent_topic_id", "domain_id", "title", "depth", "axis", "knowledge_status", F.array_join("campaigns", ",").alias("campaigns"), "n_items")


@query("container_witnesses", f"WITH {CANDIDATE_SQL} SELECT topic_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY min(ord), campaign, locator) AS INT) AS pos, campaign, locator FROM (SELECT box.topic_id, p.campaign, locator, ord FROM prop p JOIN box USING (parent, title_key) WHERE stage <> '0809_campaign_build') GROUP BY topic_id, campaign, locator")
def container_witnesses(spark, d):
    *_, p, boxes = proposed(spark, d)
    return merges.container_witnesses(p, boxes)


@query("place_candidates", f"WITH {PLACED_SQL} SELECT ord, coalesce(topic_id, '') AS topic_id, mapping_method, original_placement_hint FROM placed")
def place_candidates(spark, d):
    return placed(spark, d).select("ord", F.coalesce("topic_id", F.lit("")).alias("topic_id"), "mapping_method", "original_placement_hint")


def split(spark: SparkSession, d: str) -> DataFrame:
    """Against statements of which some have an id that a candidate will have."""
    now = stored(win.first_rows(attached(spark, d).where("topic_id is not null").select("statement_id", "topic_id", "title", "latex", "plain", "ord")).select("ord", "statement_id", "topic_id", "title"), "kept")
    now = now.withColumn("statement_id", F.when(F.col("ord") % 3 == 0, text.item_id(F.concat(F.lit("i"), F.col("ord").cast("string"), F.lit("-1")))).otherwise(F.col("statement_id")))
    return merges.quarantine_split(placed(spark, d), now)


@query(
    "quarantine_split",
    f"""WITH {PLACED_SQL}, has AS (SELECT DISTINCT split_part(topic_id, '.', 1) AS domain_id, 'i' || ord || '-1' AS item FROM kept WHERE rn = 1 AND ord % 3 = 0)
    SELECT ord, coalesce(reason, '') AS reason, outcome, outcome = 'public' AND item IS NOT NULL AS reminted, CASE WHEN outcome = 'public' AND item IS NOT NULL
        THEN 'stmt_0809_version_' || substring(sha256(concat_ws(chr(31), source_item_id, topic_id, title_key, stage, lower(latex))), 1, 20) ELSE 'stmt_0809_' || substring(sha256(source_item_id), 1, 20) END AS statement_id
    FROM split LEFT JOIN has ON item = source_item_id AND domain_id = split_part(topic_id, '.', 1)""",
)
def quarantine_split(spark, d):
    return split(spark, d).select("ord", F.coalesce("reason", F.lit("")).alias("reason"), "outcome", "reminted", "statement_id")


@query(
    "quarantine_records",
    f"""WITH {PLACED_SQL} SELECT s.source_item_id, s.campaign, s.stage, s.reason, CASE WHEN reason = 'no_live_target' THEN '' ELSE mapping_method END AS mapping_method, coalesce(s.topic_id, '') AS attempted_topic_id, original_placement_hint, title AS statement_title,
    coalesce(list_aggregate(list_transform(h.hs, lambda x: x.m || '=' || x.h), 'string_agg', ','), '') AS placement_hints, confidence AS review_confidence, fallback_hint AS parent_candidate_ids, scope_note, home_hint AS preferred_home_node_id, s.affected_hint AS affected_existing_node_ids
    FROM split s JOIN hints h USING (ord) WHERE outcome = 'quarantined'""",
)
def quarantine_records(spark, d):
    r = merges.quarantine_records(split(spark, d))
    hints = F.array_join(F.transform("placement_hints", lambda x: F.concat_ws("=", x["method"], x["hint"])), ",")
    flat = r.select(*[c for c in r.columns[:-2] if c != "placement_hints"], hints.alias("placement_hints"), "new_node_candidate.*", "directory_assessment.*")
    return flat.withColumns({c: F.array_join(c, ",") for c in ("parent_candidate_ids", "affected_existing_node_ids")})


REPORT_SQL = " UNION ALL ".join(f"SELECT CASE WHEN reason IS NULL THEN 'added' ELSE 'quarantined' END AS state, '{n}' AS dimension, {c} AS value, count(*) AS n FROM judged WHERE {c} IS NOT NULL GROUP BY 1, 2, 3" for n, c in (("domain", "string_split(topic_id, '.')[1]"), ("stage", "stage"), ("method", "mapping_method"), ("reason", "reason")))


@query("placement_report", f"WITH {PLACED_SQL} {REPORT_SQL}")
def placement_report(spark, d):
    return agg.placement_report(placed(spark, d).withColumn("reason", merges.quarantine_reason()).withColumn("domain_id", F.substring_index("topic_id", ".", 1)))


MOVES = [("R1.N2", "D1", "25"), ("R1.N3", "D2", "26"), ("R2", "D3", "27"), ("R3.N3", "D4", "28")]
_INSIDE = "(topic_id = '{0}' OR starts_with(topic_id, '{0}.'))"
NUMBERS_SQL = """r AS (SELECT topic_id, parent_topic_id, depth, row_number() OVER (PARTITION BY parent_topic_id ORDER BY kind, pos, topic_id) AS rank FROM topics WHERE depth > 0),
    numbers AS (SELECT topic_id, substring(topic_id, 2) AS number FROM topics WHERE depth = 0 UNION ALL SELECT topic_id, substring(parent_topic_id, 2) || '.' || rank FROM r WHERE depth = 1
    UNION ALL SELECT a.topic_id, substring(b.parent_topic_id, 2) || '.' || b.rank || '.' || a.rank FROM r a JOIN r b ON a.parent_topic_id = b.topic_id WHERE a.depth = 2)"""
MOVED_SQL = f"""{NUMBERS_SQL}, mv AS (SELECT topic_id, CASE {" ".join(f"WHEN {_INSIDE.format(r)} THEN '{r}'" for r, _, _ in reversed(MOVES))} END AS moved_root, CASE {" ".join(f"WHEN {_INSIDE.format(r)} THEN '{n}'" for r, n, _ in reversed(MOVES))} ELSE domain_id END AS domain_id,
    CASE {" ".join(f"WHEN {_INSIDE.format(r)} THEN '{n}'" for r, _, n in reversed(MOVES))} END AS new_number, depth, parent_topic_id FROM topics),
    gone AS (SELECT mv.topic_id, mv.domain_id, moved_root, CAST(CASE WHEN moved_root IS NULL THEN mv.depth ELSE mv.depth - (len(string_split(moved_root, '.')) - 1) END AS INT) AS depth, CASE WHEN moved_root = mv.topic_id THEN '' ELSE coalesce(parent_topic_id, '') END AS parent_topic_id,
        CASE WHEN moved_root IS NULL THEN n.number ELSE new_number || substring(n.number, length(o.number) + 1) END AS number FROM mv JOIN numbers n USING (topic_id) LEFT JOIN numbers o ON o.topic_id = moved_root)"""


def extracted(spark: SparkSession, d: str) -> DataFrame:
    t = fixture(spark, d, "topics")
    return merges.extract_subtrees(t.join(win.display_numbers(t), "topic_id"), MOVES)


@query("extract_subtrees", f"WITH {MOVED_SQL} SELECT topic_id, domain_id, depth, parent_topic_id, number FROM gone")
def extract_subtrees(spark, d):
    return extracted(spark, d).select("topic_id", "domain_id", "depth", F.coalesce("parent_topic_id", F.lit("")).alias("parent_topic_id"), "number")


@query("extract_subtrees_report", f"WITH {MOVED_SQL} SELECT moved_root, domain_id, count(DISTINCT gone.topic_id) AS topics_moved, count(k.ord) AS statements_kept FROM gone LEFT JOIN (SELECT * FROM kept WHERE rn = 1) k ON k.topic_id = gone.topic_id WHERE moved_root IS NOT NULL GROUP BY 1, 2")
def extract_subtrees_report(spark, d):
    return merges.extract_report(extracted(spark, d), kept(spark, d))


@query("extract_subtrees_routes", f"WITH {MOVED_SQL} SELECT a.topic_id, a.ancestor_id AS chapter_id FROM (SELECT g.topic_id, g.topic_id AS ancestor_id FROM gone g UNION ALL SELECT g.topic_id, p.topic_id FROM gone g JOIN gone p ON g.parent_topic_id = p.topic_id UNION ALL SELECT g.topic_id, q.topic_id FROM gone g JOIN gone p ON g.parent_topic_id = p.topic_id JOIN gone q ON p.parent_topic_id = q.topic_id) a JOIN gone c ON c.topic_id = a.ancestor_id WHERE c.depth = CASE WHEN starts_with(c.domain_id, 'D') THEN 0 ELSE 1 END")
def extract_subtrees_routes(spark, d):
    moved = cut(extracted(spark, d))
    return src.node_routes(place.ancestors(moved), moved, [domain for _, domain, _ in MOVES])


def workbook(spark: SparkSession, d: str) -> DataFrame:
    t = fixture(spark, d, "topics")
    return merges.rename_export(t, place.breadcrumbs(t), t.where("depth = 0").select("domain_id", F.concat(F.lit("Domain "), "title").alias("display_name")))


@query("rename_export", "SELECT 'topic' AS record_type, 'topic:' || t.topic_id AS stable_id, t.domain_id AS batch_id, t.title AS current_title, p.path, (SELECT count(*) FROM topics c WHERE c.parent_topic_id = t.topic_id) AS child_count FROM topics t JOIN (SELECT a.topic_id, string_agg(u.title, '/' ORDER BY a.distance DESC) AS path FROM above a JOIN topics u ON a.ancestor_id = u.topic_id GROUP BY 1) p USING (topic_id) UNION ALL SELECT 'domain', 'domain:' || topic_id, topic_id, 'Domain ' || title, 'Domain ' || title, 1 FROM topics WHERE depth = 0")
def rename_export(spark, d):
    return workbook(spark, d).select("record_type", "stable_id", "batch_id", "current_title", F.array_join("path", "/").alias("path"), "child_count")


def renamed(exported: DataFrame) -> DataFrame:
    """The workbook with some new titles, some of them bad."""
    at = F.conv(F.substring(F.md5(F.col("topic_id").cast("binary")), 1, 2), 16, 10).cast("int") % 10
    new = F.when(at == 0, F.concat(F.lit("New "), "current_title")).when(at == 1, F.concat("current_title", F.lit(" "))).when(at == 2, "").when(at == 3, F.concat(F.lit("Two\n"), "current_title")).otherwise(F.col("current_title"))
    return exported.withColumn("new_title", new)


RENAMED_SQL = """b AS (SELECT 'topic:' || topic_id AS id, domain_id, parent_topic_id, topic_id, title, CAST('0x' || substr(md5(topic_id), 1, 2) AS INT) % 10 AS tenth FROM topics),
    w AS (SELECT *, CASE tenth WHEN 0 THEN 'New ' || title WHEN 1 THEN title || ' ' WHEN 2 THEN '' WHEN 3 THEN 'Two' || chr(10) || title ELSE title END AS new FROM b),
    twin AS (SELECT topic_id FROM (SELECT topic_id, count(*) OVER (PARTITION BY domain_id, parent_topic_id, lower(new)) AS n FROM w) WHERE n > 1)"""
_ROW = "SELECT '{0}' AS code, count(*) AS failed_count, min({1}) AS sample FROM {2}"


@query(
    "rename_validate",
    f"WITH {RENAMED_SQL} " + " UNION ALL ".join([_ROW.format(c, "id", f"w WHERE {x}") for c, x in (("duplicate_id", "false"), ("empty_title", "trim(new) = ''"), ("untrimmed_title", "trim(new) <> new"), ("multiline_title", "contains(new, chr(10))"), ("coverage", "false"), ("title_drift", "false"), ("protected_hash", "false"))])
    + " UNION ALL " + _ROW.format("sibling_collision", "topic_id", "twin") + " UNION ALL SELECT 'record_count', 1, 'workbook'",
)
def rename_validate(spark, d):
    exported = cut(workbook(spark, d))
    digest = agg.protected_hash(exported, "new_title").first()[0]
    return checks.rename_validate(renamed(exported), exported, fixture(spark, d, "topics"), exported.count() + 1, digest)


OCCURRENCES_SQL = "SELECT 'tree-' || domain_id AS file, topic_id, title FROM topics UNION ALL SELECT 'manifest', topic_id, title FROM topics WHERE depth < 2"


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    t = fixture(spark, d, "topics")
    return t.select(F.concat(F.lit("tree-"), "domain_id").alias("file"), "topic_id", "title").union(t.where("depth < 2").select(F.lit("manifest"), "topic_id", "title"))


@query("rename_apply", f"SELECT file, topic_id, CASE WHEN length(topic_id) % 2 = 0 THEN 'New ' || title ELSE title END AS title, length(topic_id) % 2 = 0 AS changed FROM ({OCCURRENCES_SQL})")
def rename_apply(spark, d):
    book = workbook(spark, d).withColumn("new_title", F.when(F.char_length("topic_id") % 2 == 0, F.concat(F.lit("New "), "current_title")).otherwise(F.col("current_title")))
    return merges.rename_apply(occurrences(spark, d), book)


def restored(spark: SparkSession, d: str) -> DataFrame:
    book = workbook(spark, d).withColumn("new_title", F.when(F.char_length("topic_id") % 2 == 0, F.concat(F.lit("New "), "current_title")).otherwise(F.col("current_title")))
    return merges.rename_apply(merges.rename_apply(occurrences(spark, d), book).drop("changed"), book, restore=True)


@query("rename_restore", f"SELECT file, topic_id, title, length(topic_id) % 2 = 0 AS changed FROM ({OCCURRENCES_SQL})")
def rename_restore(spark, d):
    return restored(spark, d)


@query("rename_restore_report", f"SELECT count(*) FILTER (length(topic_id) % 2 = 0) AS changed, count(DISTINCT CASE WHEN length(topic_id) % 2 = 0 THEN file END) AS files, count(*) AS restored FROM ({OCCURRENCES_SQL})")
def rename_restore_report(spark, d):
    return restored(spark, d).agg(F.count_if("changed").alias("changed"), F.countDistinct(F.when(F.col("changed"), F.col("file"))).alias("files"), F.count("title").alias("restored"))


# --- checks


@query(
    "check_render_contract",
    """WITH s AS (SELECT statement_id, title, CASE WHEN ord % 3 = 0 THEN '' ELSE latex END AS latex, plain, ord FROM statements) SELECT statement_id, 'missing_title' AS reason FROM s WHERE title = '' UNION ALL SELECT statement_id, 'missing_body' FROM s WHERE latex = '' AND plain = ''
    UNION ALL SELECT statement_id, 'assumptions_latex_is_no_list' FROM s WHERE ord % 5 = 1 UNION ALL SELECT statement_id, 'source_refs_is_no_list' FROM s WHERE ord % 7 = 1 UNION ALL SELECT statement_id, 'conclusion_is_no_object' FROM s WHERE ord % 4 = 3""",
)
def check_render_contract(spark, d):
    json = {
        "assumptions_latex": F.when(F.col("ord") % 5 == 1, F.concat(F.lit('"'), "statement_id", F.lit('"'))).otherwise('["x"]'),
        "source_refs": F.when(F.col("ord") % 7 == 1, "[1, ").when(F.col("ord") % 7 == 2, F.lit(None)).otherwise(" [] "),
        "conclusion": F.when(F.col("ord") % 4 == 3, "[]").when(F.col("ord") % 4 == 1, F.concat(F.lit('{"rate_class": "'), "statement_id", F.lit('"}'))),
    }
    return checks.render_contract(fixture(spark, d, "statements").withColumn("latex", F.when(F.col("ord") % 3 == 0, " ").otherwise(F.col("latex"))).withColumns(json))


@query("check_public_allowlist", f"WITH {PLACED_SQL} SELECT ord, stage, mapping_method FROM split WHERE outcome = 'public' AND mapping_method = 'campaign_existing_node'")
def check_public_allowlist(spark, d):
    rows = [(s, m) for s, ms in merges.ALLOWED.items() for m in ms if m != "campaign_existing_node"]
    allowed = spark.createDataFrame(rows, "stage string, mapping_method string")
    return checks.public_allowlist(split(spark, d).where("outcome = 'public'"), allowed).select("ord", "stage", "mapping_method")


@query("check_accounting", f"WITH {PLACED_SQL} SELECT count(*) AS candidates, count(*) FILTER (outcome = 'public') AS public, count(*) FILTER (outcome = 'quarantined') AS quarantined, count(*) FILTER (outcome = 'duplicate_title') AS duplicates, true AS balanced, 'candidates,public' AS misdeclared, (SELECT count(DISTINCT stage) FROM statements) AS layers, (SELECT count(DISTINCT stage) FROM statements WHERE stage <> 'current') AS partial_layers, CAST(1 AS BIGINT) AS misdeclared_layers FROM split")
def check_accounting(spark, d):
    layers = fixture(spark, d, "statements").groupBy("stage").agg(F.count("*").alias("records"))
    layers = layers.select("records", (F.col("stage") != "current").alias("partial_run"), (F.col("records") + F.when(F.col("stage") == "current", 1).otherwise(0)).alias("declared_records"), F.lit(True).alias("declared_partial"))
    return checks.accounting(split(spark, d), {"candidates": -1, "public": None, "balanced": 1 == 1}, layers)


@query("check_stats_stale", "SELECT topic_id, 'statements' AS field, statements + 1 AS declared, statements AS computed FROM direct WHERE length(topic_id) % 5 = 0")
def check_stats_stale(spark, d):
    now = cut(direct_counts(spark, d))
    told = now.withColumn("statements", F.col("statements") + F.when(F.char_length("topic_id") % 5 == 0, 1).otherwise(0))
    return checks.stats_stale(told, now, "topic_id", ["statements", "base", "intermediate"])


def broken(spark: SparkSession, d: str) -> DataFrame:
    """The topics, with nations repeated in one region and lost in another."""
    t = fixture(spark, d, "topics")
    return t.where("not (depth = 1 and domain_id = 'R2')").union(t.where("depth = 1 and domain_id = 'R1'")).union(t.where("depth = 0 and domain_id = 'R4'").withColumn("topic_id", F.lit("R9")))


BROKEN_SQL = "WITH b AS (SELECT * FROM topics WHERE NOT (depth = 1 AND domain_id = 'R2') UNION ALL SELECT * FROM topics WHERE depth = 1 AND domain_id = 'R1' UNION ALL SELECT 'R9', * EXCLUDE (topic_id) FROM topics WHERE depth = 0 AND domain_id = 'R4'), c AS (SELECT 'duplicate_topic_id' AS code, count(*) AS failed_count, min(topic_id) AS sample FROM (SELECT topic_id FROM b GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'missing_parent', count(*), min(topic_id) FROM b WHERE parent_topic_id NOT IN (SELECT topic_id FROM b) UNION ALL SELECT 'root_count', count(*), min(domain_id) FROM (SELECT domain_id FROM b GROUP BY 1 HAVING count(*) FILTER (parent_topic_id IS NULL) <> 1))"


EXPECTED_SQL = """SELECT * FROM c UNION ALL SELECT 'promoted_root', 2, 'R1.N1' UNION ALL SELECT 'moved_root_in_old_domain', 1, 'R3' UNION ALL SELECT 'unexpected_parent', 2, 'R2.N2' UNION ALL SELECT 'unexpected_title', 1, 'R1'
    UNION ALL SELECT 'subtree_size', 1, 'R3' UNION ALL SELECT 'subtree_size', 0, NULL UNION ALL SELECT 'route_target', count(DISTINCT x), min(x) FROM (SELECT topic_id AS x FROM topics WHERE depth = 1 AND domain_id = 'R2' UNION ALL SELECT 'nowhere')"""


@query("check_structure", f"{BROKEN_SQL} {EXPECTED_SQL}")
def check_structure(spark, d):
    t = broken(spark, d)
    routes = fixture(spark, d, "topics").where("depth = 1").select("topic_id", F.lit("nowhere").alias("chapter_id"))
    size = t.where("topic_id = 'R4' or startswith(topic_id, 'R4.')").count()
    return checks.structure(t, {"R0": "R0", "R1.N1": "R1", "R7": "R7"}, {"R3": "R3", "R4": "R0"}, {"R1.N1": "R1", "R3.N3": "R1", "R2.N2": "R2"}, {"R1": "EUROPE?", "R0": "AFRICA"}, {"R3": 1, "R4": size}, routes)


@query("check_forbidden_text", "SELECT topic_id, title FROM topics WHERE contains(lower(title), 'supplier') OR contains(lower(title), 'brand#1')")
def check_forbidden_text(spark, d):
    return checks.forbidden_text(fixture(spark, d, "topics"), ["Supplier", "BRAND#1"]).select("topic_id", "title")


@query("check_stale_placement", "SELECT statement_id, CASE WHEN ord % 10 = 0 THEN 'aliased_node' ELSE 'ancestor_in_revision' END AS code FROM attached WHERE ord % 10 = 0 OR (mapping_method = 'nearest_canonical_ancestor' AND starts_with(topic_id, 'R2.'))")
def check_stale_placement(spark, d):
    a = attached(spark, d)
    aliases = a.where("ord % 10 = 0").select(F.concat("source_node_id", F.lit("#")).alias("source_node_id")).distinct()
    marked = a.withColumn("source_node_id", F.when(F.col("ord") % 10 == 0, F.concat("source_node_id", F.lit("#"))).otherwise(F.col("source_node_id")))
    return checks.stale_placement(marked, aliases, text.in_subtree(F.col("topic_id"), "R2")).select("statement_id", "code")


@query("validation_report", f"{BROKEN_SQL} SELECT CASE WHEN count(*) FILTER (failed_count > 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, string_agg(CASE WHEN failed_count > 0 THEN code END, ',' ORDER BY code) AS failing_codes, CAST(sum(failed_count) AS BIGINT) AS failed_rows FROM c")
def validation_report(spark, d):
    return checks.report(checks.structure(broken(spark, d)))


# --- the issue log


def events_again(spark: SparkSession, d: str) -> str:
    """The events as files of a stream, some of them delivered twice."""
    e = fixture(spark, d, "issue_events")
    path = scratch(spark, "issue-events")
    e.union(e.where("event_id % 10 = 0")).repartition(4, "event_id").write.parquet(path)
    return path


def drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream writes until it has read all its input."""
    out = scratch(spark, name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, name)).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("issue_event_stream", "SELECT event_id, issue_id, action FROM issue_events")
def issue_event_stream(spark, d):
    return drained(spark, log.read_events(spark, events_again(spark, d), late="40 days"), "issue-log").select("event_id", "issue_id", "action")


ACTIVITY_SQL = "SELECT time_bucket(INTERVAL 1 DAY, created_at) AS window_start, action, count(*) AS n FROM issue_events GROUP BY 1, 2"


@query("issue_activity", ACTIVITY_SQL)
def issue_activity(spark, d):
    return log.activity(fixture(spark, d, "issue_events"))


@query("issue_activity_stream", ACTIVITY_SQL)
def issue_activity_stream(spark, d):
    """The same by a stream in append mode. A last event, past every other's watermark, closes their windows; its own stays open."""
    path = events_again(spark, d)
    last = fixture(spark, d, "issue_events").agg((F.max("created_at") + F.expr("INTERVAL 3 DAYS")).alias("created_at"))
    closing = last.select(F.lit(-1).cast("bigint").alias("event_id"), F.lit("").alias("issue_id"), F.lit("closing").alias("action"), "created_at")
    closing.write.mode("append").parquet(path)
    return drained(spark, log.activity(log.read_events(spark, path)), "issue-activity")


#: What counts as an edit among the events of the test table.
EDITS = ("purchase",)
STATE_SQL = "SELECT issue_id, max_by(action, (created_at, event_id)) AS status, max(created_at) AS updated_at, max_by(event_id, (created_at, event_id)) AS last_event_id, count(*) AS n_events, count(*) FILTER (action = 'purchase') + 1 AS version, min(created_at) AS opened_at FROM issue_events GROUP BY 1"


@query("issue_state", STATE_SQL)
def issue_state(spark, d):
    return log.state(fixture(spark, d, "issue_events"), EDITS)


@query("issue_state_stream", STATE_SQL)
def issue_state_stream(spark, d):
    """The state kept by micro-batches equals that of all events."""
    out = scratch(spark, "issue-state")
    events = log.read_events(spark, events_again(spark, d), late="40 days", files=2)
    events.writeStream.foreachBatch(log.upsert_state(out, EDITS, compact=2)).option("checkpointLocation", scratch(spark, "issue-state")).trigger(availableNow=True).start().awaitTermination()
    return log.read_state(spark, out)


def issues(spark: SparkSession, d: str) -> DataFrame:
    return log.state(fixture(spark, d, "issue_events"), EDITS).withColumn("status", F.when(F.col("status") == "purchase", "resolved").otherwise(F.col("status")))


ISSUES_SQL = f"issues AS (SELECT * REPLACE (CASE WHEN status = 'purchase' THEN 'resolved' ELSE status END AS status) FROM ({STATE_SQL}))"


@query("issue_counts", f"WITH {ISSUES_SQL} SELECT count(*) AS total, count(*) FILTER (status <> 'resolved') AS open, count(*) FILTER (status = 'resolved') AS resolved, (SELECT count(*) FROM issue_events) AS history_events FROM issues")
def issue_counts(spark, d):
    return agg.issue_counts(issues(spark, d), fixture(spark, d, "issue_events"))


@query(
    "retry_due",
    """WITH e AS (SELECT event_id, issue_id, action, created_at, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'sending' WHEN 2 THEN 'failed' ELSE 'sent' END AS remote_status FROM issue_events)
    SELECT event_id, CAST((row_number() OVER (PARTITION BY action ORDER BY event_id) - 1) * 250 AS INT) AS delay_ms FROM e WHERE remote_status IN ('pending', 'failed') OR (remote_status = 'sending' AND (event_id % 3 = 0 OR created_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 60 SECOND))""",
)
def retry_due(spark, d):
    e = fixture(spark, d, "issue_events")
    status = F.element_at(F.array(*map(F.lit, ("pending", "sending", "failed", "sent"))), (F.col("event_id") % 4 + 1).cast("int"))
    attempt = F.when(F.col("event_id") % 3 == 0, "never").otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    due = log.retry_due(e.select("event_id", F.col("action").alias("queue"), F.col("event_id").alias("issue_id"), status.alias("remote_status"), attempt.alias("attempt_at")), F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return due.select("event_id", "delay_ms")


REMOTE_SQL = "(SELECT *, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'sending' WHEN 2 THEN 'failed' ELSE 'sent' END AS remote_status FROM issue_events)"
TIMEOUTS_SQL = f"""SELECT event_id, issue_id, CASE WHEN remote_status = 'sending' THEN 'timeout' ELSE remote_status END AS reason, CASE WHEN remote_status = 'sending' THEN created_at + INTERVAL 60 SECOND ELSE created_at END AS due_at
    FROM (SELECT *, lead(created_at) OVER (PARTITION BY issue_id ORDER BY created_at, event_id) AS next FROM {REMOTE_SQL}) WHERE remote_status IN ('pending', 'failed') OR (remote_status = 'sending' AND (next IS NULL OR next > created_at + INTERVAL 60 SECOND))"""
REMOTE = "case event_id % 4 when 0 then 'pending' when 1 then 'sending' when 2 then 'failed' else 'sent' end"


def closed_events(spark: SparkSession, d: str) -> str:
    """events_again(), and an event that moves the watermark past all others."""
    path = events_again(spark, d)
    last = fixture(spark, d, "issue_events").agg((F.max("created_at") + F.expr("INTERVAL 100 DAYS")).alias("created_at"))
    last.select(F.lit(-1).cast("bigint").alias("event_id"), F.lit("").alias("issue_id"), F.lit("closing").alias("action"), "created_at").write.mode("append").parquet(path)
    return path


@query("retry_timeouts", TIMEOUTS_SQL)
def retry_timeouts(spark, d):
    return stateful.retries(fixture(spark, d, "issue_events").withColumn("action", F.expr(REMOTE)))


@query("retry_timeouts_stream", TIMEOUTS_SQL)
def retry_timeouts_stream(spark, d):
    """The same by timers, in two micro-batches and more."""
    with stateful.rocksdb(spark):
        events = log.read_events(spark, closed_events(spark, d), late="40 days", files=4).withColumn("action", F.when(F.col("event_id") < 0, F.col("action")).otherwise(F.expr(REMOTE)))
        return drained(spark, stateful.retry_stream(events), "retries")


@query("issue_state_timers", STATE_SQL)
def issue_state_timers(spark, d):
    """The state by a stream that lets go of issues whose last event was a purchase ten days ago; their spells add up to the state over all events."""
    with stateful.rocksdb(spark):
        events = log.read_events(spark, closed_events(spark, d), late="40 days", files=4)
        written = drained(spark, stateful.state_stream(events, EDITS, closed=EDITS, keep_days=10), "issue-spells")
    return stateful.current_state(written.where("issue_id <> ''"))


@query("issue_history", "SELECT issue_id, event_id, CAST(row_number() OVER (PARTITION BY issue_id ORDER BY created_at DESC, event_id DESC) AS INT) AS rank FROM issue_events QUALIFY rank <= 50")
def issue_history(spark, d):
    return log.history(fixture(spark, d, "issue_events")).select("issue_id", "event_id", "rank")


@query("import_history", "WITH s AS (SELECT issue_id, max(version) AS v FROM edits GROUP BY 1) SELECT CAST(issue_id AS VARCHAR) AS issue_id, role AS action, version FROM (SELECT issue_id, action AS role, version FROM edits WHERE issue_id % 2 = 0 UNION ALL SELECT issue_id, 'imported', v FROM s WHERE issue_id % 2 = 1)")
def import_history(spark, d):
    e = fixture(spark, d, "edits").select(F.col("issue_id").cast("string").alias("issue_id"), "action", F.col("version").alias("created_at"))
    now = e.groupBy("issue_id").agg(F.max("created_at").alias("created_at"))
    return log.import_history(e.where("issue_id % 2 = 0"), now).withColumnRenamed("created_at", "version")


@query("migrate_issue_routes", "SELECT issue_id, 'R8' AS domain_id, CASE WHEN CAST(issue_id AS BIGINT) % 2 = 0 THEN 'R1.N6' ELSE 'R1.N2' END AS node_id, CASE WHEN CAST(issue_id AS BIGINT) % 3 = 0 THEN 'sent' ELSE 'pending' END AS remote_status, '#/R8/' || CASE WHEN CAST(issue_id AS BIGINT) % 2 = 0 THEN 'R1.N6' ELSE 'R1.N2' END AS page_hash FROM (SELECT DISTINCT issue_id FROM issue_events)")
def migrate_issue_routes(spark, d):
    n = F.col("issue_id").cast("long")
    i = fixture(spark, d, "issue_events").select("issue_id").distinct().select("issue_id", F.lit("R1").alias("domain_id"), F.when(n % 2 == 0, "R1.N1").otherwise("R1.N2").alias("node_id"), F.when(n % 3 == 0, "sent").alias("remote_status"))
    defaults = spark.createDataFrame([], "legacy_domain_id string, new_domain_id string, default_node_id string")
    prefixes = spark.createDataFrame([("R1", "R1", "R8")], "old_domain_id string, node_prefix string, domain_id string")
    to = place.resolve_route(i.select(F.col("issue_id").alias("key"), "domain_id", "node_id"), defaults, prefixes, fixture(spark, d, "aliases").select(F.lit("R8").alias("domain_id"), "source_node_id", "target_node_id"))
    return log.migrate_routes(i, to)


@query("issue_queue", f"WITH {ISSUES_SQL} SELECT issue_id, status, updated_at FROM issues WHERE status <> 'resolved'")
def issue_queue(spark, d):
    return log.queue(issues(spark, d), "open").select("issue_id", "status", "updated_at")


@query(
    "review_packet",
    f"""WITH {ISSUES_SQL}, h AS (SELECT issue_id, string_agg(event_id || ':' || action, ',' ORDER BY rank) AS history FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY created_at DESC, event_id DESC) AS rank FROM issue_events) WHERE rank <= 50 GROUP BY 1)
    SELECT issue_id, status, history, (SELECT count(*) FROM issues) AS total, (SELECT count(*) FROM issues WHERE status <> 'resolved') AS open, (SELECT count(*) FROM issues WHERE status = 'resolved') AS resolved, (SELECT count(*) FROM issue_events) AS history_events FROM issues JOIN h USING (issue_id)""",
)
def review_packet(spark, d):
    """Small packets, written and read again."""
    path = scratch(spark, "packets")
    log.write_packets(log.review_packets(issues(spark, d), fixture(spark, d, "issue_events"), packet_bytes=4096), path)
    schema = "summary struct<total:bigint,open:bigint,resolved:bigint,history_events:bigint>, issues array<struct<issue_id:string,status:string,history:array<struct<rank:int,event_id:bigint,action:string>>>>"
    read = src.read_documents(spark, path).select(F.from_json("value", schema).alias("d")).select("d.summary.*", F.explode("d.issues").alias("i"))
    told = F.array_join(F.transform("i.history", lambda x: F.concat_ws(":", x["event_id"].cast("string"), x["action"])), ",")
    return read.select("i.issue_id", "i.status", told.alias("history"), "total", "open", "resolved", "history_events")
