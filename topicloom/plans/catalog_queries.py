"""Queries on sources, projections, joins and aggregations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.functions import formula, text
from topicloom.operators import aggregates as agg
from topicloom.operators import placement as place
from topicloom.operators import projections as proj
from topicloom.operators import windows as win
from topicloom.plans.fixtures import fixture, table
from topicloom.plans.registration import query
from topicloom.session import cut, scratch
from topicloom.sources import blocks
from topicloom.sources import catalog as src

KEY_SQL = r"replace(lower(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))), 'ß', 'ss')"
CHAIN_SQL = "list_transform(range(1, len(string_split({0}, '.')) + 1), lambda i: array_to_string(string_split({0}, '.')[1:i], '.'))"


def attached(spark: SparkSession, d: str) -> DataFrame:
    return place.attach_nearest(fixture(spark, d, "statements"), fixture(spark, d, "topics"))


def kept(spark: SparkSession, d: str) -> DataFrame:
    return win.first_rows(attached(spark, d).where("topic_id is not null"))


# --- sources and sinks


def catalogs(spark: SparkSession, d: str) -> DataFrame:
    """The topic tree as catalogue documents, nested, written as one JSON file a domain and read again."""
    t = fixture(spark, d, "topics").withColumn("title", F.coalesce("title", F.lit("")))
    leaf = t.where("depth = 2").select("parent_topic_id", "kind", "pos", F.struct("topic_id", "title").alias("n"))
    leaf = leaf.groupBy("parent_topic_id").agg(F.array_sort(F.collect_list(F.struct("kind", "pos", "n"))).alias("x")).select("parent_topic_id", F.col("x.n").alias("kids"))
    mid = t.where("depth = 1").join(leaf.withColumnRenamed("parent_topic_id", "topic_id"), "topic_id", "left")
    mid = mid.select("parent_topic_id", F.struct("pos", F.struct("topic_id", "title", F.coalesce("kids", F.array().cast("array<struct<topic_id:string,title:string>>")).alias("children")).alias("n")).alias("x"))
    mid = mid.groupBy("parent_topic_id").agg(F.array_sort(F.collect_list("x"), lambda a, b: (a["pos"] - b["pos"]).cast("int")).alias("x")).select("parent_topic_id", F.col("x.n").alias("kids"))
    docs = t.where("depth = 0").join(mid.withColumnRenamed("parent_topic_id", "topic_id"), "topic_id", "left")
    docs = docs.select("domain_id", F.col("title").alias("display_name"), F.array(F.struct("topic_id", "title", F.col("kids").alias("children"))).alias("roots"))
    path = scratch(spark, "catalogs")
    docs.repartition("domain_id").write.partitionBy("domain_id").json(path)
    return src.read_json(spark, path, src.CATALOG).withColumn("domain_id", F.regexp_extract("file", "domain_id=([^/]+)", 1))


CATALOG_SQL = "SELECT topic_id AS domain_id, title AS display_name, CAST(1 AS BIGINT) AS roots FROM topics WHERE depth = 0"
TREE_SQL = "SELECT domain_id, topic_id, title, coalesce(parent_topic_id, '') AS parent_topic_id, depth FROM topics"
#: Rows of a block here, so that topics of every test table have several.
BLOCK_ROWS = 64


def tree_blocks(spark: SparkSession, d: str) -> str:
    """The topic tree as a catalogue of heads and blocks, on files."""
    t = fixture(spark, d, "topics").withColumn("title", F.coalesce("title", F.lit("")))
    path = scratch(spark, "blocks")
    blocks.write_blocks(t, t.where("depth = 0").select("domain_id", F.col("title").alias("display_name")), ["kind", "pos", "topic_id"], path, BLOCK_ROWS)
    return path


@query("read_catalog", CATALOG_SQL)
def read_catalog(spark, d):
    return blocks.read_heads(spark, tree_blocks(spark, d)).select("domain_id", "display_name", "roots")


@query("flatten_tree", f"{TREE_SQL.removesuffix(' FROM topics')}, row_number() OVER (PARTITION BY domain_id, parent_topic_id ORDER BY kind, pos, topic_id) AS place FROM topics")
def flatten_tree(spark, d):
    """With each topic's place among its siblings, over all their blocks."""
    flat = blocks.flatten_blocks(blocks.read_blocks(spark, tree_blocks(spark, d)))
    return flat.select("domain_id", "topic_id", "title", F.coalesce("parent_topic_id", F.lit("")).alias("parent_topic_id"), "depth", F.element_at("path", -1).alias("place"))


@query(
    "lost_blocks",
    f"WITH s AS (SELECT domain_id, parent_topic_id AS parent, (row_number() OVER (PARTITION BY parent_topic_id ORDER BY kind, pos, topic_id) - 1) // {BLOCK_ROWS} AS block FROM topics WHERE depth = 2) SELECT DISTINCT domain_id, parent, block FROM s WHERE block % 2 = 1",
)
def lost_blocks(spark, d):
    """Every other block of the nations is lost."""
    path = tree_blocks(spark, d)
    found = blocks.read_blocks(spark, path).where("block % 2 = 0")
    return blocks.lost_blocks(blocks.read_heads(spark, path), found)


@query("read_nested_catalog", CATALOG_SQL)
def read_nested_catalog(spark, d):
    return catalogs(spark, d).select("domain_id", "display_name", F.size("roots").cast("long").alias("roots"))


@query("flatten_nested_tree", TREE_SQL)
def flatten_nested_tree(spark, d):
    return src.flatten_tree(catalogs(spark, d)).select("domain_id", "topic_id", "title", F.coalesce("parent_topic_id", F.lit("")).alias("parent_topic_id"), "depth")


@query("restore_domain", "SELECT domain_id, topic_id, CASE WHEN pos % 3 = 0 THEN 'stub ' ELSE 'shard ' END || title AS root, pos % 3 <> 0 AS restored FROM topics WHERE depth > 0")
def restore_domain(spark, d):
    chapters = fixture(spark, d, "topics").where("depth > 0").withColumn("shard_url", src.shard_url(F.col("domain_id"), F.col("topic_id")))
    shards = chapters.where("pos % 3 <> 0").select("shard_url", F.col("topic_id").alias("chapter_id"), F.concat(F.lit("shard "), "title").alias("root"))
    return src.restore_domain(chapters.select("domain_id", "topic_id", "shard_url", F.concat(F.lit("stub "), "title").alias("raw")), shards)


FILES_SQL = """f AS (SELECT source_item_id, campaign, CASE WHEN stage = '0809_campaign_build' THEN 'build' ELSE 'review' END AS phase, CAST(split_part(substring(source_item_id, 2), '-', 1) AS BIGINT) // 2048 AS bucket, ord FROM candidates),
    files AS (SELECT *, campaign || '-' || bucket || '.json' AS file_name, CASE WHEN bucket % 13 = 6 THEN 'no_validation' WHEN bucket % 7 = 3 THEN 'not_passed' WHEN bucket % 11 = 5 THEN 'unparsable' WHEN campaign = 'camp4' THEN 'other_id' ELSE 'passed' END AS outcome FROM f)"""


def shard_files(spark: SparkSession, d: str) -> DataFrame:
    """Candidates as shard files, one for each campaign, phase and run of orders, with their validation files: some missing, some failed, some broken off, some of another shard."""
    order = F.expr("cast(substring(substring_index(source_item_id, '-', 1), 2) as bigint)")
    k = fixture(spark, d, "candidates").select("source_item_id", "campaign", F.when(F.col("stage") == "0809_campaign_build", "build").otherwise("review").alias("phase"), F.floor(order / 2048).alias("bucket"), "ord")
    shards = k.groupBy("campaign", "phase", "bucket").agg(F.array_sort(F.collect_list(F.struct("ord", "source_item_id"))).alias("items"))
    stem = F.concat_ws("-", "campaign", "bucket")
    body = F.to_json(F.struct(F.when(F.col("campaign") == "camp4", "other").otherwise(stem).alias("shard_id"), "items"))
    body = F.when(F.col("bucket") % 11 == 5, F.expr("'{\"shard_id\": \"broken off\", \"items\": [{'")).otherwise(body)
    named = shards.select("campaign", "phase", F.concat(stem, F.lit(".json")).alias("name"), "bucket", body.alias("value"))
    status = F.when(F.col("bucket") % 7 == 3, F.when(F.col("bucket") % 2 == 0, '{"status": "FAIL"}').otherwise("{")).otherwise('{"status": "PASS"}')
    files = named.select("campaign", "phase", F.lit(src.SHARDS).alias("kind"), "name", "value").union(named.where("bucket % 13 <> 6").select("campaign", "phase", F.lit(src.VALIDATIONS), "name", status))
    path = scratch(spark, "shard-files")
    files.write.partitionBy("campaign", "phase", "kind", "name").text(path)
    return src.read_shards(spark, path)


@query("validated_shard_items", f"WITH {FILES_SQL} SELECT source_item_id, campaign, phase, file_name, ord FROM (SELECT *, row_number() OVER (PARTITION BY campaign, phase, source_item_id ORDER BY file_name DESC, ord DESC) AS rn FROM files WHERE outcome = 'passed') WHERE rn = 1")
def validated_shard_items(spark, d):
    return src.validated_items(shard_files(spark, d)).select("source_item_id", "campaign", "phase", "file_name", F.get_json_object("item", "$.ord").alias("ord"))


@query("shard_outcomes", f"WITH {FILES_SQL} SELECT campaign, phase, file_name, outcome, CASE WHEN outcome = 'passed' THEN count(*) ELSE 0 END AS items FROM files GROUP BY 1, 2, 3, 4")
def shard_outcomes(spark, d):
    return shard_files(spark, d).select("campaign", "phase", "file_name", "outcome", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("items"))


@query(
    "source_evidence",
    """WITH e AS (SELECT campaign, source_item_id, max_by(locator, ord) AS locator FROM candidates WHERE stage <> '0809_campaign_build' GROUP BY campaign, source_item_id)
    SELECT k.ord, coalesce(e.locator, '') AS locator, '' AS source_path FROM candidates k LEFT JOIN e USING (campaign, source_item_id)""",
)
def source_evidence(spark, d):
    k = fixture(spark, d, "candidates")
    ledger = k.where("stage <> '0809_campaign_build'").select("campaign", "source_item_id", F.lit("").alias("source_path"), "locator", "ord")
    return src.source_evidence(k.select("campaign", "source_item_id", "ord"), ledger).select("ord", "locator", "source_path")


@query("write_chapter_shards", "SELECT '00' || substring(t.domain_id, 2, 1) AS domain_id, t.topic_id, a.ancestor_id AS chapter_id, t.title FROM above a JOIN topics t ON a.topic_id = t.topic_id JOIN topics c ON a.ancestor_id = c.topic_id WHERE c.depth = 1")
def write_chapter_shards(spark, d):
    t = fixture(spark, d, "topics")
    rows = t.join(src.node_routes(place.ancestors(t), t), "topic_id").withColumn("domain_id", F.concat(F.lit("00"), F.substring("domain_id", 2, 1)))
    path = scratch(spark, "shards")
    src.write_chapter_shards(rows.where("domain_id < '003'"), path, file_rows=100)
    src.write_chapter_shards(rows.where("domain_id > '001'"), path, file_rows=100)  # a domain again, two more for the first time
    src.remove_old_shards(spark, path)
    return src.read_chapter_shards(spark, path, "topic_id string, chapter_id string, title string").select("domain_id", "topic_id", "chapter_id", "title")


@query("chapter_stubs", "SELECT c.topic_id, c.title, 'shards/' || c.domain_id || '/' || lower(replace(c.topic_id, '.', '-')) || '.json' AS shard_url, count(t.topic_id) AS lazy_child_count FROM topics c LEFT JOIN topics t ON t.parent_topic_id = c.topic_id WHERE c.depth = 1 GROUP BY 1, 2, 3")
def chapter_stubs(spark, d):
    return src.chapter_stubs(fixture(spark, d, "topics")).select("topic_id", "title", "shard_url", "lazy_child_count")


@query("node_routes", "SELECT a.topic_id, a.ancestor_id AS chapter_id FROM above a JOIN topics c ON a.ancestor_id = c.topic_id WHERE (c.depth = 1 AND c.domain_id <> 'R2') OR (c.depth = 0 AND c.domain_id = 'R2')")
def node_routes(spark, d):
    t = fixture(spark, d, "topics")
    return src.node_routes(place.ancestors(t), t, ["R2"])


@query("file_digests", "SELECT 'kind=' || kind AS file_name, CASE WHEN kind = 'region' THEN 'stale' WHEN kind = 'nation' THEN 'unrecorded' END AS problem FROM (SELECT DISTINCT kind FROM topics) WHERE kind IN ('region', 'nation') UNION ALL SELECT 'kind=gone', 'missing'")
def file_digests(spark, d):
    """The topics' files, a document a kind, against recorded digests, some of which are wrong, missing or of a file that isn't there."""
    path = scratch(spark, "digests")
    line = F.to_json(F.struct("topic_id", "title"))
    text_of = cut(fixture(spark, d, "topics").groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list(line)), ",").alias("value")))
    text_of.repartition("kind").write.partitionBy("kind").text(path)
    found = src.file_digests(spark, path, "part-*")
    told = text_of.where("kind <> 'nation'").select(F.concat(F.lit("kind="), "kind").alias("folder"), F.when(F.col("kind") == "region", "0").otherwise(F.sha2(F.concat("value", F.lit("\n")).cast("binary"), 256)).alias("sha256"))
    return src.stale_digests(found, told.union(spark.createDataFrame([("kind=gone", "0")], "folder string, sha256 string")), "folder").withColumnRenamed("folder", "file_name")


# --- projections


@query("normalize_text", f"SELECT doc_id, sha256({KEY_SQL.format('text')}) AS key_sha FROM documents")
def normalize_text(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.sha2(text.normalize_text(F.col("text")).cast("binary"), 256).alias("key_sha"))


@query("statement_fingerprint", f"SELECT statement_id, sha256(lower(topic_id) || chr(31) || title_key || chr(31) || {KEY_SQL.format('latex')} || chr(31) || {KEY_SQL.format('plain')}) AS fingerprint FROM attached WHERE topic_id IS NOT NULL")
def statement_fingerprint(spark, d):
    a = attached(spark, d).where("topic_id is not null")
    return a.select("statement_id", text.fingerprint(*[F.col(c) for c in ("topic_id", "title", "latex", "plain")]).alias("fingerprint"))


@query("stable_ids", f"SELECT ord, 'stmt_0809_' || substring(sha256(source_item_id), 1, 20) AS statement_id, parent_hint || '.WEB' || upper(substring(sha256(parent_hint || chr(10) || {KEY_SQL.format('title')}), 1, 12)) AS container_id FROM candidates")
def stable_ids(spark, d):
    k = fixture(spark, d, "candidates")
    return k.select("ord", text.item_id(F.col("source_item_id")).alias("statement_id"), text.container_id(F.col("parent_hint"), text.normalize_text(F.col("title"))).alias("container_id"))


@query("first_non_empty", "SELECT statement_id, coalesce(nullif(plain, ''), nullif(title, ''), latex) AS label FROM statements")
def first_non_empty(spark, d):
    return fixture(spark, d, "statements").select("statement_id", text.first_non_empty(F.col("plain"), F.col("title"), F.col("latex")).alias("label"))


@query("has_body", "SELECT statement_id FROM statements WHERE title <> '' AND (plain <> '' OR latex <> '')")
def has_body(spark, d):
    return fixture(spark, d, "statements").where(proj.has_body()).select("statement_id")


@query("strip_regenerated", "SELECT statement_id, stage FROM statements WHERE stage = 'current'")
def strip_regenerated(spark, d):
    return proj.strip_regenerated(fixture(spark, d, "statements")).select("statement_id", "stage")


NORMAL_SQL = """SELECT statement_id AS id, 'knowledge_statement' AS node_type, coalesce(nullif(title, ''), 'Untitled statement') AS title, topic_id, topic_id AS original_topic_id, topic_id AS mapped, 'exact_topic_id' AS mapping_method, layer_role, coalesce(nullif(content_kind, ''), 'unknown') AS content_kind, latex, plain,
    CASE WHEN ord % 4 = 0 THEN 'Book ' || ord % 9 WHEN ord % 4 = 1 THEN 'src' || ord % 3 ELSE '' END AS witnesses, CASE WHEN ord % 2 = 0 THEN 'A,B' ELSE '' END AS assumptions, ord % 6 = 0 AS proof_included,
    CASE WHEN layer_role <> 'base_statement_layer' THEN 'context=' || ord % 5 || ',source_path=,stage=' || stage ELSE '' END AS metadata, ord FROM kept WHERE rn = 1"""


def with_parts(statements: DataFrame) -> DataFrame:
    """Statements with witnesses, references, lists and a context, as some have them."""
    witness = lambda source, title: F.array(F.struct(source.alias("source"), title.cast("string").alias("source_title"), F.lit("p. 1").alias("locator")))
    of = lambda n: F.concat(F.lit("src"), F.col("ord") % n)
    return statements.withColumns(
        {
            "source_witnesses": F.when(F.col("ord") % 4 == 0, witness(of(3), F.concat(F.lit("Book "), F.col("ord") % 9))).when(F.col("ord") % 4 == 1, F.array().cast(proj.SOURCES)),
            "source_refs": F.when(F.col("ord") % 4 < 2, witness(of(3), F.lit(None))),
            "assumptions_latex": F.when(F.col("ord") % 2 == 0, F.array(F.lit("A"), F.lit("B"))),
            "proof_included": F.when(F.col("ord") % 6 == 0, True),
            "context": F.create_map(F.lit("context"), (F.col("ord") % 5).cast("string")),
        }
    )


def canonical_columns(s: DataFrame) -> DataFrame:
    """Canonical statements with their lists and maps as texts."""
    entries = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return s.select(
        "id", "node_type", "title", "topic_id", "original_topic_id", F.array_join("mapped_topic_ids", ",").alias("mapped"), "mapping_method", "layer_role", "content_kind", "latex", "plain",
        F.array_join(F.col("source_witnesses.source_title"), ",").alias("witnesses"), F.array_join("assumptions_latex", ",").alias("assumptions"), "proof_included", F.coalesce(F.array_join(entries, ","), F.lit("")).alias("metadata"), "ord",
    )


@query("normalize_statement", NORMAL_SQL)
def normalize_statement(spark, d):
    return canonical_columns(proj.normalize_statement(with_parts(kept(spark, d))))


@query("classify_convergence", "SELECT statement_id, CASE WHEN plain LIKE '%HIGH%' THEN 'failure_boundary' WHEN latex LIKE 'O%' OR ord % 5 = 0 THEN 'complexity_bound' ELSE 'theorem' END AS kind FROM statements")
def classify_convergence(spark, d):
    s = fixture(spark, d, "statements")
    notes = F.array(F.lit("stated"), F.when(F.contains("plain", F.lit("HIGH")), "It may DIVERGE").otherwise("fine"))
    rate = F.when(F.startswith("latex", F.lit("O")), "linear").otherwise("None")
    return s.select("statement_id", proj.classify_convergence(notes, rate, F.when(F.col("ord") % 5 == 0, "bound")).alias("kind"))


@query(
    "placement_hints",
    """WITH h AS (SELECT *, latex <> '' AND trim(node_hint) <> '' AS node, locator <> 'loc0' AS up FROM candidates) SELECT ord, CAST(0 AS INT) AS pos, 'node' AS method, node_hint AS hint FROM h WHERE node
    UNION ALL SELECT ord, CAST(CASE WHEN node THEN 1 ELSE 0 END AS INT), 'parent', parent_hint FROM h WHERE up
    UNION ALL SELECT ord, CAST(0 AS INT), 'campaign_single_affected_node', root_hint FROM h WHERE NOT node AND NOT up""",
)
def placement_hints(spark, d):
    k = fixture(spark, d, "candidates")
    fields = {"node": F.array(F.when(F.col("latex") != "", F.col("node_hint")).otherwise(" ")), "parent": F.array(F.lit(None), F.when(F.col("locator") != "loc0", F.col("parent_hint")))}
    return k.select("ord", F.posexplode(proj.placement_hints(fields, F.array("root_hint"))).alias("pos", "h")).select("ord", "pos", "h.*")


@query("id_ancestors", f"SELECT topic_id, unnest({CHAIN_SQL.format('topic_id')}) AS prefix FROM topics")
def id_ancestors(spark, d):
    return fixture(spark, d, "topics").select("topic_id", F.explode(text.id_prefixes(F.col("topic_id"))).alias("prefix"))


@query("chapter_slug", "SELECT topic_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM topics")
def chapter_slug(spark, d):
    return fixture(spark, d, "topics").select("topic_id", text.chapter_slug(F.col("title")).alias("slug"))


@query("renumber_subtree", "SELECT topic_id, CASE WHEN topic_id = 'R1.N1' OR starts_with(topic_id, 'R1.N1.') THEN 'X' || substring(topic_id, 6) ELSE topic_id END AS number, CAST(CASE WHEN topic_id = 'R1.N1' OR starts_with(topic_id, 'R1.N1.') THEN greatest(0, depth - 2) ELSE depth END AS INT) AS depth FROM topics")
def renumber_subtree(spark, d):
    t = fixture(spark, d, "topics").select("topic_id", F.col("topic_id").alias("number"), "depth")
    return proj.renumber(t, "R1.N1", "X", -2)


@query("statement_cards", "SELECT statement_id, coalesce(nullif(title, ''), statement_id) AS title, coalesce(nullif(plain, ''), latex) AS conclusion, CASE WHEN ord % 3 = 0 THEN 'rate' || (ord % 2) ELSE '' END AS rate_class, concat_ws(',', nullif(content_kind, ''), CASE WHEN ord % 3 = 0 THEN 'rate' || (ord % 2) END, CASE WHEN layer_role = 'base_statement_layer' THEN 'base' END) AS badges FROM statements")
def statement_cards(spark, d):
    rate = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("rate"), F.col("ord") % 2)).when(F.col("ord") % 3 == 1, "Not applicable")
    cards = proj.statement_cards(fixture(spark, d, "statements").withColumn("rate", rate))
    return cards.withColumn("badges", F.array_join("badges", ",")).fillna("", ["rate_class"])


@query("source_grounding", "SELECT statement_id, coalesce(nullif(source, 'src1'), lang) AS title, CASE WHEN ord % 2 = 0 THEN 'p' || ord ELSE statement_id END AS locator, CASE WHEN ord % 5 = 0 THEN 'not recorded' WHEN verified = 1 THEN 'verified' ELSE 'not verified' END AS verified FROM notes")
def source_grounding(spark, d):
    n = fixture(spark, d, "notes")
    s = F.struct(F.when(F.col("source") != "src1", F.col("source")).otherwise("").alias("source_title"), F.col("lang").alias("source"), F.when(F.col("ord") % 2 == 0, F.concat(F.lit("p"), "ord")).alias("locator"), F.col("statement_id").alias("source_item_id"), F.when(F.col("ord") % 5 != 0, F.col("verified") == 1).alias("verified"))
    return proj.source_rows(n.select("statement_id", F.array(s).alias("sources")))


@query("witness_display", "SELECT topic_id, CASE WHEN axis <> '' THEN axis ELSE kind END AS title, CASE WHEN pos % 2 = 0 THEN 'at ' || pos ELSE topic_id END AS locator, 'not recorded' AS verified FROM topics")
def witness_display(spark, d):
    t = fixture(spark, d, "topics")
    w = F.struct(F.col("axis").alias("source_title"), F.col("kind").alias("source"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("at "), "pos")).otherwise("").alias("locator"), F.col("topic_id").alias("source_item_id"), F.lit(None).cast("boolean").alias("verified"))
    return proj.source_rows(t.select(F.col("topic_id").alias("statement_id"), F.array(w).alias("sources"))).withColumnRenamed("statement_id", "topic_id")


@query("array_values", "SELECT statement_id, 'kind' AS dimension, content_kind AS value FROM statements WHERE content_kind <> '' UNION ALL SELECT statement_id, 'kind', latex FROM statements UNION ALL SELECT statement_id, 'title', title FROM statements WHERE title <> ''")
def array_values(spark, d):
    s = fixture(spark, d, "statements")
    dims = F.create_map(F.lit("kind"), F.array("content_kind", "latex", F.lit(None)), F.lit("title"), F.array(F.col("title"), F.lit("  ")))
    return proj.dimension_values(s.withColumn("dims", dims), "statement_id", "dims")


@query("prerequisite_links", "SELECT ord, node_id, r.domain_id FROM (SELECT ord, unnest([node_hint, 'Z' || parent_hint]) AS node_id FROM candidates) LEFT JOIN (SELECT DISTINCT domain_id FROM topics) r ON r.domain_id = string_split(node_id, '.')[1]")
def prerequisite_links(spark, d):
    k = fixture(spark, d, "candidates").select(F.col("ord").alias("statement_id"), F.array("node_hint", F.concat(F.lit("Z"), "parent_hint")).alias("prerequisites"))
    owners = fixture(spark, d, "topics").select(F.col("domain_id").alias("segment"), "domain_id").distinct()
    return proj.prerequisite_links(k, owners).withColumnRenamed("statement_id", "ord")


@query("statement_preference", "SELECT statement_id, row_number() OVER (PARTITION BY topic_id ORDER BY evidence > 2 DESC, evidence > 2 DESC, ord % 2 DESC, ord % 3 = 0 DESC, length(latex) + length(plain) DESC, ord) AS place FROM attached WHERE topic_id IS NOT NULL")
def statement_preference(spark, d):
    """Statements of few kinds of evidence and confidence, so that explicit aliases and lengths decide as well."""
    a = attached(spark, d).where("topic_id is not null").withColumn("mapping_method", F.when(F.col("ord") % 3 == 0, win.EXPLICIT).otherwise(F.col("mapping_method")))
    a = a.withColumn("evidence", (F.col("evidence") > 2).cast("int")).withColumn("confidence", (F.col("ord") % 2).cast("double")).withColumn("p", win.preference())
    return a.select("statement_id", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("p"), "ord")).cast("long").alias("place"))


@query("knowledge_status", "SELECT t.topic_id, CASE WHEN d.statements > 0 THEN 'has_statements' WHEN t.topic_id IN (SELECT parent_topic_id FROM topics WHERE parent_topic_id IS NOT NULL) THEN 'has_children' ELSE 'leaf' END AS status FROM topics t JOIN direct d USING (topic_id)")
def knowledge_status(spark, d):
    t = fixture(spark, d, "topics")
    return proj.knowledge_status(t, agg.direct_counts(t, kept(spark, d)))


# --- formulas


@query("formula_fields", "SELECT statement_id, topic_id, field, sha256(value) AS value_sha FROM formulas WHERE trim(value) <> '' UNION ALL SELECT statement_id, topic_id, 'assumptions_latex', sha256('given ' || statement_id) FROM formulas UNION ALL SELECT statement_id, topic_id, 'symbol_latex', sha256('x') FROM formulas")
def formula_fields(spark, d):
    """Statements whose formulas stand in a column, in a struct, in lists of structs and in a map."""
    f, of = fixture(spark, d, "formulas"), lambda k: F.when(F.col("field") == k, F.col("value"))
    nested = f.select(
        "statement_id", "topic_id", of("statement_latex").alias("statement_latex"), F.struct(of("conclusion_latex").alias("conclusion_latex"), F.lit("linear").alias("rate_class")).alias("conclusion"),
        F.array(F.struct(of("symbol_latex").alias("symbol_latex"), F.lit("a symbol").alias("meaning")), F.struct(F.lit(" ").alias("symbol_latex"), F.lit(None).cast("string").alias("meaning"))).alias("notation"),
        F.array(F.concat(F.lit("given "), "statement_id"), F.lit(None).cast("string")).alias("assumptions_latex"), F.create_map(F.lit("main"), F.struct(F.lit("x").alias("symbol_latex"))).alias("variants"), F.array(F.lit("no formula")).alias("boundary_notes"),
    )
    return formula.formula_fields(nested, "statement_id", "topic_id").select("statement_id", "topic_id", "field", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha"))


@query(
    "formula_values",
    """WITH g AS (SELECT *, CASE WHEN ord % 5 = 0 THEN 'inner_' || ord ELSE statement_id END AS inner_id FROM notes WHERE ord % 9 <> 4) SELECT ord, statement_id, topic_id, 'conclusion_latex' AS field, sha256(latex) AS value_sha FROM g WHERE trim(latex) <> ''
    UNION ALL SELECT ord, inner_id, topic_id, 'symbol_latex', sha256('x' || ord) FROM g UNION ALL SELECT ord, inner_id, 'lower', 'symbol_latex', sha256('deep') FROM g UNION ALL SELECT ord, statement_id, topic_id, 'assumptions_latex', sha256(x) FROM (SELECT *, unnest(['a', 'b' || ord, 'c']) AS x FROM g)""",
)
def formula_values(spark, d):
    """Open JSON with formulas in objects, in lists of lists and in objects within them; every ninth is broken off."""
    n = fixture(spark, d, "notes")
    inner = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("inner_"), "ord"))
    deep = F.array(F.array(F.struct(F.lit("lower").alias("topic_id"), F.struct(F.lit("deep").alias("symbol_latex"), F.lit(3).alias("rank")).alias("of"))))
    body = F.to_json(
        F.struct(
            F.col("statement_id").alias("id"), "topic_id", F.struct(F.col("latex").alias("conclusion_latex"), F.lit("no formula").alias("rate_class")).alias("conclusion"), F.lit(" ").alias("statement_latex"),
            F.struct(inner.alias("id"), F.array(F.struct(F.concat(F.lit("x"), "ord").alias("symbol_latex"))).alias("list"), deep.alias("deeper")).alias("notation"),
        )
    )
    body = F.concat(F.regexp_replace(body, r"\}\z", ""), F.lit(',"assumptions_latex":["a",["b'), "ord", F.lit('",["c"," ",null,7]]],"symbol_latex":{"other":"x"}}'))
    docs = n.select("ord", F.when(F.col("ord") % 9 == 4, F.expr("'{\"id\": [broken'")).otherwise(body).alias("body"))
    return formula.formula_values(docs, "body", "ord").select("ord", "statement_id", "topic_id", "field", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha"))


_ODD = "CAST(len(string_split(replace(value, '\\\\', ''), '\\{0}')) - 1 AS INT)"
_COUNTS = ", ".join(f"{_ODD.format(m)} AS {n}" for m, n in (("(", "open_inline"), (")", "close_inline"), ("[", "open_display"), ("]", "close_display")))
_DOLLARS = "CAST(len(regexp_extract_all(replace(value, '\\$', 'D'), '\\$\\$')) AS INT) AS display_dollars, CAST(len(regexp_extract_all(replace(value, '\\$', 'D'), '\\$\\$?')) - len(regexp_extract_all(replace(value, '\\$', 'D'), '\\$\\$')) AS INT) AS inline_dollars"
COUNTS_SQL = f"SELECT statement_id, field, value, {_COUNTS}, {_DOLLARS} FROM formulas"


@query("formula_delimiters", f"SELECT * EXCLUDE (field, value) FROM ({COUNTS_SQL})")
def formula_delimiters(spark, d):
    f = fixture(spark, d, "formulas")
    return f.select("statement_id", *[c.alias(n) for n, c in formula.delimiters(F.col("value")).items()])


REASONS_SQL = f"""SELECT statement_id, field, open_inline, display_dollars + inline_dollars AS dollars, value, concat_ws(',', CASE WHEN open_inline <> close_inline THEN 'unbalanced_inline_delimiters' END, CASE WHEN open_display <> close_display THEN 'unbalanced_display_delimiters' END,
    CASE WHEN inline_dollars % 2 <> 0 THEN 'unbalanced_inline_dollars' END, CASE WHEN display_dollars % 2 <> 0 THEN 'unbalanced_display_dollars' END, CASE WHEN contains(value, chr(9)) THEN 'control_character_in_formula' END) AS reasons FROM ({COUNTS_SQL})"""


@query("formula_audit", f"SELECT statement_id, field, reasons, substring(value, 1, 500) AS preview FROM ({REASONS_SQL}) WHERE reasons <> ''")
def formula_audit(spark, d):
    told = F.filter(F.array(F.array_join(formula.audit(F.col("value")), ",")), lambda x: x != "")  # exploded, so that the filter doesn't scan the texts again
    f = fixture(spark, d, "formulas").select("statement_id", "field", F.substring("value", 1, 500).alias("preview"), F.explode(told).alias("reasons"))
    return f.select("statement_id", "field", "reasons", "preview")


@query("formula_summary", f"SELECT coalesce(field, 'all') AS field, count(*) AS fields, count(*) FILTER (dollars > 0) AS dollar_delimited, count(*) FILTER (reasons <> '') AS invalid, CASE WHEN count(*) FILTER (reasons <> '') = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({REASONS_SQL}) GROUP BY ROLLUP (field)")
def formula_summary(spark, d):
    n = formula.delimiters(F.col("value"))
    f = fixture(spark, d, "formulas").select("field", (n["display_dollars"] + n["inline_dollars"] > 0).alias("dollars"), (F.size(formula.audit(F.col("value"))) > 0).alias("bad"))
    out = f.rollup("field").agg(F.count("*").alias("fields"), F.count_if("dollars").alias("dollar_delimited"), F.count_if("bad").alias("invalid"))
    return out.select(F.coalesce("field", F.lit("all")).alias("field"), "fields", "dollar_delimited", "invalid", F.when(F.col("invalid") == 0, "PASS").otherwise("FAIL").alias("status"))


@query("formula_normalize")
def formula_normalize(spark, d):
    return fixture(spark, d, "formulas").select("statement_id", formula.formula_normalize("value").alias("value"))


#: DuckDB has no look-behind, so an escaped dollar is one character while the rules run; inline formulas hold neither kind.
DOLLARS_SQL = r"""SELECT statement_id, sha256(replace(regexp_replace(regexp_replace(replace(value, '\$', chr(1)), '(?s)\$\$(.*?)\$\$', '\\[\1\\]', 'g'), '\$([^$\x01\n]+?)\$', '\\(\1\\)', 'g'), chr(1), '\$')) AS tex_sha FROM formulas"""


@query("dollars_to_tex", DOLLARS_SQL)
def dollars_to_tex(spark, d):
    return fixture(spark, d, "formulas").select("statement_id", F.sha2(formula.dollars_to_tex(F.col("value")).cast("binary"), 256).alias("tex_sha"))


_ONE = r"CAST(len(regexp_extract_all(' ' || value, '[^\\]\\\{0}')) AS INT)"


#: The display rule's six counts; single dollars are counted without the $$.
BALANCE_SQL = f"""SELECT statement_id, {_ONE.format('(')} AS open_inline, {_ONE.format(')')} AS close_inline, {_ONE.format('[')} AS open_display, {_ONE.format(']')} AS close_display,
    CAST(len(regexp_extract_all(replace(value, '\\$', 'D'), '\\$\\$')) AS INT) AS display_dollars, CAST(len(regexp_extract_all(regexp_replace(replace(value, '\\$', 'D'), '\\$\\$', '', 'g'), '\\$')) AS INT) AS inline_dollars FROM formulas"""


@query("delimiter_balance", f"SELECT *, open_inline = close_inline AND open_display = close_display AND display_dollars % 2 = 0 AND inline_dollars % 2 = 0 AS balanced FROM ({BALANCE_SQL})")
def delimiter_balance(spark, d):
    return fixture(spark, d, "formulas").select("statement_id", *[c.alias(n) for n, c in formula.balance(F.col("value")).items()])


@query("trim_orphan_delimiter", r"WITH n AS (SELECT *, latex || CASE ord % 4 WHEN 0 THEN ' \(x\) \) ' WHEN 1 THEN ' \[y\]\]' WHEN 2 THEN ' \(z\)' ELSE '\) and' END AS value FROM (SELECT statement_id, ord, replace(latex, chr(92), '/') AS latex FROM notes)) SELECT statement_id, sha256(CASE ord % 4 WHEN 0 THEN latex || ' \(x\)' WHEN 1 THEN latex || ' \[y\]' ELSE value END) AS trimmed FROM n")
def trim_orphan_delimiter(spark, d):
    """Whole texts with a delimiter too many at their end, within them, or none."""
    n = fixture(spark, d, "notes").withColumn("latex", F.replace("latex", F.lit("\\"), F.lit("/")))
    end = {0: " \\(x\\) \\) ", 1: " \\[y\\]\\]", 2: " \\(z\\)", 3: "\\) and"}
    value = F.concat("latex", F.element_at(F.create_map(*[F.lit(x) for kv in end.items() for x in kv]), (F.col("ord") % 4).cast("int")))
    return n.select("statement_id", F.sha2(formula.trim_orphan(value).cast("binary"), 256).alias("trimmed"))


@query("latex_class")
def latex_class(spark, d):
    return fixture(spark, d, "formulas").select("statement_id", "field", formula.latex_class(formula.formula_normalize("value")).alias("outcome"))


# --- joins


@query("attach_exact", "SELECT s.statement_id, t.topic_id FROM statements s JOIN topics t ON s.source_node_id = t.topic_id")
def attach_exact(spark, d):
    return place.attach_exact(fixture(spark, d, "statements"), fixture(spark, d, "topics")).select("statement_id", "topic_id")


@query("attach_nearest_ancestor", "SELECT statement_id, coalesce(topic_id, '') AS topic_id, coalesce(mapping_method, 'unmapped') AS mapping_method FROM attached")
def attach_nearest_ancestor(spark, d):
    return attached(spark, d).select("statement_id", F.coalesce("topic_id", F.lit("")).alias("topic_id"), F.coalesce("mapping_method", F.lit("unmapped")).alias("mapping_method"))


@query("alias_redirect", "SELECT ord, coalesce(a.target_node_id, parent_hint) AS node FROM (SELECT ord, parent_hint FROM candidates) k LEFT JOIN aliases a ON a.source_node_id = parent_hint".replace("SELECT ord, coalesce", "SELECT k.ord, coalesce"))
def alias_redirect(spark, d):
    k = fixture(spark, d, "candidates").select("ord", F.col("parent_hint").alias("node"))
    return place.alias_redirect(k, fixture(spark, d, "aliases"), "node")


@query("alias_map", "SELECT topic_id AS source_node_id, CASE WHEN pos % 7 = 1 THEN domain_id ELSE parent_topic_id END AS target_node_id FROM topics WHERE depth > 0")
def alias_map(spark, d):
    """Every topic sent to the one above it, some later to their domain; references to themselves and blanks in between."""
    t, none = fixture(spark, d, "topics").where("depth > 0"), F.array().cast("array<string>")
    row = lambda primary, target, targets, late: (F.col("topic_id").alias("source_node_id"), primary.alias("primary_target_node_id"), target.alias("target_node_id"), targets.alias("target_node_ids"), (F.col("pos") + late).alias("ord"))
    blank = F.lit("")
    own = t.select(*row(F.col("topic_id"), F.lit(None).cast("string"), none, 3 * 10**12))
    above = t.select(*row(blank, F.col("parent_topic_id"), none, 0))
    later = t.where("pos % 7 = 1").select(*row(blank, blank, F.array("domain_id"), 10**12))
    empty = t.select(*row(blank, blank, none, 2 * 10**12)).union(above.withColumn("source_node_id", blank))
    return place.alias_map(own.union(above).union(later).union(empty), fixture(spark, d, "topics"))


@query(
    "resolve_route",
    """WITH u AS (SELECT page_id AS key, 'R' || (page_id % 6) AS domain_id, 'R' || (page_id % 6) || '.N' || (page_id % 25) AS node_id FROM urls),
    l AS (SELECT key, CASE WHEN domain_id = 'R5' THEN 'R4' ELSE domain_id END AS domain_id, CASE WHEN domain_id = 'R5' AND key % 2 = 0 THEN 'R4.N4' ELSE node_id END AS node_id FROM u),
    p AS (SELECT key, CASE WHEN domain_id = 'R1' AND node_id = 'R1.N1' THEN 'R9' WHEN domain_id = 'R1' THEN 'R8' ELSE domain_id END AS domain_id, node_id FROM l)
    SELECT p.key, p.domain_id, coalesce(a.target_node_id, p.node_id) AS node_id FROM p LEFT JOIN aliases a ON p.domain_id = 'R8' AND a.source_node_id = p.node_id""",
)
def resolve_route(spark, d):
    key = F.col("page_id")
    u = fixture(spark, d, "urls").select(key.alias("key"), F.concat(F.lit("R"), key % 6).alias("domain_id"), F.when((key % 6 != 5) | (key % 2 != 0), F.concat(F.lit("R"), key % 6, F.lit(".N"), key % 25)).alias("node_id"))
    defaults = spark.createDataFrame([("R5", "R4", "R4.N4")], "legacy_domain_id string, new_domain_id string, default_node_id string")
    prefixes = spark.createDataFrame([("R1", "R1", "R8"), ("R1", "R1.N1", "R9")], "old_domain_id string, node_prefix string, domain_id string")
    return place.resolve_route(u, defaults, prefixes, fixture(spark, d, "aliases").select(F.lit("R8").alias("domain_id"), "source_node_id", "target_node_id"))


#: The revised tree, whose leaves of odd place have new ids; and one subtree of it.
REVISED_TREE_SQL = "SELECT CASE WHEN depth = 2 AND pos % 2 = 1 THEN topic_id || 'v2' ELSE topic_id END AS topic_id, parent_topic_id, domain_id, title, axis, depth, kind, pos FROM topics"
REVISION_SQL = f"{REVISED_TREE_SQL} WHERE topic_id = 'R2.N2' OR starts_with(topic_id, 'R2.N2.')"


def revised(topics: DataFrame) -> DataFrame:
    new = F.when((F.col("depth") == 2) & (F.col("pos") % 2 == 1), F.concat("topic_id", F.lit("v2"))).otherwise(F.col("topic_id"))
    return topics.withColumn("topic_id", new)


def revision(spark: SparkSession, d: str) -> DataFrame:
    return revised(place.subtree(fixture(spark, d, "topics"), "R2.N2"))


def match_sql(revision: str, old: str = "true") -> str:
    return f"""rev AS ({revision}), rt AS (SELECT lower(title) AS k, min(topic_id) AS only_id FROM rev GROUP BY 1 HAVING count(*) = 1),
    matched AS (SELECT o.topic_id, coalesce(r.topic_id, rt.only_id) AS new_topic_id, CASE WHEN r.topic_id IS NOT NULL THEN 'id' WHEN rt.only_id IS NOT NULL THEN 'title' ELSE 'unmapped' END AS method
    FROM topics o LEFT JOIN rev r ON o.topic_id = r.topic_id LEFT JOIN rt ON rt.k = lower(o.title) WHERE o.parent_topic_id IS NOT NULL AND ({old}))"""


MATCH_SQL = match_sql(REVISION_SQL, "o.topic_id = 'R2.N2' OR starts_with(o.topic_id, 'R2.N2.')")


@query("match_id_or_title", f"WITH {match_sql(REVISED_TREE_SQL)} SELECT topic_id, coalesce(new_topic_id, '') AS new_topic_id, method FROM matched")
def match_id_or_title(spark, d):
    old = fixture(spark, d, "topics")
    return place.match_id_or_title(old, revised(old)).fillna("", ["new_topic_id"])


def titled(spark: SparkSession, d: str) -> DataFrame:
    k = fixture(spark, d, "candidates").where("title <> ''")
    return k.select("ord", F.col("parent_hint").alias("parent"), text.normalize_text(F.col("title")).alias("title_key"))


@query("match_child_title", "WITH c AS (SELECT parent_topic_id, lower(title) AS k, min(topic_id) AS topic_id FROM topics WHERE depth > 0 GROUP BY 1, 2 HAVING count(*) = 1) SELECT ord, topic_id FROM candidates JOIN c ON c.parent_topic_id = parent_hint AND c.k = lower(candidates.title)")
def match_child_title(spark, d):
    return place.match_child_title(titled(spark, d), fixture(spark, d, "topics")).select("ord", "topic_id")


@query("match_title_same_part", "WITH c AS (SELECT lower(title) AS k, min(topic_id) AS topic_id FROM topics GROUP BY 1 HAVING count(*) = 1) SELECT ord, topic_id FROM candidates JOIN c ON c.k = lower(candidates.title) WHERE string_split(topic_id, '.')[1] = string_split(parent_hint, '.')[1]")
def match_title_same_part(spark, d):
    return place.match_title_same_part(titled(spark, d), fixture(spark, d, "topics")).select("ord", "topic_id")


@query("live_parent", "SELECT k.ord, CASE WHEN coalesce(a.target_node_id, parent_hint) IN (SELECT topic_id FROM topics) THEN coalesce(a.target_node_id, parent_hint) ELSE root_hint END AS parent FROM candidates k LEFT JOIN aliases a ON a.source_node_id = parent_hint")
def live_parent(spark, d):
    k = fixture(spark, d, "candidates").select("ord", F.array("parent_hint", "root_hint").alias("parents"))
    return place.live_parent(k, fixture(spark, d, "topics"), fixture(spark, d, "aliases"))


@query("orphan_targets", "SELECT 'alias' AS what, target_node_id AS target FROM aliases WHERE target_node_id NOT IN (SELECT topic_id FROM topics) UNION ALL SELECT DISTINCT 'statement', source_node_id FROM statements WHERE source_node_id NOT IN (SELECT topic_id FROM topics)")
def orphan_targets(spark, d):
    t = fixture(spark, d, "topics")
    a = fixture(spark, d, "aliases").select(F.lit("alias").alias("what"), F.col("target_node_id").alias("target"))
    s = fixture(spark, d, "statements").select(F.lit("statement").alias("what"), F.col("source_node_id").alias("target")).distinct()
    return place.orphans(a.union(s), t, "target").select("what", "target")


@query("topic_relations", "SELECT t.topic_id, 'parent' AS relation, o.topic_id AS other_id, o.title FROM topics t JOIN topics o ON t.parent_topic_id = o.topic_id UNION ALL SELECT o.topic_id, 'child', t.topic_id, t.title FROM topics t JOIN topics o ON t.parent_topic_id = o.topic_id")
def topic_relations(spark, d):
    return place.topic_relations(fixture(spark, d, "topics"))


@query("breadcrumbs", "SELECT a.topic_id, string_agg(t.title, ' / ' ORDER BY a.distance DESC) AS path FROM above a JOIN topics t ON a.ancestor_id = t.topic_id GROUP BY a.topic_id")
def breadcrumbs(spark, d):
    return place.breadcrumbs(fixture(spark, d, "topics")).select("topic_id", F.array_join("path", " / ").alias("path"))


def subjects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("west", 0, ["R0", "R1", "short"]), ("east", 1, ["R1", "R2"]), ("none", 2, [])], "subject_id string, pos int, items array<string>")


def order_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a subject whose items are the parts on its lines; some parts have another name there."""
    item = F.concat(F.when(F.col("l_partkey") % 50 == 0, "X").otherwise("P"), "l_partkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pos"), item.alias("item"))
    return lines.groupBy("pos").agg(F.collect_set("item").alias("items")).select(F.concat(F.lit("o"), "pos").alias("subject_id"), "pos", "items")


def part_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("domain_id"))


@query("subject_of_domain", "SELECT 'P' || p_partkey AS domain_id, coalesce('o' || min(l_orderkey), '') AS subject_id FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_partkey % 50 <> 0 GROUP BY p_partkey")
def subject_of_domain(spark, d):
    return place.subject_of_domain(part_domains(spark, d), order_subjects(spark, d)).fillna("", ["subject_id"])


# --- aggregations


@query("direct_counts", "SELECT * FROM direct")
def direct_counts(spark, d):
    return agg.direct_counts(fixture(spark, d, "topics"), kept(spark, d))


@query("subtree_rollup", "SELECT * FROM rolled")
def subtree_rollup(spark, d):
    return agg.subtree_rollup(fixture(spark, d, "topics"), kept(spark, d))


KINDS_SQL = "SELECT {0} AS id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (SELECT {0}, coalesce(nullif(content_kind, ''), 'unknown') AS kind, count(*) AS n FROM kept WHERE rn = 1 GROUP BY 1, 2) GROUP BY 1"


def joined_map(kinds: str):
    return F.array_join(F.transform(F.map_entries(kinds), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


@query("content_kind_counts", KINDS_SQL.format("topic_id"))
def content_kind_counts(spark, d):
    return agg.content_kind_counts(kept(spark, d)).select(F.col("topic_id").alias("id"), joined_map("kinds").alias("kinds"))


STATS_SQL = """SELECT t.domain_id, count(*) AS topics, CAST(sum(statements) AS BIGINT) AS statements, CAST(sum(base) AS BIGINT) AS base, CAST(sum(intermediate) AS BIGINT) AS intermediate, count(*) FILTER (leaf) AS leaf_topics,
    CAST(count(*) FILTER (leaf AND statements > 0) AS DOUBLE) / count(*) FILTER (leaf) AS coverage, max(depth) AS max_depth
    FROM (SELECT *, topic_id NOT IN (SELECT parent_topic_id FROM topics WHERE parent_topic_id IS NOT NULL) AS leaf FROM topics) t JOIN direct USING (topic_id) GROUP BY t.domain_id"""


@query("domain_stats", f"SELECT * FROM ({STATS_SQL})")
def domain_stats(spark, d):
    return agg.domain_stats(fixture(spark, d, "topics"), kept(spark, d)).drop("kinds")


@query("chapter_summaries", "SELECT t.topic_id, t.title, t.axis, r.topics AS subtree_topic_count, r.statements AS subtree_statement_count FROM topics t JOIN rolled r USING (topic_id) WHERE t.depth = 1")
def chapter_summaries(spark, d):
    return agg.chapter_summaries(fixture(spark, d, "topics"), kept(spark, d))


@query("subject_stats", f"WITH st AS ({STATS_SQL}) SELECT 'west' AS subject_id, CAST(3 AS BIGINT) AS collections, CAST(sum(topics) AS BIGINT) AS topics, CAST(sum(statements) AS BIGINT) AS statements FROM st WHERE domain_id IN ('R0', 'R1') UNION ALL SELECT 'east', 2, CAST(sum(topics) AS BIGINT), CAST(sum(statements) AS BIGINT) FROM st WHERE domain_id IN ('R1', 'R2') UNION ALL SELECT 'none', 0, 0, 0")
def subject_stats(spark, d):
    shortcuts = spark.createDataFrame([("short", "R0")], "item string, domain_id string")
    return agg.subject_stats(subjects(spark), shortcuts, domain_stats(spark, d))


@query("manifest_totals", "SELECT (SELECT count(*) FROM topics) AS topics, (SELECT count(*) FROM kept WHERE rn = 1) AS statements")
def manifest_totals(spark, d):
    return agg.manifest_totals(domain_stats(spark, d))


@query("modal_scope_note", "SELECT parent_hint, max_by(scope_note, (n, f)) AS scope_note FROM (SELECT parent_hint, scope_note, count(*) AS n, -row_number() OVER (PARTITION BY parent_hint ORDER BY min(ord)) AS f FROM candidates GROUP BY 1, 2) GROUP BY 1")
def modal_scope_note(spark, d):
    return agg.modal_value(fixture(spark, d, "candidates"), ["parent_hint"], "scope_note", "ord")


@query("cross_source_groups", f"SELECT parent_hint AS parent, {KEY_SQL.format('title')} AS title_key, string_agg(DISTINCT campaign, ',' ORDER BY campaign) AS campaigns, count(DISTINCT source_item_id) AS items FROM candidates WHERE stage <> '0809_campaign_build' AND title <> '' GROUP BY 1, 2 HAVING count(DISTINCT campaign) >= 2")
def cross_source_groups(spark, d):
    k = fixture(spark, d, "candidates").where("title <> ''").withColumn("parent", F.col("parent_hint")).withColumn("title_key", text.normalize_text(F.col("title")))
    return agg.cross_source_groups(k).select("parent", "title_key", F.array_join("campaigns", ",").alias("campaigns"), F.col("n_items").alias("items"))


@query("cross_source_members", f"WITH k AS (SELECT parent_hint AS parent, {KEY_SQL.format('title')} AS title_key, campaign, source_item_id FROM candidates WHERE stage <> '0809_campaign_build' AND title <> ''), g AS (SELECT parent, title_key FROM k GROUP BY 1, 2 HAVING count(DISTINCT campaign) >= 2) SELECT parent, title_key, source_item_id, row_number() OVER (PARTITION BY parent, title_key ORDER BY source_item_id) AS number FROM (SELECT DISTINCT parent, title_key, source_item_id FROM k JOIN g USING (parent, title_key))")
def cross_source_members(spark, d):
    k = fixture(spark, d, "candidates").where("title <> ''").withColumn("parent", F.col("parent_hint")).withColumn("title_key", text.normalize_text(F.col("title")))
    k = cut(k.select("parent", "title_key", "campaign", "source_item_id", "stage"))
    return agg.group_members(k, agg.cross_source_groups(k))


@query("witness_dedup", "SELECT parent_hint, campaign, locator, CAST(row_number() OVER (PARTITION BY parent_hint ORDER BY min(ord), campaign, locator) AS INT) AS pos FROM candidates GROUP BY 1, 2, 3")
def witness_dedup(spark, d):
    return agg.witness_dedup(fixture(spark, d, "candidates"), ["parent_hint"]).drop("at")


@query("collect_preserved", "SELECT t.topic_id, t.title, count(a.ord) FILTER (a.stage = 'current') AS preserved, count(a.ord) FILTER (a.stage <> 'current') AS regenerated FROM topics t LEFT JOIN attached a ON t.topic_id = a.topic_id WHERE t.domain_id <> 'R3' GROUP BY 1, 2")
def collect_preserved(spark, d):
    return agg.collect_preserved(fixture(spark, d, "topics"), attached(spark, d), ["R3"])


PRESERVED_SQL = "t AS (SELECT topic_id, domain_id FROM topics WHERE domain_id <> 'R3' UNION ALL SELECT topic_id, 'R4' FROM topics WHERE domain_id = 'R1'), a AS (SELECT * FROM attached WHERE topic_id IN (SELECT topic_id FROM t))"


def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Topics of which one domain's occur in another as well."""
    t = fixture(spark, d, "topics")
    return t.union(t.where("domain_id = 'R1'").withColumn("domain_id", F.lit("R4")))


@query("preserved_statements", f"WITH {PRESERVED_SQL} SELECT topic_id, statement_id FROM a WHERE stage = 'current'")
def preserved_statements(spark, d):
    return agg.preserved_statements(snapshot(spark, d), attached(spark, d), ["R3"]).select("topic_id", "statement_id")


@query("preserved_report", f"WITH {PRESERVED_SQL} SELECT (SELECT count(DISTINCT domain_id) FROM t) AS domains, (SELECT count(DISTINCT topic_id) FROM t) AS topics, (SELECT count(*) - count(DISTINCT topic_id) FROM t) AS duplicate_topic_occurrences, count(*) FILTER (stage = 'current') AS statements, count(*) FILTER (starts_with(stage, '0809')) AS excluded_campaign_statements, count(*) FILTER (starts_with(stage, 'conv')) AS excluded_convergence_candidates FROM a")
def preserved_report(spark, d):
    return agg.preserved_report(snapshot(spark, d), attached(spark, d), ["R3"])


@query("layer_report", "SELECT count(*) AS layer_count, count(*) FILTER (partial_run) AS partial_layer_count, CAST(sum(records) AS BIGINT) AS records, CAST(sum(unmapped) AS BIGINT) AS unmapped FROM (SELECT stage, stage <> 'current' AS partial_run, count(*) AS records, count(*) FILTER (topic_id IS NULL) AS unmapped FROM attached GROUP BY 1, 2)")
def layer_report(spark, d):
    layers = attached(spark, d).groupBy("stage").agg(F.count("*").alias("records"), F.count_if(F.col("topic_id").isNull()).alias("unmapped"))
    return agg.layer_report(layers.withColumn("partial_run", F.col("stage") != "current").drop("stage"))


@query("duplicate_keys", "SELECT topic_id, title_key, count(*) AS n FROM attached WHERE topic_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    a = attached(spark, d).where("topic_id is not null").withColumn("title_key", text.normalize_text(F.col("title")))
    return agg.duplicate_keys(a, "topic_id", "title_key")


@query(
    "protected_hash",
    """WITH h AS (SELECT sha256('{"topic_id":"' || topic_id || '","depth":' || depth || '}') AS h FROM topics), k AS (SELECT CAST(pow(2, ceil(log2(ceil(count(*) / 4096.0)))) AS BIGINT) AS n FROM h),
    b AS (SELECT (CAST('0x' || substring(h, 1, 8) AS BIGINT) * n) >> 32 AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h, k GROUP BY 1)
    SELECT CASE WHEN (SELECT n FROM k) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY h)) END AS protected_hash FROM b""",
)
def protected_hash(spark, d):
    return agg.protected_hash(fixture(spark, d, "topics").select("topic_id", "title", "depth"), "title")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Statements attached to their nearest topic, first-wins deduplicated, and rolled up the tree."""
    return subtree_rollup(spark, d)

