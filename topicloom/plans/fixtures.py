"""The test tables seen as topics, statements, candidates, aliases, formulas and events.

Each fixture is one SELECT that Spark and the SQL oracle both run; {names} are tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")

# The place of a line, and that of all its columns, where lines that differ in any have places of their own.
_PLACE = "CAST(l_orderkey AS STRING) || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(round(l_extendedprice * 100) AS BIGINT)"
_WHOLE_PLACE = "CAST(l_orderkey AS STRING) || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(CAST(l_extendedprice * 100 AS DECIMAL(20, 0)) AS STRING) || l_returnflag || l_linestatus || CAST(CAST(l_quantity AS DECIMAL(20, 0)) AS STRING) || '-' || CAST(CAST(l_tax * 100 AS DECIMAL(20, 0)) AS STRING) || '-' || CAST(CAST(l_discount * 100 AS DECIMAL(20, 0)) AS STRING) || '-' || CAST(l_shipdate AS STRING)"
_N = "'R' || n_regionkey || '.N' || n_nationkey"
FIXTURES = {
    "topics": f"""
        SELECT 'R' || r_regionkey AS topic_id, CAST(NULL AS STRING) AS parent_topic_id, 'R' || r_regionkey AS domain_id, r_name AS title, '' AS axis, 0 AS depth, 'region' AS kind, CAST(r_regionkey AS BIGINT) AS pos FROM {{region}}
        UNION ALL SELECT {_N}, 'R' || n_regionkey, 'R' || n_regionkey, n_name, '', 1, 'nation', CAST(n_nationkey AS BIGINT) FROM {{nation}}
        UNION ALL SELECT {_N} || '.C' || c_custkey, {_N}, 'R' || n_regionkey, c_name, c_mktsegment, 2, 'customer', c_custkey FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
        UNION ALL SELECT {_N} || '.S' || s_suppkey, {_N}, 'R' || n_regionkey, s_name, '', 2, 'supplier', s_suppkey FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
        UNION ALL SELECT {_N} || '.P' || p_partkey, {_N}, 'R' || n_regionkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' ' || p_brand ELSE p_name END, p_type, 2, 'part', p_partkey FROM {{part}} JOIN {{nation}} ON n_nationkey = p_partkey % 25""",
    "statements": f"""
        SELECT 'stmt_' || o_orderkey AS statement_id, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS title,
            CASE WHEN o_orderstatus = 'F' THEN 'base_statement_layer' ELSE 'intermediate_statement_layer' END AS layer_role,
            CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE o_orderpriority END AS content_kind,
            CASE WHEN o_orderkey % 11 = 0 THEN 'Z9.' || o_custkey WHEN o_orderkey % 3 = 0 THEN {_N} || '.C' || o_custkey || '.X' || (o_orderkey % 7) ELSE {_N} || '.C' || o_custkey END AS source_node_id,
            o_orderstatus || '-' || (o_orderkey % 4) AS latex, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS plain,
            CASE WHEN o_orderkey % 19 = 0 THEN '0809_campaign_reviewed' WHEN o_orderkey % 23 = 0 THEN 'convergence_fast_candidate_unreviewed' ELSE 'current' END AS stage,
            CAST(o_orderkey % 5 AS INT) AS evidence, CAST(o_orderkey % 101 AS DOUBLE) AS confidence, o_orderkey AS ord
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "aliases": f"SELECT 'R1.N' || n_nationkey AS source_node_id, 'R1.N' || (n_nationkey + 5) AS target_node_id, CAST(n_nationkey AS BIGINT) AS ord FROM {{nation}} WHERE n_nationkey % 5 = 1",
    "candidates": f"""
        SELECT 'i' || l_orderkey || '-' || l_linenumber AS source_item_id, 'camp' || (l_suppkey % 10) AS campaign,
            CASE l_returnflag WHEN 'R' THEN '0809_campaign_build' WHEN 'A' THEN '0809_campaign_reviewed' ELSE '0809_campaign_published' END AS stage,
            CASE WHEN l_partkey % 5 = 0 THEN p_name || ' ' || p_brand WHEN l_partkey % 7 = 1 THEN 'New ' || p_brand ELSE p_name END AS title,
            CASE WHEN l_quantity > 45 THEN '' ELSE l_linestatus || l_linenumber END AS latex,
            {_N} AS parent_hint, 'R' || n_regionkey AS root_hint, CASE WHEN l_partkey % 4 = 0 THEN ' ' ELSE {_N} || '.P' || (l_partkey + l_linenumber % 2) END AS node_hint,
            CASE WHEN l_partkey % 3 = 0 THEN {_N} || '.P' || l_partkey ELSE '' END AS home_hint, CASE WHEN l_linenumber % 2 = 0 THEN {_N} ELSE '' END AS fallback_hint,
            CASE WHEN l_suppkey % 2 = 0 THEN {_N} || '.P' || l_partkey ELSE '' END AS affected_hint, CAST(l_linenumber AS DOUBLE) AS confidence,
            'loc' || (l_partkey % 3) AS locator, 'note ' || (l_linenumber % 3) AS scope_note,
            {_PLACE} AS ord
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey""",
    "notes": """
        SELECT 'doc_' || d.doc_id AS statement_id, d.source || '.' || d.lang AS topic_id, d.text AS latex, coalesce(l.quality, 0) AS verified, d.doc_id AS ord, d.source, d.lang
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "formulas": r"""
        SELECT 'doc_' || doc_id AS statement_id, source || '.' || lang AS topic_id, CASE WHEN doc_id % 3 = 0 THEN 'statement_latex' WHEN doc_id % 3 = 1 THEN 'conclusion_latex' ELSE 'symbol_latex' END AS field,
            replace(replace(replace(replace(text, '. ', ' \) '), ', ', ' \( '), ' the ', ' $x$ '), ' und ', ' \\\[ ') AS value FROM {documents}""",
    "issue_events": "SELECT event_id, CAST(user_id AS STRING) AS issue_id, event_type AS action, ts AS created_at FROM {events}",
    "edits": "SELECT conv_id AS issue_id, turn AS version, role AS action, text AS note FROM {conversations}",
    "urls": "SELECT page_id, url FROM {pages}",
}
FIXTURES["whole_candidates"] = FIXTURES["candidates"].replace(_PLACE, _WHOLE_PLACE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    used = {t for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.replace("\\", "\\\\") if name == "formulas" else text, **{t: table(spark, sf_dir, t) for t in used})


#: What several oracles share: nearest-ancestor placement, tree ancestors, counts and first-wins records. SQL alone; Spark has operators for them.
DERIVED = {
    "near": """SELECT ord, max_by(p, length(p)) AS topic_id FROM (SELECT ord, unnest(list_transform(range(1, len(string_split(source_node_id, '.')) + 1), lambda i: array_to_string(string_split(source_node_id, '.')[1:i], '.'))) AS p FROM statements) WHERE p IN (SELECT topic_id FROM topics) GROUP BY ord""",
    "attached": """SELECT s.*, n.topic_id, CASE WHEN n.topic_id = s.source_node_id THEN 'exact_topic_id' WHEN n.topic_id IS NOT NULL THEN 'nearest_canonical_ancestor' END AS mapping_method,
        lower(trim(regexp_replace(s.title, '\\s+', ' ', 'g'))) AS title_key FROM statements s LEFT JOIN near n USING (ord)""",
    "kept": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, CASE WHEN title_key = '' THEN 'f' || lower(latex) || '|' || lower(plain) ELSE 't' || title_key END ORDER BY ord) AS rn FROM attached WHERE topic_id IS NOT NULL)""",
    "above": """SELECT topic_id, topic_id AS ancestor_id, 0 AS distance FROM topics UNION ALL SELECT topic_id, parent_topic_id, 1 FROM topics WHERE parent_topic_id IS NOT NULL
        UNION ALL SELECT t.topic_id, p.parent_topic_id, 2 FROM topics t JOIN topics p ON t.parent_topic_id = p.topic_id WHERE p.parent_topic_id IS NOT NULL""",
    "direct": """SELECT t.topic_id, count(k.ord) AS statements, count(k.ord) FILTER (layer_role = 'base_statement_layer') AS base, count(k.ord) FILTER (layer_role <> 'base_statement_layer') AS intermediate
        FROM topics t LEFT JOIN (SELECT * FROM kept WHERE rn = 1) k ON t.topic_id = k.topic_id GROUP BY t.topic_id""",
    "rolled": """SELECT ancestor_id AS topic_id, CAST(sum(statements) AS BIGINT) AS statements, CAST(sum(base) AS BIGINT) AS base, CAST(sum(intermediate) AS BIGINT) AS intermediate, count(*) AS topics FROM above JOIN direct USING (topic_id) GROUP BY ancestor_id""",
}


def with_fixtures(query: str) -> str:
    """The oracle's SQL: the fixtures and shared parts that a query names, before it."""
    pieces = {k: v.replace("{", "").replace("}", "") for k, v in FIXTURES.items()} | DERIVED
    used: set[str] = set()
    todo = [query]
    while todo:
        text = todo.pop()
        for n in pieces:
            if n not in used and re.search(rf"\b{n}\b", text):
                used.add(n)
                todo.append(pieces[n])
    parts = [f"{n} AS ({pieces[n]})" for n in pieces if n in used]
    body = query.strip()
    if not parts:
        return body
    recursive = body.upper().startswith("WITH RECURSIVE ")
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{', '.join(parts)}, {body[len(head):]}" if body.upper().startswith("WITH ") else f"WITH {', '.join(parts)} {body}"
