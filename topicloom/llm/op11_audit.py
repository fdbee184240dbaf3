r"""Filter interaction audit by decision diagrams.

Filters are conditions under which a document fails; words are [^\x20\x09-\x0D]+. Every document has a mask of the filters that it fails. Masks are counted by part, with how many
of them are good and toxic; a part has at most 2^filters of them, whatever its size.

A part's counts make a decision diagram: a level a filter, at each node one branch for documents that pass and one for those that fail, counts at the ends; equal branches are one node, and a node carries the sum
below it. The order of filters is changed by swapping two adjacent levels, which rebuilds the upper of the two alone; all orders are reached by such swaps, one after the other. In each order the path of
passes shows the steps: what leaves it at a level is removed by that filter, what stays on it is kept.

Failing as a copy: texts are compared by SHA-256, which groups rows in two steps, first with their ids, then without, so that a text that a third of all rows have is combined before it is shuffled.

Defined results: a null text is empty, a null part the empty string; empty texts fail by their length alone, and as copies; a row without an id is never a copy and makes none; rows of one id and text aren't copies of each
other, but each counts; a document is good or toxic if any label row of its id says so; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import BROADCAST_IDS, cut, space_word_count, table, utf8

#: Letters of the filters; a mask's bits are in this order. The last one, which looks at other documents, is set apart.
FILTERS = "ABCDE"
Counts = tuple[int, int, int]


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text alone: too short, repetitive, many capitals, special characters."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    fails = [
        space_word_count(text) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    mask = F.lit(0)
    for bit, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << bit).otherwise(0)
    return mask


def marked(labels: DataFrame, key: str) -> DataFrame:
    """(key, good, toxic) of the ids that are either; broadcast while they are at most BROADCAST_IDS."""
    own = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    own = cut(own.where("good = 1 or toxic = 1").select("id", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    return F.broadcast(own) if own.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else own


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(utf8(body), 256).alias("digest"), text_mask(body).alias("mask"))
    each = slim.join(marked(labels, key), "id", "left").fillna(0, ["good", "toxic"])
    of = ["digest", "mask", "part", "good", "toxic"]
    ids = each.groupBy(*of, "id").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")  # an id stands once in a group, so n counts the rows of the least one
    groups = cut(ids.groupBy(*of).agg(F.sum("n").alias("n"), first, F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless")))
    least = cut(groups.groupBy("digest").agg(F.min("first.id").alias("least")))
    mine = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    at = groups.join(least, "digest").withColumn("fresh", F.col("nameless") + mine)
    last = 1 << len(FILTERS) - 1
    split = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("fresh").alias("c")), F.struct((F.col("mask") + last).alias("m"), (F.col("n") - F.col("fresh")).alias("c"))))
    rows = at.select("part", "good", "toxic", split.alias("x")).where("x.c > 0")
    return rows.groupBy("part", F.col("x.m").alias("mask")).agg(F.sum("x.c").alias("n"), F.sum(F.col("x.c") * F.col("good")).alias("good"), F.sum(F.col("x.c") * F.col("toxic")).alias("toxic"))


class Diagram:
    """A reduced decision diagram whose ends are counts. A node is (level, passed, failed) and carries the sum of its ends; the level of a filter changes, the filter of a level is in `order`."""

    def __init__(self, counts: dict[int, Counts], filters: str = FILTERS) -> None:
        self.order = list(filters)
        self.known: dict[tuple, int] = {}
        self.nodes: list[tuple] = []  # (level, passed, failed) or (len(order), counts)
        self.sums: list[Counts] = []
        n = len(filters)

        def build(level: int, mask: int) -> int:
            if level == n:
                return self.end(counts.get(mask, (0, 0, 0)))
            return self.node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def end(self, counts: Counts) -> int:
        return self._known((len(self.order), counts), counts)

    def node(self, level: int, passed: int, failed: int) -> int:
        total = tuple(a + b for a, b in zip(self.sums[passed], self.sums[failed], strict=True))
        return self._known((level, passed, failed), total)

    def _known(self, node: tuple, total: Counts) -> int:
        if node not in self.known:
            self.known[node] = len(self.nodes)
            self.nodes.append(node)
            self.sums.append(total)
        return self.known[node]

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next: each node of the level gets the branches (passed, failed) of both in the other order; what lies below stays."""
        done: dict[int, int] = {}

        def rebuilt(at: int) -> int:
            if at not in done:
                here, passed, failed = self.nodes[at]
                if here < level:
                    done[at] = self.node(here, rebuilt(passed), rebuilt(failed))
                else:
                    _, pp, pf = self.nodes[passed]
                    _, fp, ff = self.nodes[failed]
                    done[at] = self.node(level, self.node(level + 1, pp, fp), self.node(level + 1, pf, ff))
            return done[at]

        self.root = rebuilt(self.root)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[Counts, Counts]]:
        """Of each level, from the top, the counts that are kept and removed on the path of passes."""
        at = self.root
        for _ in self.order:
            _, passed, failed = self.nodes[at]
            yield self.sums[passed], self.sums[failed]
            at = passed


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels whose swaps with the next, one after the other, lead through all orders of n: the largest goes through the orders of the rest, back and forth."""
    if n < 2:
        return
    down = True
    for above in [*adjacent_swaps(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if above is not None:
            yield above + (1 if down else 0)  # the largest stands before or behind the rest
        down = not down


COLUMNS = {"filter_order": "string", "step": "int", **dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "long")}


def audit_rows(counts: dict[int, Counts], filters: str = FILTERS) -> list[tuple]:
    """Rows of COLUMNS: every order and step of one part."""
    diagram = Diagram(counts, filters)
    fails = {f: sum(c[0] for m, c in counts.items() if m >> bit & 1) for bit, f in enumerate(filters)}
    only = {f: counts.get(1 << bit, (0, 0, 0))[0] for bit, f in enumerate(filters)}
    rows, shapley = [], dict.fromkeys(filters, 0)
    for level in [*adjacent_swaps(len(filters)), None]:
        order = "".join(diagram.order)
        for step, (f, (kept, removed)) in enumerate(zip(order, diagram.steps(), strict=True), 1):
            rows.append((order, step, kept[0], removed[0], fails[f] - removed[0], only[f], removed[1], removed[2]))
            shapley[f] += removed[0]
        if level is not None:
            diagram.swap(level)
    return [(*r, shapley[r[0][r[1] - 1]]) for r in rows]


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"], strict=True)}
        out = pd.DataFrame(audit_rows(counts), columns=list(COLUMNS))
        out.insert(0, "part", rows["part"].iloc[0])
        return out

    schema = ", ".join(f"{c} {t}" for c, t in {"part": "string", **COLUMNS}.items())
    return mask_counts(docs, labels, key, text, part).groupBy("part").applyInPandas(of, schema)  # at most 2^filters rows a part


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH t AS (SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1) l USING (doc_id)),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (SELECT part, good, toxic, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INT) AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed, coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost FROM m, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
