"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and share all words; no target passes `cap` times
its source's size, and the excess is shared anew by weight among the others until none is above.

Within a source, a document's key is -ln(u) / quality with u from a digest of its id and text, so a heavier document tends to a smaller key. A target holds
floor(target / size) complete epochs; the rest goes to documents in order of key, id and text digest while the words before a document and half of its
own fit, so that the words taken miss the target by at most half a document. Rows alike in id and text follow each other; where the budget ends among
them, as many of them are taken as fit.

The order is never that of one sort or one task: keys fall into BINS ordered bins of BINS cells each, which are summed before the shuffle, and
only the cell in which a source's budget ends is sorted, rows alike being one by then. Whether a document is picked then
follows from its own key and its source's row, so texts aren't shuffled; only the rows alike at a budget's end are written and numbered.

Defined results: a null text has size 0 and is taken for 0 words; null sources are a source of their own; null ids are told apart by their texts; repeated rows
are picked one after another; an empty table gives no rows; other columns are kept by `sample` and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.llm.common import cut, numbered, space_word_count, table, utf8

CYCLE, CAP, BINS = (5, 2, 1), 3, 4096
#: Sources whose plan is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: How many words a mark of junk, and a line that is there again, count against a document.
MARKS, MARK_WEIGHT, LINE_WEIGHT = r"[#$%&*|!]", 4, 10


def quality(text: Column) -> Column:
    """Words over words and what counts against them, junk marks and repeated lines, in (0, 1]; 1 for a text without words. A simple measure that SQL can repeat; jobs pass the score of a classifier."""
    size = space_word_count(text)
    marks = F.coalesce(F.regexp_count(text, F.lit(MARKS)), F.lit(0))
    lines = F.array_remove(F.split(text, "\n"), "")
    against = marks * MARK_WEIGHT + (F.size(lines) - F.size(F.array_distinct(lines))) * LINE_WEIGHT
    return F.when(size > 0, size.cast("double") / (size + against).cast("double")).otherwise(F.lit(1.0))


def sampling_key(ident: Column, digest: Column, weight: Column) -> Column:
    uniform = (F.conv(F.substring(F.md5(F.concat(ident, F.lit("/"), digest).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(uniform) / weight


def targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, cap: int = CAP) -> DataFrame:
    """sizes(source, source_size) with target. Sorted by how soon they meet their cap, the first source that keeps below it gives the level of all that follow. One row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1)
    by_cap = Window.orderBy("full_at", "rank")
    known = (
        sizes.withColumn("rank", F.row_number().over(order))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("full_at", F.col("most").cast("double") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) + F.col("most"))
        .withColumn("heft", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.col("left").cast("double") / F.col("heft"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(Window.partitionBy()))
    )
    return known.select("source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("most").cast("double")).alias("target"))


def _end(sums: DataFrame, at: str) -> DataFrame:
    """sums(source, at, words, before, rest) to the first place of each source where its budget ends: (source, at, before, rest)."""
    so_far = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy(at)) - F.col("words")
    ends = sums.withColumn("before", so_far).where("before < rest and before + words >= rest")
    return cut(ends.groupBy("source").agg(F.min_by(F.struct(at, "before", "rest"), at).alias("e")).select("source", "e.*"))


def plan(slim: DataFrame, cycle: tuple[int, ...] = CYCLE, cap: int = CAP) -> DataFrame:
    """slim(source, size, order_key, id, digest, bin, cell) to a row a source: source_size, target, epochs, and where the rest ends: all before `last_bin` or up to `last` are picked, and `part` of the rows alike at `edge`."""
    bins = cut(slim.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    goal = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), cycle, cap)
    goal = cut(
        goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    ends = _end(bins.alias("b").join(_bounded(goal.alias("g")), F.expr("b.source <=> g.source")).selectExpr("b.source as source", "bin", "words", "0L as before", "rest"), "bin")
    cells = slim.alias("s").join(_bounded(ends.alias("e")), F.expr("s.source <=> e.source and s.bin = e.bin"))
    last_cell = _end(cells.groupBy("s.source", "s.cell", "before", "rest").agg(F.sum("size").alias("words")), "cell")
    alike = slim.alias("s").join(_bounded(last_cell.alias("e")), F.expr("s.source <=> e.source and s.cell = e.cell"))
    alike = alike.groupBy("s.source", "order_key", "id", "digest", "size", "before", "rest").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    room = F.col("rest") - F.col("before") - (F.sum("words").over(Window.partitionBy("source").orderBy("order_key", "id", "digest").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    fit = F.when(F.col("size") == 0, F.when(room >= 0, F.col("n")).otherwise(0)).otherwise(F.least(F.greatest(F.floor((room - F.col("size") / 2.0) / F.col("size")) + 1, F.lit(0)), F.col("n")))
    tuple_ = F.struct("order_key", "id", "digest")
    last = alike.withColumn("fit", fit.cast("long")).where("fit > 0").groupBy("source").agg(
        F.max(F.when(F.col("fit") == F.col("n"), tuple_)).alias("last"), F.max(F.when(F.col("fit") < F.col("n"), tuple_)).alias("edge"), F.max(F.when(F.col("fit") < F.col("n"), F.col("fit"))).alias("part")
    )
    found = last_cell.alias("e").join(last.alias("l"), F.expr("e.source <=> l.source"), "left").selectExpr("e.source as source", "cell as last_cell", "last", "edge", "part")
    return cut(goal.alias("g").join(found.alias("f"), F.expr("g.source <=> f.source"), "left").selectExpr("g.source as plan_source", "source_size", "target", "epochs", "last_cell", "last", "edge", "part"))


def _bounded(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else small


def placed(docs: DataFrame, key: Column, source: Column, size: Column, weight: Column, digest: Column) -> DataFrame:
    """All columns of docs in the struct `doc`, with what the mix goes by; rows alike in source, id, digest and size are interchangeable."""
    named = docs.select(F.struct("*").alias("doc"), key.alias("key"), F.coalesce(key.cast("string"), F.lit("")).alias("id"), digest.alias("digest"), source.alias("source"), size.alias("size"), weight.alias("weight"))
    named = named.withColumn("order_key", sampling_key(F.col("id"), F.col("digest"), F.col("weight"))).drop("weight")
    cell = F.least(F.floor(F.col("order_key") / (F.col("order_key") + 1) * (BINS * BINS)), F.lit(BINS * BINS - 1))
    return named.withColumn("cell", cell).withColumn("bin", F.expr(f"cell div {BINS}"))


def decided(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """placed rows with the columns of their source's plan and how many copies of each the mix takes."""
    at = rows.join(_bounded(goal), F.expr("source <=> plan_source"))
    own = F.struct("order_key", "id", "digest")
    picked = F.coalesce((F.col("cell") < F.col("last_cell")) | ((F.col("cell") == F.col("last_cell")) & F.coalesce(own <= F.col("last"), F.lit(False))), F.lit(False))
    whole = at.withColumn("copies", F.col("epochs") + picked.cast("long"))
    if goal.where("edge is not null").isEmpty():
        return whole
    on_edge = F.coalesce(own == F.col("edge"), F.lit(False))
    edge = numbered(cut(whole.where(on_edge).withColumn("row", F.monotonically_increasing_id())), ["source"])
    return whole.where(~on_edge).unionByName(edge.withColumn("copies", F.col("epochs") + (F.col("number") < F.col("part")).cast("long")).select(*whole.columns))


def copies(docs: DataFrame, key: Column, source: Column, size: Column, weight: Column, digest: Column | None = None, cycle: tuple[int, ...] = CYCLE, cap: int = CAP) -> DataFrame:
    """All columns of docs in the struct `doc`, with size, source_size, target and how many copies of each document the mix takes."""
    rows = placed(docs, key, source, size, weight, F.lit("") if digest is None else digest)
    return decided(rows, plan(cut(rows.drop("doc")), cycle, cap)).select("doc", "size", "source_size", "target", "copies")


def _by_words(docs: DataFrame, weight: Column | None = None) -> tuple[DataFrame, Column, Column, Column, Column, Column]:
    text = F.col("text")
    return docs, F.col("doc_id"), F.col("source"), space_word_count(text), quality(text) if weight is None else weight, F.md5(utf8(text))


def mix(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    return copies(*_by_words(docs, weight))


#: What a weight is at least, so that every document may be taken.
LEAST_WEIGHT = 0.01


def sample(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs. `weight` is a quality from 0 to 1 that follows from the row alone, for it is computed for the plan and again where texts are picked; quality(), if not given."""
    weight = None if weight is None else F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(LEAST_WEIGHT))
    return mix(docs, weight).where("copies > 0").select(F.col("doc"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = cut(placed(*_by_words(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))).drop("doc"))  # no text is needed beyond this
    return decided(slim, plan(slim)).select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, text, coalesce(CAST(doc_id AS VARCHAR), '') AS id, md5(coalesce(text, '')) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT doc_id, source, size, id, digest,
        -ln((CAST('0x' || substr(md5(id || '/' || digest), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
        / CASE WHEN size > 0 THEN size::DOUBLE / (size + 4 * len(regexp_extract_all(text, '[#$%&*|!]')) + 10 * (len(lines) - len(list_distinct(lines))))::DOUBLE ELSE 1 END AS k FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM d)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM k GROUP BY source),
w AS (SELECT *, [5, 2, 1][(r - 1) % 3 + 1] AS weight, source_size * 3 AS most, (source_size * 3)::DOUBLE / [5, 2, 1][(r - 1) % 3 + 1] AS full_at FROM s),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - sum(most) OVER (ORDER BY full_at, r) + most AS DOUBLE)
        / sum(weight) OVER (ORDER BY full_at, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least((SELECT max(level) FROM l WHERE level <= full_at) * weight, most::DOUBLE) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
c AS (SELECT k.doc_id, k.size, source_size, target, epochs, target - epochs * source_size AS rest,
        sum(size) OVER (PARTITION BY k.source ORDER BY k, id, digest ROWS UNBOUNDED PRECEDING) - size AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
