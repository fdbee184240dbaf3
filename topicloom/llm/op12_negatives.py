r"""Hard negatives by anchor-clustered shared lists.

Components become floor(256 * x), x as double; scores are integer inner products, higher first, ties by the smaller id. An anchor's positives are its first other rows of the same label; for each of them the negatives
are the first rows of other labels whose score lies in a window of shares of the positive's score.

Anchors are clustered by direction (spherical k-means, fitted on at most SAMPLE anchors; every anchor is assigned). All vectors meet the anchors in blocks: an anchor cell, of at most about CELL anchors of
a few clusters, with a part of all vectors, of about PART rows. There, each cluster sorts the part once by an upper bound of |v| cos(angle between v and any member), from v's angle to the centre and the cluster's radius;
every member walks that shared list, a chunk at a time, until the bound times its own length falls below the worst score that could still be of use: certified, so that nothing is missed. The best of
all parts are merged. Positives come first, as their scores fix the windows; a second walk finds the negatives, and starts with what the windows need at least.

Memory: a cell, a part and a chunk of scores. A common vector makes a large cluster, which is dealt into cells by hash. The number of blocks grows with anchors times rows, as the query set against all rows does; vectors
are sent once for each cell of anchors, anchors once for each part.

Defined results: rows with a null label, id or vector, or a null or non-finite component take no part; a shorter vector ends in zeros, an empty one is zero; equal ids are told apart by row, but a row with the anchor's
id isn't another row; an anchor that is repeated gives its rows again; fewer candidates than asked for give as many as there are, none give no row; an empty table gives no rows; other columns are not read.
Scores of integers too large for exact doubles are computed with Python's; one of more than 62 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import cut, table

POSITIVES, NEGATIVES = 5, 3
#: The window of negatives, in hundredths of the positive's score.
LOW, HIGH = 50, 95
SAMPLE, CLUSTERS, ROUNDS, SEED = 8192, 64, 8, 42
CELL, PART, CHUNK = 8192, 32768, 2048
#: What rounding may add to a bound, as a share of both lengths and at all.
SLACK = 1e-6
EXACT = 2**53
_LOWEST = -(2**62)


def integers(vector: Column) -> Column:
    """floor(256 * x) of the components; null for a vector that takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & sound, F.transform(vector, lambda x: F.floor(x.cast("double") * 256)))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of longs as rows of one length, with zeros behind the short ones."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    sizes = np.diff(ends, prepend=0)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def centres(sample: np.ndarray, clusters: int) -> np.ndarray:
    """Unit centres of at most `clusters` clusters of directions; no more than one for every eight vectors."""
    units = unit(sample)
    units = units[(units != 0).any(axis=1)]
    k = min(clusters, -(-len(units) // 8))
    if not k:
        return np.zeros((0, sample.shape[1]))
    at = units[np.random.default_rng(SEED).choice(len(units), k, replace=False)]
    for _ in range(ROUNDS):
        near = (units @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, units)
        moved = unit(sums)
        at = np.where((moved != 0).any(axis=1, keepdims=True), moved, at)
    return at


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def resized(vectors: np.ndarray, width: int) -> np.ndarray:
    return vectors if vectors.shape[1] >= width else np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def bounds(part: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Of each vector of the part, an upper bound of its score with any member, for a member of length 1."""
    own = unit(members)
    own = own[(own != 0).any(axis=1)]
    lengths = np.sqrt((part.astype(np.float64) ** 2).sum(axis=1))
    centre = unit(own.sum(axis=0, keepdims=True)) if len(own) else np.zeros((1, part.shape[1]))
    if not len(own) or not centre.any():
        return lengths
    radius = np.clip((own @ centre[0]).min(), -1, 1)
    angle = np.clip(unit(part) @ centre[0], -1, 1)
    apart = angle * radius + np.sqrt((1 - angle**2) * (1 - radius**2))
    return lengths * np.minimum(1, np.where(angle >= radius, 1.0, apart) + SLACK)


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the first `keep` of each row's (score, id) pairs, in order."""
    order = np.lexsort((ids, -scores, rows))
    rows = rows[order]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    rank = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    return order[rank < keep]


class Walk:
    """The members of one cell against one part: `keep` best candidates in each of their windows. Windows are inclusive; those of one member share its walk."""

    def __init__(self, members: dict[str, np.ndarray], part: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, same: bool, keep: int) -> None:
        self.members, self.part, self.low, self.high, self.same, self.keep = members, part, low, high, same, keep
        self.windows = low.shape[1]
        self.found = [np.zeros(0, np.int64)] * 3  # (member and window, score, id)
        self.worst = low.copy()  # what a candidate must have at least

    def run(self) -> list[np.ndarray]:
        vectors, part = self.members["vector"], self.part["vector"]
        for cluster in np.unique(self.members["cluster"]):
            own = np.flatnonzero(self.members["cluster"] == cluster)
            bound = bounds(part, vectors[own])
            shared = np.argsort(-bound, kind="stable")  # once for all members
            length = np.sqrt((vectors[own].astype(np.float64) ** 2).sum(axis=1))
            for at in range(0, len(shared), CHUNK):
                useful = bound[shared[at]] * length * (1 + SLACK) + 0.5 >= self.worst[own].min(axis=1)
                own, length = own[useful], length[useful]
                if not len(own):
                    break
                self.chunk(own, shared[at : at + CHUNK])
        return self.found

    def chunk(self, own: np.ndarray, these: np.ndarray) -> None:
        """Score members against candidates and keep those that are among the best so far."""
        a, b = self.members["vector"][own], self.part["vector"][these]
        scores = products(a, b)
        alike = self.members["label"][own][:, None] == self.part["label"][these][None, :]
        fits = alike & (self.members["id"][own][:, None] != self.part["id"][these][None, :]) if self.same else ~alike
        for w in range(self.windows):
            at = np.nonzero(fits & (scores >= self.worst[own, w][:, None]) & (scores <= self.high[own, w][:, None]))
            if len(at[0]):
                self.add(own[at[0]] * self.windows + w, scores[at].astype(np.int64), self.part["id"][these[at[1]]])

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        held = np.isin(self.found[0], rows)
        now = [np.r_[f[held], x] for f, x in zip(self.found, (rows, scores, ids), strict=True)]
        kept = best(*now, self.keep)
        now = [x[kept] for x in now]
        self.found = [np.r_[f[~held], x] for f, x in zip(self.found, now, strict=True)]
        last = np.r_[now[0][1:] != now[0][:-1], True]
        count = np.diff(np.flatnonzero(last), prepend=-1)
        full = now[0][last][count == self.keep]
        self.worst.ravel()[full] = now[1][last][count == self.keep]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = lambda x: int(np.abs(x).max(initial=0))
    if a.shape[1] * most(a) * most(b) < EXACT:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    out = a.astype(object) @ b.T.astype(object)
    if most(out) > -_LOWEST:
        raise OverflowError("a score needs more than 62 bits")
    return out


def walked(anchors: DataFrame, rows: DataFrame, parts: int, windows: Column, same: bool, keep: int) -> DataFrame:
    """(row, window, score, id): of every anchor(row, id, label, vector, cluster, cell, ...) and each of its windows(low, high) the first `keep` rows of each part, of the same label or of others."""

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        a, b = matrix(left.column("vector")), matrix(right.column("vector"))
        width = max(a.shape[1], b.shape[1])
        numbers = lambda t, *cs: {c: t.column(c).to_numpy() for c in cs}
        members = numbers(left, "id", "label", "cluster") | {"vector": resized(a, width)}
        part = numbers(right, "id", "label") | {"vector": resized(b, width)}
        offsets = left.column("windows").combine_chunks()
        count = offsets.value_lengths().to_numpy(zero_copy_only=False)
        low, high = np.full((len(count), max(1, count.max())), -_LOWEST), np.full((len(count), max(1, count.max())), _LOWEST)
        at = np.arange(low.shape[1])[None, :] < count[:, None]
        flat = offsets.flatten()
        low[at], high[at] = flat.field("low").to_numpy(), flat.field("high").to_numpy()
        found = Walk(members, part, low, high, same, keep).run()
        row, window = left.column("row").to_numpy()[found[0] // low.shape[1]], found[0] % low.shape[1]
        return pa.Table.from_arrays([pa.array(x) for x in (row, window.astype(np.int32), found[1], found[2])], names=names)

    names = ["row", "window", "score", "id"]
    empty = pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names=names)
    grid = anchors.withColumn("windows", windows).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("row", "id", "label", "vector", "cluster", "windows", "cell", "part")
    cells = anchors.agg(F.max("cell")).first()[0]
    if cells is None:
        return anchors.sparkSession.createDataFrame([], "row long, window int, score long, id long")
    spread = rows.select("id", "label", "vector", "part", F.explode(F.sequence(F.lit(0), F.lit(cells))).alias("cell"))
    return grid.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInArrow(block, "row long, window int, score long, id long")


def firsts(found: DataFrame, keep: int) -> DataFrame:
    """(row, window, best): the first `keep` (score, id) over all parts; each part has sent no more than that."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id")))
    return found.groupBy("row", "window").agg(F.slice(order, 1, keep).alias("best"))


def assigned(anchors: DataFrame, sample: int, clusters: int, cell: int) -> DataFrame:
    """anchors(row, id, label, vector) with their cluster and cell; the centres are fitted on at most `sample` anchors, those of the least hashes."""
    some = anchors.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column("vector")
    at = centres(matrix(some), clusters)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                own = unit(matrix(pa.chunked_array([b.column(3)])))
                width = max(own.shape[1], at.shape[1])
                near = (resized(own, width) @ resized(at, width).T).argmax(axis=1) if len(at) else np.zeros(b.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=[*b.schema.names, "cluster"])

    named = cut(anchors.select("row", "id", "label", "vector").mapInArrow(batches, "row long, id long, label int, vector array<long>, cluster int"))
    sizes = {r["cluster"]: r["count"] for r in named.groupBy("cluster").count().collect()}  # a row a cluster
    first, split, filled, next_cell = {}, {}, 0, 0
    for c in sorted(sizes):
        split[c] = max(1, -(-sizes[c] // cell))
        if filled and (filled + sizes[c] > cell):
            next_cell, filled = next_cell + 1, 0
        first[c] = next_cell
        if split[c] > 1:
            next_cell, filled = next_cell + split[c], 0
        else:
            filled += sizes[c]
    if not sizes:
        return named.withColumn("cell", F.lit(0))
    of = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("cluster"))
    return named.withColumn("cell", (of(first) + F.pmod(F.xxhash64("row"), of(split))).cast("int"))


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, cell: int = CELL, part: int = PART) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where `anchor` holds, and each of its positives, the negatives in its window."""
    sound = vectors.select(F.col(key).cast("long").alias("id"), label.cast("int").alias("label"), integers(F.col(vector)).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")).where("id is not null and label is not null and vector is not null")
    rows = cut(sound.withColumn("row", F.monotonically_increasing_id()))
    parts = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // part))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    anchors = cut(assigned(rows.where("anchor"), SAMPLE, CLUSTERS, cell))
    every = F.array(F.struct(F.lit(_LOWEST).cast("long").alias("low"), F.lit(-_LOWEST).cast("long").alias("high")))
    near = cut(firsts(walked(anchors, rows, parts, every, True, positives), positives).select("row", "best"))
    with_best = cut(anchors.join(near, "row"))
    hundredth = lambda x, up: F.call_function("div", x + F.pmod(-x, F.lit(100)) if up else x - F.pmod(x, F.lit(100)), F.lit(100))
    # low * p <= 100 * n <= high * p, in integers
    window = F.transform("best", lambda x: F.struct(hundredth(x["down"] * -low, True).alias("low"), hundredth(x["down"] * -high, False).alias("high")))
    found = firsts(walked(with_best, rows, parts, window, False, negatives), negatives)
    out = with_best.select("row", F.col("id").alias("anchor_id"), "best").join(found.select("row", "window", F.col("best").alias("negative")), "row")
    positive = F.element_at("best", F.col("window") + 1)
    each = out.select("anchor_id", positive.alias("p"), F.posexplode("negative").alias("at", "n"))
    return each.select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), (-F.col("p.down")).alias("positive_score"), (-F.col("n.down")).alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


ORACLE_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT a, b AS p, score AS ps FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, b) AS INT) AS rank, b AS negative_id, ps AS positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT alike AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps QUALIFY rank <= 3
"""
