"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays for numpy traversal.

Labels are learned from rows whose crc32(key as text) mod 5 isn't 0, at most SAMPLE of them (the documented bound of the fit; the
labelled rows with the least hashes). Scores need the text alone and cover every row, whole texts included.

Defined results: a null text scores as an empty one; several labels of one key count as their least; without labels of both classes
the score is the share of label 1 (0.5 without any); repeated rows score alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import bounded_batches, table, text_digest

FOLDS, SAMPLE, THRESHOLD = 5, 20_000, 0.3
TREES, DEPTH, RATE, SMOOTH, BINS, LEAST = 60, 4, 0.2, 1.0, 64, 2.0
_MARKS = b"!#$%&*|@~^_<>{}[]=+\\/"


def statistics(text: bytes) -> list[float]:
    """Statistics of one text in UTF-8."""
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lower, upper = bytes_[97:123].sum(), bytes_[65:91].sum()
    distinct = len(set(words))
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        lower / n, upper / n, bytes_[48:58].sum() / n, bytes_[128:].sum() / n, bytes_[32] / n,
        (bytes_[44] + bytes_[46]) / n_words, bytes_[list(_MARKS)].sum() / n_words, bytes_[33] / n_words, bytes_[124] / n_words, bytes_[[60, 62, 123, 125]].sum() / n_words, bytes_[[58, 59]].sum() / n_words,
        bytes_[[63]].sum() / n_words, upper / max(1, lower + upper), n_words / n_lines, len(set(lines)) / n_lines, distinct / n_words, np.log1p(distinct), (lengths == 1).mean(), bytes_[:32].sum() / n,
    ]


@dataclass
class Trees:
    """Complete trees as arrays: the test of each inner node, and the value of each leaf."""

    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2^depth)
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at, tree = np.zeros((len(x), len(self.leaf)), np.int32), np.arange(len(self.leaf))[None, :]
        rows = np.arange(len(x))[:, None]
        for _ in range(int(self.leaf.shape[1]).bit_length() - 1 if len(self.leaf) else 0):
            at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.threshold[tree, at])
        raw = self.start + self.leaf[tree, at - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Newton steps on the logistic loss, over quantile bins. Without both classes, or without rows, a constant."""
    share = float(y.mean()) if len(y) else 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    n, raw = x.shape[1], np.full(len(y), start)
    out = Trees(np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9), np.zeros(width, np.int64), np.full(width, BINS, np.int64)
            for f in range(n):
                cell = node * BINS + binned[f]
                gs = np.cumsum(np.bincount(cell, g, width * BINS).reshape(width, BINS), axis=1)
                hs = np.cumsum(np.bincount(cell, h, width * BINS).reshape(width, BINS), axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + SMOOTH) + (ga - gs) ** 2 / (ha - hs + SMOOTH) - ga**2 / (ha + SMOOTH)
                gain[(hs < LEAST) | (ha - hs < LEAST)] = 0
                gain[:, len(edges[f]) :] = 0
                at = gain.argmax(axis=1)
                better = (top := gain[np.arange(width), at]) > best[0]
                for old, new in zip(best, (top, np.full(width, f), at), strict=True):
                    old[better] = new[better]
            for k in range(width):
                if best[2][k] < BINS:
                    out.feature[t, first + k], out.threshold[t, first + k] = best[1][k], edges[best[1][k]][best[2][k]]
            node = 2 * node + (binned[best[1][node], np.arange(len(y))] > best[2][node])
        out.leaf[t] = -RATE * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + SMOOTH)
        raw += out.leaf[t][node]
    return out


def fold(key: Column, folds: int = FOLDS) -> Column:
    """crc32 of the key as text, mod folds; a null key is as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _table(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(bytes(t) if t is not None else b"") for t in texts], np.float64).reshape(len(texts), -1)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit on a bounded sample; only its statistics come to the driver, at most `sample` rows of some twenty numbers. Of rows that repeat a key, the one with the least text digest counts."""

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_table(texts)))

    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key)) != 0)).groupBy(key).agg(F.min(label).alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64(key), key).limit(sample))  # at most `sample` rows of two numbers
    rows = docs.select(key, F.col(text).cast("binary").alias("text")).join(chosen, key).select(key, "label", text_digest(F.col("text")).alias("digest"), measured("text").alias("x"))
    rows = rows.groupBy(key).agg(F.min(F.struct("digest", "label", "x")).alias("least")).select(key, "least.label", "least.x").toArrow().sort_by(key)
    return fit(np.array(rows["x"].to_pylist(), np.float64).reshape(len(rows), len(statistics(b""))), (rows["label"].to_numpy() > 0).astype(float))


def scorer(model: Trees, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_table(texts)))

    return score(text.cast("binary"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score under the threshold."""
    model = train(docs, labels)
    return docs.where(scorer(model, F.col("text")) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), scorer(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
