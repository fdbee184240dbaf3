r"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

A-Z are lower-cased; tokens are the words [^\x20\x09-\x0D]+ and one end for each text. Training texts are those whose
crc32(key as text) mod 7 isn't 2.

The model. The OWN most frequent words have a slot each, the end has one, and other words share TAILS slots by a hash of their last three bytes,
so the slot of any word is known. With w1 and w2 the slots of the two tokens before, P(slot w) is the softmax of
bias[w] + context1[w1] . target1[w] + context2[w2] . target2[w]. A word in a shared slot has the share (c + 1) / (N_slot + V_slot + 1) of it, where one more unseen word
takes what is left. The sum over w that normalises a pair of contexts is a product of two matrices, exp(position 1) and exp(position 2), so all pairs are normalised at once.

Training. Spark counts, over all training texts: words, pairs of each slot and the one after it, and of each slot and the one after the next (at most SLOTS ** 2 sums each).
Position 1 is told from the distribution of single slots. Position 2 is told from what position 1 makes of the same contexts: its expected pairs are the product of the counted pairs and
its probabilities, so position 2 learns only what position 1 doesn't know. Each step of noise-contrastive estimation takes the
gradient over all pairs by weight, with the expectation over the noise in place of draws; so each step learns from every training token in bounded memory.

Scores. In one pass a text's frequent words (the FREQUENT most frequent of at most LONGEST bytes, which are broadcast; a bound) and its slots in their contexts are summed;
its other words are counted by a join with the whole vocabulary.

Defined results: a null text counts as empty and has one token, the end; without training texts N and V are 0 and every token has
base probability 1; repeated rows get a row each; a null key is as an empty text for the fold; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import bounded_batches, cut, table
from topicloom.llm.op5_quality import fold

FOLDS, HELD_OUT = 7, 2
TAILS, OWN, WIDTH = 128, 896, 32
SLOTS = TAILS + OWN
FREQUENT, LONGEST = 100_000, 64
#: Passes over all pairs for each position, noise words a token, and the first step's length.
STEPS, NOISE, STEP = 200, 24, 0.1
#: Words that a task counts, or keeps the slots of, before it begins anew.
FLUSH = 500_000
END = b""


def tail_of(word: bytes) -> int:
    """The shared slot of a word without a slot of its own."""
    return 1 + zlib.crc32(word[-3:]) % (TAILS - 1) if word else 0


class Words(dict):
    """Numbers of words as they come, with their slots; the end is 0 and `own` words come first."""

    def __init__(self, own: Sequence[bytes] = ()) -> None:
        super().__init__({END: 0} | {w: i + 1 for i, w in enumerate(own)})
        self.slots = [0, *range(TAILS, TAILS + len(own))]

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.slots)
        self.slots.append(tail_of(word))
        return at


def tokens(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """The tokens of texts, one after another, and how many each has."""
    flat, sizes = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = (t or b"").lower().split()
        flat += words
        flat.append(END)
        sizes[i] = len(words) + 1
    return flat, sizes


def contexts(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the slots of the one before it and of the one before that in its text; ends stand before a text."""
    one = np.concatenate([[0], slots[:-1]])
    return one, np.where(one == 0, 0, np.concatenate([[0, 0], slots[:-2]])[: len(slots)])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all of docs(text)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter[bytes] = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            words, n = list(known), np.fromiter(known.values(), np.int64, len(known))
            for at in range(0, len(n), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.binary()).cast(pa.string()), pa.array(n[at : at + 50_000])], names=["word", "n"])

        for b in it:
            known.update(tokens(b.column(0).to_pylist())[0])
            if len(known) > FLUSH:
                yield from rows()
                known.clear()
        yield from rows()

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_pairs(docs: DataFrame, own: list[bytes]) -> DataFrame:
    """(cell, n) over all of docs(text): pairs of slots one and, beyond SLOTS ** 2, two places apart."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = Words(own), np.zeros(2 * SLOTS**2, np.int64)
        for b in it:
            known = known if len(known) <= FLUSH else Words(own)
            flat, _ = tokens(b.column(0).to_pylist())
            ids = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
            slots = np.array(known.slots, np.int64)[ids]
            for i, c in enumerate(contexts(slots)):
                n[i * SLOTS**2 : (i + 1) * SLOTS**2] += np.bincount(c * SLOTS + slots, minlength=SLOTS**2)
        seen = np.flatnonzero(n)
        for at in range(0, len(seen), 50_000):
            part = seen[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], names=["cell", "n"])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(batches, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


@dataclass
class LogBilinear:
    """Vectors by position: contexts (2, slots, WIDTH), targets (2, slots, WIDTH), bias (2, slots)."""

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def position(self, i: int) -> np.ndarray:
        """(slots, slots): what the context at a position adds to each slot."""
        return self.context[i] @ self.target[i].T + self.bias[i]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both positions and, for each pair of contexts, the logarithm of the sum that normalises; natural logarithms."""
        one, two = self.position(0), self.position(1)
        one -= one.max(axis=1, keepdims=True)
        two -= two.max(axis=1, keepdims=True)
        return one, two, np.log(np.exp(one) @ np.exp(two).T + 1e-30)


def contrast(counts: np.ndarray, noise: np.ndarray, log_noise: np.ndarray, steps: int, rng: np.random.Generator, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Noise-contrastive estimation by AdaGrad over all pairs: counts and expected noise are (slots, slots). The model is context . target + bias, less log_noise in the test between the two."""
    n, total = len(counts), max(1.0, float(counts.sum(dtype=np.float64)))
    context, target, bias = rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32), np.zeros((n, WIDTH), np.float32), bias.astype(np.float32)
    both = ((counts + noise) / total).astype(np.float32)
    real = (counts / total).astype(np.float32)
    sums = [np.full_like(x, 1e-9) for x in (context, target, bias)]
    for _ in range(steps):
        raw = context @ target.T + (bias - log_noise).astype(np.float32)
        d = both / (1 + np.exp(-np.clip(raw, -40, 40))) - real
        for x, g, s in zip((context, target, bias), (d @ target, d.T @ context, d.sum(axis=0)), sums, strict=True):
            s += g * g
            x -= STEP * g / np.sqrt(s)
    return context, target, bias


def train(pairs: np.ndarray, steps: int = STEPS, seed: int = 7) -> LogBilinear:
    """The model of pairs (2, slots, slots), counted one and two places apart."""
    rng, (near, far) = np.random.default_rng(seed), pairs.astype(np.float64)
    single = near.sum(axis=0) + 1.0
    single /= single.sum()
    one = contrast(near, NOISE * near.sum(axis=1, keepdims=True) * single, np.log(NOISE * single), steps, rng, np.log(single))
    known = one[0] @ one[1].T + one[2]
    known = np.exp(known - known.max(axis=1, keepdims=True))
    # the contexts of tokens: each pair is one but for the ends, after which a text begins with two ends
    before = near.copy()
    before[:, 0] = 0
    before[0, 0] = near[:, 0].sum()
    expected = before @ (known / known.sum(axis=1, keepdims=True))
    two = contrast(far, NOISE * expected, np.full(len(far), np.log(NOISE)), steps, rng, np.zeros(len(far)))
    return LogBilinear(*(np.stack(x) for x in zip(one, two, strict=True)))


@dataclass
class Fitted:
    """What scores need: the most frequent words with their counts (the first `own` words among them have slots), all words (word, n), N and V, the model, and log10 (N_slot + V_slot + 1) of the shared slots."""

    names: list[bytes]
    counts: np.ndarray
    own: list[bytes]
    words: DataFrame
    n: int
    v: int
    model: LogBilinear
    inside: np.ndarray


def fit(known: DataFrame, frequent: int = FREQUENT, steps: int = STEPS) -> Fitted:
    """Learn from all of known(text as binary)."""
    words = cut(count_words(known))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_end = F.col("word") == ""
    often = words.where(is_end | ((F.octet_length("word") <= LONGEST) & (F.col("n") >= total // (10 * frequent))))  # at most ten times `frequent` words can be so common, however many there are
    top = often.orderBy(F.desc(is_end), F.desc("n"), "word").select("word", "n").limit(frequent).toArrow()
    names = top["word"].cast(pa.binary()).to_pylist()
    own = [w for w in names if w != END][:OWN]
    tail = F.when(is_end | F.col("word").isin([w.decode() for w in own]), 0).otherwise(1 + F.pmod(F.crc32(F.substring(F.col("word").cast("binary"), -3, 3)), F.lit(TAILS - 1)))
    by_slot = {r["slot"]: (r["n"], r["v"]) for r in words.groupBy(tail.cast("int").alias("slot")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # a row a shared slot
    counted = count_pairs(known, own).toArrow()  # at most 2 * SLOTS ** 2 rows of 12 bytes
    pairs, used = np.zeros(2 * SLOTS**2), TAILS + len(own)
    pairs[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    model = train(pairs.reshape(2, SLOTS, SLOTS)[:, :used, :used], steps)
    inside = np.log10([1] + [sum(by_slot.get(c, (0, 0))) + 1 for c in range(1, TAILS)])
    return Fitted(names, top["n"].to_numpy(), own, words, int(total), sum(x for _, x in by_slot.values()), model, inside)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", learn: Column | None = None, frequent: int = FREQUENT, steps: int = STEPS) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for every row of docs; `learn` marks the training rows."""
    learn = fold(F.col(key), FOLDS) != HELD_OUT if learn is None else learn
    return apply(docs, fit(docs.where(learn).select(F.col(text).cast("binary").alias("text")), frequent, steps), key, text)


def apply(docs: DataFrame, fitted: Fitted, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The scores of every row of docs by what was fitted."""
    spark, body = docs.sparkSession, F.col(text).cast("binary").alias("text")
    shared = spark.sparkContext.broadcast((fitted.names, fitted.counts, fitted.own, fitted.model, fitted.inside))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, often, own, model, inside = shared.value
        one, two, whole = (np.ascontiguousarray(x, np.float32).ravel() for x in model.tables())
        size, seen = TAILS + len(own), None
        for b in it:
            if seen is None or len(seen) > len(names) + FLUSH:
                seen = Words(own)
                at = np.fromiter(map(seen.__getitem__, names), np.int64, len(names))
                log_c = np.full(len(seen.slots), np.nan)
                log_c[at] = np.log10(often + 1.0)
            flat, sizes = tokens(b.column(1).to_pylist())
            ids = np.fromiter(map(seen.__getitem__, flat), np.int64, len(flat))
            slots = np.array(seen.slots, np.int64)[ids]
            log_n = np.where(ids < len(log_c), log_c[np.minimum(ids, len(log_c) - 1)], np.nan)
            rare, tail = np.isnan(log_n), (slots > 0) & (slots < TAILS)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
            at_rare = np.flatnonzero(rare)
            ends = np.concatenate([[0], np.cumsum(add(rare.astype(np.int64)))]).astype(np.int32)
            left = pa.ListArray.from_arrays(pa.array(ends), pa.array([flat[i] for i in at_rare], pa.binary()).cast(pa.string()))
            c1, c2 = contexts(slots)
            in_context = (one[c1 * size + slots].astype(np.float64) + two[c2 * size + slots] - whole[c1 * size + c2]) / np.log(10)
            in_context += np.where(tail, np.where(rare, 0.0, log_n) - inside[np.where(tail, slots, 0)], 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(add((~rare).astype(np.int64))), pa.array(add(np.where(rare, 0.0, log_n))), pa.array(add(in_context)), left], names=["key", "n_tokens", "known", "log_c", "in_context", "rare"])

    bounded_batches(spark)
    schema = f"key {dict(docs.dtypes)[key]}, n_tokens long, known long, log_c double, in_context double, rare array<string>"
    parts = docs.select(F.col(key).alias("key"), body).mapInArrow(batches, schema)
    parts = cut(parts.withColumn("row", F.monotonically_increasing_id()))
    tails = parts.select("row", F.explode("rare").alias("word")).join(fitted.words, "word")  # a rare word's slot is always shared
    tails = tails.groupBy("row").agg(F.count("*").alias("known2"), F.sum(F.log10(F.col("n") + 1.0)).alias("log_c2"))
    rest = F.coalesce("log_c2", F.lit(0.0))
    return parts.join(tails, "row", "left").select(
        F.col("key").alias(key), "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(fitted.n).cast("long").alias("train_tokens"),
        (F.col("log_c") + rest - F.col("n_tokens") * F.lit(float(np.log10(fitted.n + fitted.v + 1)))).alias("base_score"), (F.col("in_context") + rest).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
