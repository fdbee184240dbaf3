r"""SimHash near-duplicates by anchor points of a covering code.

Texts: A-Z lower-cased, words [^\x20\x09-\x0D]+, shingles of consecutive words (repeats count), XXH64 with seed 42.
Defined results: a null or wordless text has fingerprint 0 and links like any other; equal rows and repeated ids keep
one output row each; an empty table gives no rows; other columns of the input are not read.

Linking within `threshold` bits. Each fingerprint has two 32-bit halves; a linked pair differs in at most
t = threshold // 2 bits in one of them. On a half, the anchors are the code {x : XOR of the indices of x's set bits is 0}
(an extended Hamming code with one free bit): 2^27 words, covering radius 1. A fingerprint is copied to every anchor within the
covering radius plus the threshold. Both of a pair are copied, so each only has to reach the point midway between them:
within 1 + ceil(t / 2) of its half. For 4 bits that is 17 anchors a half, over 2^28 anchors. Only distinct fingerprints are
copied; each anchor reports a spanning forest instead of all pairs, and anchors with many fingerprints are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.llm.common import BROADCAST_IDS, bounded_batches, cut, drop_ids, table, text_digest
from topicloom.llm.components import connected_components

SEED, SHINGLE, THRESHOLD = 42, 4, 4
#: Fingerprints at an anchor that one task compares at once, and the block that a larger anchor is dealt into.
ANCHOR_ROWS, BLOCK_ROWS = 1024, 512
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    words = text.lower().split()  # of bytes: A-Z alone, and the six ASCII spaces
    if not words:
        return 0
    line, k = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * votes > len(starts)).tolist())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([simhash((t or "").encode(), shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[key, "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(key, F.col(text).cast("string")).mapInArrow(batches, f"{key} {dict(docs.dtypes)[key]}, fp long")


def flips(reach: int) -> list[list[int]]:
    """For each of the 32 syndromes, the masks of at most `reach` of 32 bits that lead to an anchor."""
    out: list[list[int]] = [[] for _ in range(32)]
    for n in range(reach + 1):
        for bits in combinations(range(32), n):
            syndrome = 0
            for j in bits:
                syndrome ^= j
            out[syndrome].append(sum(1 << j for j in bits))
    return out


def anchors(half: Column, reach: int) -> Column:
    """All anchors within `reach` bits of a 32-bit half (a long)."""
    syndrome = F.lit(0)
    for k in range(5):
        mask = sum(1 << j for j in range(32) if j >> k & 1)
        syndrome = syndrome + F.bit_count(half.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * (1 << k)
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in flips(reach)])
    return F.transform(F.element_at(masks, (syndrome + 1).cast("int")), lambda m: m.bitwiseXOR(half))


def forest(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to the least position of its component among these."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= threshold
    root, last = np.arange(len(fp), dtype=np.int32), None
    while last is None or (root != last).any():
        last = root
        root = np.where(near, root[None, :], np.int32(len(fp))).min(axis=1)
        root = root[root]
    at = np.flatnonzero(root != np.arange(len(fp)))
    return fp[at], fp[root[at]]


def _forests(threshold: int, group: list[str]):
    """For rows in order of `group`: the forests of each group, which may go on over several batches."""

    def of(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        cuts = np.flatnonzero((pdf[group].to_numpy()[1:] != pdf[group].to_numpy()[:-1]).any(axis=1)) + 1
        us, vs = [], []
        for part in np.split(pdf["fp"].to_numpy(np.int64).view(np.uint64), cuts):
            if len(part) > 1:
                u, v = forest(part, threshold)
                us.append(u)
                vs.append(v)
        if us and len(u := np.concatenate(us)):
            v = np.concatenate(vs)
            yield pd.DataFrame({"u": np.maximum(u.view(np.int64), v.view(np.int64)), "v": np.minimum(u.view(np.int64), v.view(np.int64))}).drop_duplicates()

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in it:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf[group] == pdf[group].iloc[-1]).all(axis=1).to_numpy()
            at = len(pdf) - int(np.argmin(last[::-1])) if not last.all() else 0
            held = pdf.iloc[at:]
            if at:
                yield from of(pdf.iloc[:at])
        if held is not None:
            yield from of(held)

    return batches


def links(fps: DataFrame, threshold: int = THRESHOLD, half: int | None = None) -> DataFrame:
    """Edges (u, v), u > v, between distinct fingerprints; they have the components of all pairs within `threshold` bits, or, if `half` is given, of those
    that differ in at most `half` bits in one half as well (and of others within `threshold` that share an anchor)."""
    half_threshold = threshold // 2 if half is None else half
    reach = 1 + (half_threshold + 1) // 2
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    halves = F.array(*[F.struct(F.lit(i).alias("half"), h.alias("bits")) for i, h in enumerate((low, F.shiftrightunsigned("fp", 32)))])
    copies = (
        fps.select("fp", F.explode(halves).alias("h"))
        .select("fp", F.explode(anchors(F.col("h.bits"), reach)).alias("anchor"), F.col("h.half").alias("half"))
        .select((F.col("anchor") * 2 + F.col("half")).alias("anchor"), "fp")
    )
    # large anchors are found by counts, which combine before the shuffle, and never meet in one window
    hot = cut(copies.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > ANCHOR_ROWS))
    hot = F.broadcast(hot) if hot.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else hot
    rest = copies.join(hot, "anchor", "left_anti").withColumn("n", F.count("*").over(Window.partitionBy("anchor")))
    few = rest.where("n > 1").select("anchor", "fp").mapInPandas(_forests(threshold, ["anchor"]), "u long, v long")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    many = (
        copies.join(hot, "anchor")
        .withColumn("b", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("anchor", F.least("b", "other").alias("b1"), F.greatest("b", "other").alias("b2"), "fp")
        .repartition("anchor", "b1", "b2")
        .sortWithinPartitions("anchor", "b1", "b2")
        .mapInPandas(_forests(threshold, ["anchor", "b1", "b2"]), "u long, v long")
    )
    return few.union(many)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, root, component_id, copies): root is a group's least fingerprint, component_id the least key linked to the row, copies how many rows have its fingerprint."""
    slim = cut(fingerprints(docs, key, text, shingle))
    distinct = cut(slim.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("copies")))
    return labelled(slim, distinct, connected_components(links(distinct.select("fp"), threshold)))


def labelled(slim: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """slim(key, fp) with the groups of distinct(fp, least, copies) by roots(node, root); a fingerprint without a root is a group."""
    roots = roots.withColumnRenamed("node", "fp")
    joined = cut(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = cut(joined.groupBy("root").agg(F.min("least").alias("component_id")))  # so that both sides of the join below are plain shuffles, and a large group can be split
    labels = joined.join(least, "root").select("fp", "root", "component_id", "copies")
    return slim.join(labels, "fp")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: Callable = near_duplicates, prints: Callable = fingerprints) -> DataFrame:
    """docs with one row of each group of `groups`: that of the least (key, text digest), keys before none; of rows that are alike in both, that of the least hash.

    A key that one row has decides by itself, so those rows stay where they are while the keys to drop are looked up. Rows that share a key, or have none, may be of several groups: they are told apart by their texts. A
    group stays with one of them only if its least key is theirs."""
    found = cut(groups(docs, key, text))
    keys = cut(found.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.bool_and(F.col(key) == F.col("component_id")).alias("leads")).where("n > 1 or not leads"))
    kept = drop_ids(docs.where(F.col(key).isNotNull()), keys.select(key), key)
    again = cut(keys.where("n > 1").select(key))
    several = docs.where(F.col(key).isNull()).unionByName(docs.join(again, key, "left_semi").select(*docs.columns))
    if several.isEmpty():
        return kept
    own = several.select(F.struct("*").alias("doc"), text_digest(F.col(text)).alias("digest"))
    texts = prints(own.select("digest", F.col("doc")[text].alias("text")).dropDuplicates(["digest"]), "digest", "text")
    of = cut(texts.join(cut(found.select("fp", "root", "component_id").distinct()), "fp").select("digest", "root", "component_id"))
    own = own.join(of, "digest").where(F.col("doc")[key].eqNullSafe(F.col("component_id")))
    first = own.groupBy("root").agg(F.min_by("doc", F.struct("digest", F.xxhash64(F.to_json("doc")))).alias("doc"))
    return kept.unionByName(first.select("doc.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")
