r"""Near copies for training sets: texts whose distinct 5-word shingles have a Jaccard similarity of SIMILAR or more.

Texts: A-Z lower-cased, words [^\x20\x09-\x0D]+; a shorter text is one shingle. A text's print is XXH64 of its words, so texts of the same words are
one node. Words and shingles count as their 64-bit hashes.

First come the links of op1's method: a SimHash of the distinct shingles, WORDS fingerprints of 64 bits, each copied to the anchor points of a covering code
(op1_simhash.links). Texts that meet at an anchor, with at most HALF bits apart in a half, and in BITS of a fingerprint or fewer are candidates, and so are those of equal fingerprints, each with one
text of its fingerprint. Links are the candidates whose shingle sets, which are compared whole, are similar.

At a similarity of 0.8 one bit in seven differs, more than anchors reach for every pair, so there is an exact check after them, for texts that are still in different
groups: those that agree in all MinHashes of a band; at a similarity of 0.8 a pair meets in one of 20 bands of 6 with probability
1 - (1 - 0.8^6)^20 = 0.998, above that more often. They are compared whole too.

A band's bucket of at most ALL texts is compared in all pairs. A larger one is compared with one of its texts and, where that
doesn't link them all, with its most typical one (that of the fewest rare shingles): a text of which under a ninth is its own is similar to one that
has nothing of its own, so a group of near copies costs two comparisons a text. The texts of buckets that are still apart are met by a prefix-filtered join: shingles in
order of rarity, the smaller text's first ninth against the larger one's first fifth, with bounds on sizes and places. That finds every similar pair
among them, whatever their buckets, so none is left out that could change a component.

Defined results: null and wordless texts are copies of each other; equal rows and repeated ids keep one output row each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import BROADCAST_IDS, bounded_batches, cut, utf8
from topicloom.llm.components import connected_components
from topicloom.llm.op1_simhash import labelled, links

SHINGLE, SIMILAR, SEED = 5, 0.8, 42
#: Fingerprints of a text, the bits of one of them in which candidates may differ, and those in one of its halves that anchors reach for sure.
WORDS, BITS, HALF = 2, 12, 2
BANDS, BAND = 20, 6
ALL = 16
#: Shingles whose MinHashes are computed at once.
CHUNK = 1 << 11
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 2**63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(0, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_TURNS = _RNG.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: list[bytes]) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; none for no words."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    h, k = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), min(SHINGLE, len(words))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mix(out + h[i : i + n] * _PLACES[i])
    return np.unique(out)


def buckets(own: np.ndarray) -> np.ndarray:
    """A text's bucket in each band."""
    if not len(own):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    for at in range(0, len(own), CHUNK):
        least = np.minimum(least, (own[at : at + CHUNK, None] * _FACTORS).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(BAND):
        out = _mix(out + least.reshape(BANDS, BAND)[:, i] * _FACTORS[i])
    return out


def fingerprints(own: np.ndarray) -> np.ndarray:
    """A text's SimHash: a bit is 1 if set in over half the shingles' hashes, which each of the WORDS takes anew."""
    if not len(own):
        return np.zeros(0, np.uint64)
    votes = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(own), CHUNK):
        for word in range(WORDS):
            h = _mix(own[at : at + CHUNK] * _TURNS[word]).astype("<u8")
            votes[word] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(own), axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    met = len(np.intersect1d(a, b, assume_unique=True))
    return met >= SIMILAR * (len(a) + len(b) - met)


def print_of(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def prints(docs: DataFrame, key: str = "doc_id", text: str = "text", with_buckets: bool = False) -> DataFrame:
    """(key, fp): the print as a signed long; with_buckets adds `raw`, a hash of the text as it is, `sims`, its fingerprints, and `buckets`."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            words = list(map(_words, b.column(1).to_pylist()))
            columns = [b.column(0), pa.array(np.array(list(map(print_of, words)), np.uint64).view(np.int64))]
            if with_buckets:
                own = list(map(shingles, words))
                columns += [b.column(2), *[pa.array([f(x).view(np.int64) for x in own], pa.list_(pa.int64())) for f in (fingerprints, buckets)]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "fp", "raw", "sims", "buckets"] if with_buckets else [key, "fp"]
    bounded_batches(docs.sparkSession)
    body = F.col(text).cast("string")
    slim = docs.select(F.col(key), body.alias("_text"), F.xxhash64(utf8(body)).alias("_raw"))
    return slim.mapInArrow(batches, f"{key} {dict(docs.dtypes)[key]}, fp long" + (", raw long, sims array<long>, buckets array<long>" if with_buckets else ""))


def _sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(fp, own): the shingles of each text whose raw hash is in wanted(raw)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            words = list(map(_words, b.column(0).to_pylist()))
            fps = np.array(list(map(print_of, words)), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array([shingles(w).tobytes() for w in words], pa.binary())], names=["fp", "own"])

    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    body = F.col(text).cast("string")
    texts = docs.select(body.alias("text"), F.xxhash64(utf8(body)).alias("raw")).join(F.broadcast(wanted) if few else wanted, "raw", "left_semi")
    return texts.dropDuplicates(["raw"]).select("text").mapInArrow(batches, "fp long, own binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    bounded_batches(pairs.sparkSession)
    both = pairs.distinct().join(sets.select(F.col("fp").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("own").alias("b")), "v")
    return cut(both.select("u", "v", "a", "b").mapInArrow(batches, "u long, v long"))


def _joined(roots: DataFrame, fresh: DataFrame) -> DataFrame:
    """roots(node, root) after more links (u, v): only the old roots that these join are linked anew."""
    if fresh.isEmpty():
        return roots
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    ends = fresh.join(named("u"), "u", "left").join(named("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    top = cut(connected_components(ends))
    known = roots.union(top.select("node", F.col("node").alias("root"))).distinct()
    return cut(known.join(top.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")))


def _leads(fps: DataFrame, sets: DataFrame) -> DataFrame:
    """(fp, size, typical, lead) of fps(fp): lead holds the rarest fifth (and one) of a text's shingles as (df, shingle), rarest first; df counts the texts of fps.
    typical is the sum of log2(df) over all its shingles."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            sizes = [len(x) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(np.concatenate(own))], names=["fp", "shingle"])

    each = sets.join(fps, "fp", "left_semi").select("fp", "own").mapInArrow(batches, "fp long, shingle long")
    often = cut(each.groupBy("shingle").agg(F.count("*").alias("df")))  # so that both sides of the join are plain, and a shingle of many texts can be split
    met = each.join(often, "shingle")
    of = met.groupBy("fp").agg(F.count("*").alias("size"), F.sum(F.log2("df")).alias("typical"), F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("lead"))
    return cut(of.withColumn("lead", F.slice("lead", F.lit(1), _first(F.col("size"), SIMILAR))))


def _first(size: Column, share: float) -> Column:
    """How many of a text's shingles can't all be missing from another that has `share` of them."""
    return (size - F.ceil(size * share - 1e-9) + 1).cast("int")


def _prefix_pairs(texts: DataFrame, leads: DataFrame) -> DataFrame:
    """The pairs (u, v) of texts(fp, root) with unlike roots that may be similar: |a & b| is at least SIMILAR / (1 + SIMILAR) * (|a| + |b|), so it is at least
    2 * SIMILAR / (1 + SIMILAR) of the smaller and SIMILAR of the larger, and the first shingle they share, in order of rarity, has no fewer after it."""
    each = leads.join(texts, "fp").select("fp", "root", "size", F.posexplode("lead").alias("at", "t")).where("t.df > 1").select("fp", "root", "size", "at", F.col("t.shingle").alias("shingle"))
    share = SIMILAR / (1 + SIMILAR)
    less = each.where(F.col("at") < _first(F.col("size"), 2 * share))
    more = each.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("fp", "root", "size", "at")])
    smaller = (F.col("size") < F.col("size2")) | ((F.col("size") == F.col("size2")) & (F.col("fp") < F.col("fp2")))
    enough = F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2")) >= share * (F.col("size") + F.col("size2")) - 1e-9
    fit = smaller & (F.col("root") != F.col("root2")) & (F.col("size") >= F.col("size2") * SIMILAR - 1e-9) & enough
    same = less["shingle"] == more["shingle"]
    return less.join(more, same & fit).select(F.col("fp").alias("u"), F.col("fp2").alias("v"))


def _apart(large: DataFrame, roots: DataFrame) -> DataFrame:
    """large(bucket, fp) with each text's root and n, the texts of its bucket; buckets of one root are left out."""
    state = cut(large.select("bucket", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    apart = state.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return cut(state.join(cut(apart.select("bucket", "n")), "bucket"))  # no aggregate in the join, so that a large bucket can be split


def _typical_pairs(state: DataFrame, leads: DataFrame) -> DataFrame:
    """The pairs (u, v) of each bucket's texts and its most typical one v, if their roots differ. A shingle speaks for a text if the texts that have it are more than the root of the bucket's size, else against it."""
    score = F.struct(F.col("typical") - F.col("size") * F.log2("n") / 2, "fp")
    most = state.join(leads.select("fp", "size", "typical"), "fp").groupBy("bucket").agg(F.max_by(F.struct("fp", "root"), score).alias("c"))
    return state.join(cut(most), "bucket").where("root <> c.root").select(F.col("fp").alias("u"), F.col("c.fp").alias("v"))


def anchored(sims: DataFrame) -> DataFrame:
    """The pairs (u, v) of sims(fp, sims) that share a fingerprint, or whose fingerprints op1's anchors link; each fingerprint stands for itself by its least text."""
    pairs = []
    for word in range(WORDS):
        own = cut(sims.select("fp", F.get("sims", F.lit(word)).alias("sim")).where("sim is not null"))
        heads = cut(own.groupBy("sim").agg(F.min("fp").alias("head")))  # so that both sides of the join are plain, and a fingerprint of many texts can be split
        found = cut(links(heads.select(F.col("sim").alias("fp")), BITS, HALF).distinct())
        ends = found.join(heads.select(F.col("sim").alias("u"), F.col("head").alias("a")), "u").join(heads.select(F.col("sim").alias("v"), F.col("head").alias("b")), "v")
        pairs += [own.join(heads, "sim").where("fp <> head").select(F.col("fp").alias("u"), F.col("head").alias("v")), ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))]
    return cut(reduce(DataFrame.union, pairs).distinct())


def groups(members: DataFrame, sets: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(node, root) of the components of roots(node, root), if given, and all similar pairs that share a bucket of members(bucket, fp, n, centre); nodes without a link are left out."""
    if roots is None:
        roots = members.sparkSession.createDataFrame([], "node long, root long")
    rooted = members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    small, large = cut(rooted.where(F.col("n") <= ALL)), members.where(F.col("n") > ALL)
    ends = [small.select("bucket", F.col("fp").alias(c), F.col("root").alias(f"{c}_root")) for c in "uv"]
    pairs = ends[0].join(ends[1], "bucket").where("u > v and u_root <> v_root").select("u", "v")
    first = large.select("fp", "centre", "bucket").join(roots.withColumnRenamed("node", "fp"), "fp", "left").join(roots.select(F.col("node").alias("centre"), F.col("root").alias("to")), "centre", "left")
    pairs = pairs.union(first.where("fp <> centre and coalesce(root, fp) <> coalesce(to, centre)").select("fp", "centre"))
    roots = _joined(roots, _verified(pairs, sets))
    state = _apart(large, roots)
    if state.isEmpty():
        return roots
    leads = _leads(state.select("fp").distinct(), sets)
    roots = _joined(roots, _verified(_typical_pairs(state, leads), sets))
    return _joined(roots, _verified(_prefix_pairs(_apart(state, roots).select("fp", "root").distinct(), leads), sets))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, root, component_id, copies) as op1_simhash.near_duplicates has them, of similar texts: those that op1's anchors link, then those that buckets still tell apart."""
    found = cut(prints(docs, key, text, with_buckets=True))
    distinct = cut(found.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("copies"), F.min(F.struct("raw", "sims", "buckets")).alias("x")))
    linked = anchored(distinct.select("fp", "x.sims"))
    members = cut(distinct.select("fp", F.explode("x.buckets").alias("bucket")))
    shared = cut(members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("centre")).where("n > 1"))
    members = cut(members.join(shared, "bucket"))
    compared = cut(members.select("fp").union(linked.select("u")).union(linked.select("v")).distinct())
    sets = cut(_sets(docs, text, cut(distinct.join(compared, "fp", "left_semi").select("x.raw").distinct())))
    roots = cut(connected_components(_verified(linked, sets)))
    return labelled(found.select(key, "fp"), distinct.select("fp", "least", "copies"), groups(members, sets, roots))
