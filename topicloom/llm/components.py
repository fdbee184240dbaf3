"""Connected components of an edge table by alternating large-star and small-star rounds; a bounded number of edges needs no rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import cut

#: A node with over one part in HUBS of all edges is a hub; so there are at most HUBS of them, and they are broadcast.
HUBS, HUB_EDGES = 2000, 100
#: Distinct edges, of two numbers each, that one task joins by itself; more take rounds.
FEW = 100_000


def _relink(edges: DataFrame, rows: int) -> DataFrame:
    """Each edge (u, v) with m, the smallest neighbour of u or u itself. `rows` is at least the number of edges.

    groupBy combines before the shuffle, so that no hub's edges meet there. The join would bring them together (an aggregate on one
    side keeps Spark from splitting it), so hubs are looked up where their edges are.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).withColumn("m", F.least("m", "u"))
    hub = F.col("degree") > max(HUB_EDGES, rows / HUBS)
    marked = edges.join(F.broadcast(least.where(hub).select("u", F.col("m").alias("hub_m"))), "u", "left")
    rest = marked.where("hub_m is null").select("u", "v").join(least.where(~hub).select("u", "m"), "u")
    return marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).union(rest.select("u", "v", "m"))


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edges (u, v) to (node, root)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = above
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pd.DataFrame({"node": nodes, "root": [root(x) for x in nodes]}, dtype="int64")


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the least node reachable. No edges, no rows."""
    now = cut(edges.where("u <> v").select("u", "v").distinct())
    state = seen = (now.count(),)
    if state[0] <= FEW:
        return now.coalesce(1).mapInPandas(_in_one_task, "node long, root long")
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _relink(both, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = cut(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        small = _relink(down, 2 * state[0])
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
