"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored

ROUNDS = 60


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node that has an edge to another one, with the smallest node it can reach.

    A large star hangs the larger end of every edge below the smallest neighbour of the smaller end; a small star
    hangs all smaller neighbours of a node, and the node, below the smallest of them. The number of rounds grows with the
    logarithm of the longest path. Only nodes that have a smaller neighbour enter the look-up, and both sides
    of each join are plain shuffles, so Spark can split the many edges of a hub. Every round is written to the shared folder.
    """
    x, y = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    now = stored(edges.select(x.alias("x"), y.alias("y")).filter("x <> y").distinct(), "edges")
    mark = _mark(now)
    for _ in range(ROUNDS):
        if mark[0] == 0:
            break
        both = now.union(now.select("y", "x")).toDF("u", "v")
        lower = stored(both.groupBy("u").agg(F.min("v").alias("v")).filter("v < u"), "lower")
        large = now.join(lower, now["y"] == lower["u"], "left").select("x", F.coalesce("v", "y").alias("y"))
        least = stored(large.groupBy("x").agg(F.min("y").alias("least")), "least")
        small = large.join(least, "x").filter(F.col("y") != F.col("least")).select(F.col("y").alias("x"), F.col("least").alias("y"))
        now = stored(small.union(least).distinct(), "edges")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("x").alias("node"), F.col("y").alias("component"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("x", "y")).alias("h")).first()
    return row["n"], row["h"] or 0
