"""Connected components of a graph given by its edges, by alternating large-star and small-star rounds.

Each round is an aggregation and an equi-join, so a vertex with very many edges is summed before the shuffle and its
join partition can be split by adaptive execution. No vertex or edge list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): each vertex that has an edge to another, with the smallest id reachable from it.

    edges: columns a, b (long). Loops and edges with a null end are ignored, repeated edges count once. An empty table
    gives an empty one. Vertices that no edge names are not returned; they are components of their own.
    """
    e = materialise(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(e)
    if before[0]:
        for _ in range(most_rounds):
            last, e = e, materialise(_small_star(_large_star(e)), "stars")
            drop(last)
            after = _state(e)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
