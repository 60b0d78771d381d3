"""Weighted box fusion of several prediction sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import at, overlap, round6, valid_box


def weighted_mean(members: Column, rounded=round6) -> Column:
    """The weighted mean box of structs (weight, box)."""
    weight = F.aggregate(members, F.lit(0.0), lambda s, m: s + m["weight"])

    def mean(k: int) -> Column:
        return F.aggregate(members, F.lit(0.0), lambda s, m: s + m["weight"] * at(m["box"], k)) / weight

    return F.array(*(rounded(mean(k)) for k in range(4)))


def cluster(members: Column, threshold: float) -> Column:
    """Clusters of structs (weight, place, box) that come in order of falling weight, then place.

    Each box joins the cluster of the member it overlaps most, if by more than the threshold (the first such on ties), else
    opens its own. A fold over the array: it holds one key's boxes, one per prediction set.
    """
    empty = F.lit(None).cast("array<struct<weight: double, members: array<struct<weight: double, place: int, box: array<double>>>>>")

    def add(clusters: Column, m: Column) -> Column:
        best = F.transform(clusters, lambda c: F.array_max(F.transform(c["members"], lambda o: overlap(o["box"], m["box"]))))
        top = F.array_max(best)
        chosen = F.array_position(best, top)
        joined = F.transform(clusters, lambda c, k: F.when(k + 1 == chosen, F.struct((c["weight"] + m["weight"]).alias("weight"), F.concat(c["members"], F.array(m)).alias("members"))).otherwise(c))
        return F.when(top > threshold, joined).otherwise(F.concat(clusters, F.array(F.struct(m["weight"].alias("weight"), F.array(m).alias("members")))))

    return F.aggregate(members, F.coalesce(empty, F.array().cast("array<struct<weight: double, members: array<struct<weight: double, place: int, box: array<double>>>>>")), add)


def fuse(sets: Sequence[tuple[DataFrame, float]], threshold: float = 0.55, key: str = "key", rounded=round6) -> DataFrame:
    """(key, bbox): each key of any set with the mean box of its heaviest cluster (the first on ties), or null without a valid box.

    The sets are united and grouped, one shuffle, rather than joined one by one. A key has one row per set, so its array
    is as small as the number of sets.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    rows = [df.select(key, F.col("bbox").alias("box"), F.lit(float(w)).alias("weight"), F.lit(place).alias("place")) for place, (df, w) in enumerate(sets)]
    one = reduce(DataFrame.unionAll, rows)
    usable = (F.col("weight") > 0) & valid_box(F.col("box")).isNotNull()
    member = F.struct((-F.col("weight")).alias("order"), F.col("place").alias("place"), F.col("weight").alias("weight"), F.col("box").alias("box"))
    grouped = one.groupBy(key).agg(F.array_sort(F.collect_list(F.when(usable, member))).alias("m"))
    members = F.transform("m", lambda m: F.struct(m["weight"].alias("weight"), m["place"].alias("place"), m["box"].alias("box")))
    clusters = grouped.select(key, cluster(members, threshold).alias("c"))
    heaviest = F.array_max(F.transform("c", lambda c: c["weight"]))
    winner = F.get(F.filter("c", lambda c: c["weight"] == heaviest), 0)
    return clusters.select(key, winner.alias("w")).select(key, F.when(F.col("w").isNotNull(), weighted_mean(F.col("w.members"), rounded)).alias("bbox"))
