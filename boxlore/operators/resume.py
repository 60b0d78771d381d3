"""Resuming an interrupted run: saved progress is checked and united, only pending work is done again."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import valid_box


def payload_faults(saved: DataFrame, assigned: DataFrame, key: str = "key", complete: bool = False) -> DataFrame:
    """(key, fault): saved keys that were not assigned, boxes that are neither null nor valid, and if ``complete`` keys not saved."""
    x = saved.select(key, "bbox", F.lit(True).alias("saved")).join(assigned.select(key, F.lit(True).alias("assigned")), key, "full_outer")
    fault = F.when(F.col("assigned").isNull(), "unexpected").when(F.col("saved").isNull(), F.lit("missing" if complete else None).cast("string")).when(F.col("bbox").isNotNull() & valid_box(F.col("bbox")).isNull(), "invalid")
    return x.select(key, fault.alias("fault")).where("fault is not null")


def unite(sources: Sequence[DataFrame], key: str = "key", disjoint: bool = False) -> DataFrame:
    """(key, bbox, conflict): the saved predictions of all sources; a key whose values differ (a null box is a value) conflicts.
    With ``disjoint`` a key that any two sources have does."""
    every = reduce(DataFrame.unionAll, (s.select(key, F.struct("bbox").alias("v")) for s in sources))
    conflict = F.count("*") > 1 if disjoint else F.min("v") != F.max("v")
    return every.groupBy(key).agg(F.min("v")["bbox"].alias("bbox"), conflict.alias("conflict"))


def checked(united: DataFrame, key: str = "key") -> DataFrame:
    """The united predictions; a conflict raises."""
    fail = F.raise_error(F.concat(F.lit("conflicting predictions for "), F.col(key).cast("string"))).cast("array<double>")
    return united.select(key, F.when(F.col("conflict"), fail).otherwise(F.col("bbox")).alias("bbox"))


def pending(items: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Items without a saved prediction; a saved null counts as done."""
    return items.join(done.select(key), key, "left_anti")


def shard_gaps(assigned: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """(shard, assigned, done) of shards that have not done all that they were assigned."""
    x = assigned.select(key, "shard").join(done.select(key, F.lit(1).alias("d")), key, "left")
    return x.groupBy("shard").agg(F.count("*").alias("assigned"), F.count("d").alias("done")).where("done < assigned")
