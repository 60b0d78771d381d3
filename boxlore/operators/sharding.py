"""Shards: scenes kept whole and balanced, or pending work dealt in turn."""

from __future__ import annotations

import heapq
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .ordering import numbered
from .splits import by_rank


def keys_by_scene(rows: DataFrame, key: str = "key", scene: str = "scene") -> DataFrame:
    """(scene, keys): a scene's keys in order. A scene is a video, so its keys are few."""
    return rows.groupBy(scene).agg(F.sort_array(F.collect_list(key)).alias("keys"))


def balance(classes: list[tuple[int, int]], shards: int) -> array:
    """Shards of scenes in order of size, the largest first: each goes to the least loaded shard (the lowest on ties). classes: the
    sizes that there are, from the largest on, and how many scenes have each."""
    if shards <= 0:
        raise ValueError("shards must be positive")
    load = [(0, k) for k in range(min(shards, sum(n for _, n in classes)))]
    out = array("i")
    for size, many in classes:
        for _ in range(many):
            had, shard = load[0]
            out.append(shard)
            heapq.heapreplace(load, (had + size, shard))
    return out


def shard_scenes(rows: DataFrame, shards: int, scene: str = "scene", only: list[str] | DataFrame | None = None) -> DataFrame:
    """The rows with a column ``shard``; scenes are never divided, and none that is null is taken. ``only`` names the scenes to take, as
    a list or, if they are many, as a DataFrame with the same column; an unknown one raises.

    The largest scenes come first, ids break ties, and each choice depends on those before. The driver sees how many scenes
    have each size, not their ids: these are ranked on the cluster, and take their shard by rank (4 bytes each).
    """
    spark = rows.sparkSession
    sizes = rows.where(F.col(scene).isNotNull()).groupBy(F.col(scene).alias("__scene")).agg(F.count("*").alias("__size"))
    if only is not None:
        if isinstance(only, DataFrame):
            named = only.select(F.col(scene).alias("__scene")).distinct()
        else:
            named = spark.createDataFrame([(x,) for x in sorted(set(only))], f"__scene {rows.schema[scene].dataType.simpleString()}")
        unknown = [r[0] for r in named.join(sizes, "__scene", "left_anti").orderBy("__scene").limit(5).collect()]
        if unknown:
            raise ValueError(f"unknown scenes: {unknown}")
        sizes = sizes.join(named, "__scene", "left_semi")
    ranked = numbered(sizes, F.struct(-F.col("__size"), "__scene"), "rank")
    classes = [(r[0], r[1]) for r in ranked.groupBy("__size").count().orderBy(F.desc("__size")).collect()]
    found = ranked.join(by_rank(spark, balance(classes, shards), "shard"), "rank").select("__scene", "shard")
    return rows.join(found, F.col(scene) == F.col("__scene")).drop("__scene")


def shard_pending(items: DataFrame, done: DataFrame, shards: int, key: str = "key", pos: str = "pos") -> DataFrame:
    """Items not done yet with a column ``shard``, dealt in turn in order of ``pos``, and their ``turn`` within it from 0."""
    pending = items.join(done.select(key), key, "left_anti")
    rank = F.col("rank") - 1
    return numbered(pending, F.col(pos), "rank").withColumns({"shard": (rank % shards).cast("int"), "turn": F.floor(rank / shards).cast("long")}).drop("rank")


def first_items(rows: DataFrame, limit: int, pos: str = "pos") -> DataFrame:
    """The first ``limit`` rows in file order; all if 0."""
    return rows.orderBy(pos).limit(limit) if limit else rows


def by_locality(rows: DataFrame, key: str = "key") -> DataFrame:
    """Each partition's rows in order of their picture, then key, so that a worker reads a picture once."""
    return rows.sortWithinPartitions(F.coalesce(F.nullif("visible", F.lit("")), key), key)


#: Rows of one picture that one task takes; a picture with more is dealt to several.
PICTURE_ROWS = 2000


def by_picture(rows: DataFrame, key: str = "key", most: int = PICTURE_ROWS) -> DataFrame:
    """The rows dealt out by picture and sorted by it, so that a picture is decoded once. One with more than ``most`` rows is found
    by its count and dealt in as many parts as it needs, each of which decodes it; no other picture is divided.

    Those with more are counted first and written, so that Spark knows how small their table is when it plans the join: it sends
    them to the rows, which are then dealt out once, by picture and part, and never by picture alone.
    """
    picture = F.coalesce(F.nullif("visible", F.lit("")), F.col(key).cast("string"))
    named = rows.withColumn("__picture", picture)
    counted = named.groupBy(F.col("__picture").alias("__heavy")).agg(F.ceil(F.count("*") / most).cast("int").alias("__parts")).where("__parts > 1")
    path = scratch(rows.sparkSession, "heavy")
    counted.write.parquet(path)
    heavy = rows.sparkSession.read.schema(counted.schema).parquet(path)
    part = F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(F.col(key)), F.col("__parts"))).otherwise(F.lit(0))
    dealt = named.join(heavy, F.col("__picture") == F.col("__heavy"), "left").withColumn("__part", part)
    return dealt.repartition("__picture", "__part").sortWithinPartitions("__picture", "__part", key).select(*rows.columns)


def epoch_order(rows: DataFrame, seed: int, epoch: int, key: str = "key") -> DataFrame:
    """The rows with ``place`` 1, 2, ...: a seeded order that changes by epoch, that of the hashes of seed + epoch and key."""
    order = F.md5(F.concat(F.lit(f"{seed + epoch}:"), F.col(key).cast("string")).cast("binary"))
    return numbered(rows, F.concat(order, F.lit(":"), F.col(key).cast("string")), "place")
