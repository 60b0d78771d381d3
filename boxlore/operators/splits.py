"""Leak-free splits: whole groups go to one side, rows whose content is in the test set go."""

from __future__ import annotations

import random
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import numbered

def permutation(n: int, seed: int) -> array:
    """0, 1, ..., n - 1 in the order of Python's generator for the seed, 4 bytes each; no generator of the cluster's gives it."""
    out = array("i", range(n))
    random.Random(seed).shuffle(out)
    return out


def by_rank(spark: SparkSession, values: array, name: str) -> DataFrame:
    """(rank, name): a value for each of the ranks 1, 2, ..., as a table that goes to the cluster in one piece of 12 bytes a rank."""
    held = pa.table({"rank": pa.array(np.arange(1, len(values) + 1)), name: pa.array(np.frombuffer(values, np.int32) if len(values) else np.zeros(0, np.int32))})
    return spark.createDataFrame(held, f"rank bigint, {name} int")


def placed_groups(rows: DataFrame, group: str, seed: int) -> tuple[DataFrame, int]:
    """((__group, place), how many): the distinct groups, and the place of each in the seeded order of the sorted ids.

    The ids stay on the cluster, where they are ranked; the driver shuffles their ranks' numbers.
    """
    ids = rows.select(F.col(group).cast("string").alias("__group")).where("__group is not null").distinct()
    ranked = numbered(ids, F.col("__group"), "rank")
    n = ranked.count()
    order = np.frombuffer(permutation(n, seed), np.int32) if n else np.zeros(0, np.int32)
    places = np.empty(n, np.int32)
    places[order] = np.arange(n, dtype=np.int32)
    return ranked.join(by_rank(rows.sparkSession, array("i", places.tobytes()), "place"), "rank").select("__group", "place"), n


def sample_groups(rows: DataFrame, group: str, limit: int | None, seed: int = 42) -> DataFrame:
    """The rows of ``limit`` groups chosen by the seed; all rows if ``limit`` is None."""
    if limit is None:
        return rows
    if limit <= 0:
        raise ValueError("the limit must be positive")
    placed, _ = placed_groups(rows, group, seed)
    return rows.join(placed.where(F.col("place") < limit), F.col(group).cast("string") == F.col("__group"), "left_semi")


def split_groups(rows: DataFrame, group: str, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """The rows with a column ``split``: the first part of the shuffled groups is train, the rest val; both get at least one."""
    placed, n = placed_groups(rows, group, seed)
    if n < 2:
        raise ValueError("a split needs two groups")
    cut = min(max(int(n * ratio), 1), n - 1)
    sides = placed.select("__group", F.when(F.col("place") < cut, "train").otherwise("val").alias("split"))
    return rows.join(sides, F.col(group).cast("string") == F.col("__group")).drop("__group")


def hashed_split(group: Column, ratio: float = 0.8, seed: int = 42) -> Column:
    """A split without a driver list, for any number of groups: by the group's seeded hash, so shares hold on average."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), group.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.when(place < ratio, "train").otherwise("val")


def drop_leaks(rows: DataFrame, test_hashes: DataFrame, hash_column: str = "sha") -> DataFrame:
    """Rows whose content hash is in the test set go."""
    return rows.join(test_hashes.select(hash_column).distinct(), hash_column, "left_anti")


def flag_exclusions(rows: DataFrame, test_hashes: DataFrame, box: Column, hash_column: str = "sha") -> DataFrame:
    """The rows with ``excluded``: ``bbox`` where the box is null, else ``hash`` where the content is in the test set, else null."""
    marked = rows.join(test_hashes.select(hash_column).distinct().withColumn("__leak", F.lit(True)), hash_column, "left")
    return marked.withColumn("excluded", F.when(box.isNull(), "bbox").when(F.col("__leak"), "hash")).drop("__leak")


def split_stats(rows: DataFrame, group: str) -> DataFrame:
    """One row over (group, split, excluded): sequences, samples, excluded_hash, excluded_invalid_bbox, train, val."""
    kept = F.col("excluded").isNull()
    return rows.agg(
        F.count_distinct(group).alias("sequences"), F.count_if(kept).alias("samples"), F.count_if(F.col("excluded") == "hash").alias("excluded_hash"),
        F.count_if(F.col("excluded") == "bbox").alias("excluded_invalid_bbox"), F.count_if(kept & (F.col("split") == "train")).alias("train"), F.count_if(kept & (F.col("split") == "val")).alias("val"),
    )


def overlaps(train: DataFrame, val: DataFrame, column: str, most: int = 5) -> DataFrame:
    """The first values, sorted, that both sides have; an empty result means that the sides are disjoint."""
    return train.select(column).intersect(val.select(column)).orderBy(column).limit(most)
