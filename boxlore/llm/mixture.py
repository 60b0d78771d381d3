"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Digits of a place, 32 of the seeded hash of the id and 16 of the text's, that each step of the search for a source's boundary
#: looks at; the last step is taken as soon as at most FEW rows of a source are left.
STEPS, FEW = (2, 4, 6, 8, 32, 34, 36, 38, 48), 1000

def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """(source, rank, source_size, n_docs, target) from (source, source_size, n_docs), a row per source.

    Sources in code-point order, null last, take the weights in turn. A common level sets target = weight * level where
    that is at most ``epochs`` times the source's size; the others are clamped there and their excess is shared by
    weight among the rest until none is above. Sorted by size over weight, the clamped sources are a prefix, so the level
    follows from running sums over one row per source (one task sees a row per source, never a row per document).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = ranked.withColumns(
        {
            "turn": F.row_number().over(by_ratio), "total": F.sum(F.col("source_size").cast("double")).over(every),
            "clamped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "heavy": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # the level if just the sources of smaller ratio are clamped; it holds from the first source that stays under its cap
    x = x.withColumn("level", (F.col("total") * F.lit(float(share)) - F.col("clamped")) / F.col("heavy"))
    holds = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("turn", "level"))
    x = x.withColumn("level", F.min(holds).over(every)["level"])
    return x.select("source", "rank", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _reached(rows: DataFrame, key: Column) -> DataFrame:
    """(rank, key, left, n, sum): of each source the first key, in order, at which the running size goes beyond ``left``; there
    left is what remains of it, and n and sum are the key's rows and their size."""
    sums = rows.groupBy("rank", "left", key.alias("key")).agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("sum").over(Window.partitionBy("rank").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sums.withColumn("left", F.col("left") - earlier).where("left >= 0 and sum > left")
    return materialise(at.select("rank", "key", "left", "n", "sum"), "reached")


def _boundaries(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """(r, b_place, b_left, b_n): where in its seeded order each source's fraction ends.

    It is found digit by digit: sums by the first two digits of the place, by the next two among the rows behind those, and
    so on until few rows are left, whose whole places are then added up. Sums are made before any shuffle, so neither equal
    ids nor equal rows, be they a third of all, are ever in one task.
    """
    rows = sized.join(sources.select(F.col("source").alias("s"), "rank", F.col("quota").alias("left")), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.select("rank", "left", "size", "place")
    at, most = None, FEW + 1
    for digits in STEPS:
        if most <= FEW:
            digits = STEPS[-1]
        prefix = F.substring("place", 1, digits)
        at = _reached(rows, prefix)
        if digits == STEPS[-1]:
            break
        most = at.agg(F.max("n")).first()[0] or 0
        reached = at.select(F.col("rank").alias("r"), "key", F.col("left").alias("l"))
        rows = rows.join(reached, (F.col("rank") == F.col("r")) & (prefix == F.col("key"))).select("rank", F.col("l").alias("left"), "size", "place")
    return at.select(F.col("rank").alias("r"), F.col("key").alias("b_place"), F.col("left").alias("b_left"), F.col("n").alias("b_n"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: str = "mix", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` and size, source_size, target, taken: how many of its words each document gives to the mix.

    taken = whole repetitions (the floor of target / source_size) times the size, plus a fraction: in the seeded order of
    md5(seed:doc_id) within the source, documents are repeated once more until the rest of the target is used up, the
    last of them in part. So the words taken of a source are its target's floor, and no document is taken more than
    ``epochs`` times. Where in the order that is, is found from sums; each document then only compares its place with its
    source's, so no text is ever sorted or shuffled. A null or empty text has size 0 and nothing is taken; null sources
    are one source, the last; rows of one doc_id are ordered by their texts' hashes, equal rows in no order of their own;
    an empty table gives an empty one. Extra columns are dropped unless named in ``columns``.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    place = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    place = F.concat(place, F.lpad(F.hex(F.xxhash64("text")), 16, "0"))
    own = [F.col(c).alias(f"own_{c}") for c in columns]
    every = docs.select(*own, "source", size.alias("size"), place.alias("place"))
    if "text" in columns:  # the sizes are counted again when the documents are read, which is less than to write them
        sized = materialise(every.select("source", "size", "place"), "sizes")
    else:
        sized = every = materialise(every, "sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("quota", (F.floor("target") - F.col("whole") * F.col("source_size")).cast("long"))
    sources = materialise(sources, "sources")
    boundaries = _boundaries(sized, sources)
    sources = materialise(sources.join(boundaries, F.col("rank") == F.col("r"), "left").withColumnRenamed("source", "s"), "boundaries")
    x = every.join(sources, F.col("source").eqNullSafe(F.col("s")))
    here, before = F.col("place") == F.col("b_place"), F.col("b_place").isNull() | (F.col("place") < F.col("b_place"))
    out = lambda x, more: x.select(*(F.col(f"own_{c}").alias(c) for c in columns), "size", "source_size", "target", (F.col("whole") * F.col("size") + more).cast("long").alias("taken"))
    fraction = F.when(before, F.col("size")).when(here, F.col("b_left")).otherwise(0)
    if not sources.where("b_n > 1").limit(1).count():
        return out(x, fraction)
    # equal rows share the boundary: they are numbered by partition, each after the rows of the partitions before
    equal = F.coalesce(here & (F.col("b_n") > 1), F.lit(False))
    tied = materialise(x.where(equal).withColumn("row", F.monotonically_increasing_id()), "tied").withColumn("part", F.shiftright("row", 33))
    parts = tied.groupBy("rank", "part").agg(F.count("*").alias("n"))
    parts = parts.select("rank", "part", F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    number = F.col("ahead") + F.row_number().over(Window.partitionBy("rank", "part").orderBy("row")) - 1
    tied = tied.join(parts, ["rank", "part"]).withColumn("number", number)
    return out(x.where(~equal), fraction).unionByName(out(tied, F.greatest(F.lit(0), F.least("size", F.col("b_left") - F.col("number") * F.col("size")))))
