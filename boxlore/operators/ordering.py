"""Places in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.scratch import scratch

#: Bits of a row's place that count the rows of its range; those above are the range's number.
_BITS = 33


def numbered(rows: DataFrame, key: Column, name: str, ranges: int | None = None) -> DataFrame:
    """The rows with ``name``: 1, 2, ... in order of the key, nulls first; rows of equal keys in any order.

    Spark cuts the order into ranges, as many as a shuffle has partitions (or ``ranges``), from a sample of its own; a row's turn
    breaks ties, so a key that most rows share is cut as well. Each range is sorted and written with its rows' places, so the
    numbers stay what they are however often they are read; what is left is to add the counts of the ranges before.
    """
    spark = rows.sparkSession
    turned = rows.withColumns({"__key": key, "__turn": F.monotonically_increasing_id()})
    order = [F.col("__key").asc_nulls_first(), F.col("__turn")]
    ranged = turned.repartitionByRange(ranges, *order) if ranges else turned.repartitionByRange(*order)
    path = scratch(spark, "numbered")
    ranged.sortWithinPartitions(*order).drop("__key", "__turn").withColumn("__place", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.schema(StructType([*rows.schema.fields, StructField("__place", LongType())])).parquet(path)
    part = F.shiftright("__place", _BITS)
    total, before = 0, []
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row for each range
        before.append((r[0], total))
        total += r[1]
    offsets = F.broadcast(spark.createDataFrame(before, "__part bigint, __before bigint"))
    number = F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1
    return placed.join(offsets, part == F.col("__part")).withColumn(name, number).drop("__place", "__part", "__before")
