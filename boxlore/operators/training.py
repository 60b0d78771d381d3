"""Training data and its bookkeeping: mirror augmentation, effective counts, best epochs, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import mirror_box, valid_box
from ..functions.schedule import is_step, window_size
from ..functions.text import mirror_query


def trainable(data: DataFrame) -> DataFrame:
    """Rows with a query and a box."""
    return data.where((F.col("query") != "") & (F.size("bbox") > 0))


def require_valid_boxes(data: DataFrame, key: str = "key") -> DataFrame:
    """The rows; a box that is not valid raises."""
    fail = F.raise_error(F.concat(F.lit("invalid box of "), F.col(key).cast("string"))).cast("array<double>")
    return data.withColumn("bbox", F.coalesce(valid_box(F.col("bbox")), fail))


def augment(data: DataFrame, key: str = "key", mirrored: bool = True) -> DataFrame:
    """(key, is_flipped, query, bbox): each trainable row, and its mirror image where the text allows and changes."""
    x = trainable(data).select(key, "query", "bbox", mirror_query(F.col("query")).alias("m"))
    row = lambda flag, q, b: F.struct(F.lit(flag).alias("is_flipped"), q.alias("query"), b.alias("bbox"))
    own, other = row(False, F.col("query"), F.col("bbox")), row(True, F.col("m.query"), mirror_box(F.col("bbox")))
    rows = F.when(F.col("m.changed"), F.array(own, other)).otherwise(F.array(own)) if mirrored else F.array(own)
    return x.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def effective_count(data: DataFrame, mirrored: bool = True) -> DataFrame:
    """One row: how many samples an epoch has."""
    more = mirror_query(F.col("query"))["changed"].cast("int") if mirrored else F.lit(0)
    return trainable(data).agg(F.coalesce(F.sum(1 + more), F.lit(0)).alias("n"))


def losses(batches: DataFrame) -> DataFrame:
    """(epoch, mean_loss) over (epoch, loss, n), weighted by samples."""
    weighted = F.sum(F.col("loss").cast("decimal(20,9)") * F.col("n")).cast("double")
    return batches.groupBy("epoch").agg((weighted / F.greatest(F.lit(1), F.sum("n"))).alias("mean_loss"))


def best_epoch(epochs: DataFrame, metric: str = "acc", run: str = "run") -> DataFrame:
    """Each run's best epoch: the best metric (least if it is a loss, else greatest), then the least val_loss, then the earliest."""
    direction = 1 if metric == "val_loss" else -1
    return epochs.withColumn("__order", F.struct(F.col(metric) * direction, F.col("val_loss"), F.col("epoch"))).groupBy(run).agg(F.min_by("epoch", "__order").alias("epoch"), F.min_by(metric, "__order").alias("best"))


def running_best(epochs: DataFrame, metric: str = "acc", run: str = "run") -> DataFrame:
    """The epochs with ``best_so_far`` and ``improved``, in order within a run."""
    before = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    direction = 1 if metric == "val_loss" else -1
    order = F.struct((F.col(metric) * direction).alias("m"), F.col("val_loss").alias("v"))
    earlier = F.min(order).over(before)
    improved = earlier.isNull() | (order < earlier)
    return epochs.withColumn("improved", improved).withColumn("best_so_far", F.min(order).over(before.rowsBetween(Window.unboundedPreceding, 0))["m"] * direction)


def accumulation_plan(spark, batches: int, accumulate: int, skip: int = 0) -> DataFrame:
    """(batch, window, steps): each batch left of an epoch, the size of its window and whether the optimizer steps after it."""
    i = F.col("id")
    n = F.lit(batches).cast("long")
    return spark.range(batches).select(i.alias("batch"), window_size(i, n, accumulate).alias("window"), is_step(i, n, accumulate).alias("steps")).where(i >= skip)


def to_prune(checkpoints: DataFrame, prefix: str, keep: int) -> DataFrame:
    """Names to delete: those of the prefix beyond the newest ``keep`` by number; names without a number are the oldest. 0 keeps
    none."""
    if keep < 0:
        raise ValueError("keep must not be negative")
    rest = F.substr("name", F.lit(len(prefix) + 1))
    step = F.when(rest.rlike(r"\A\d+\z"), rest.try_cast("long")).otherwise(F.lit(-1))
    mine = checkpoints.where(F.startswith("name", F.lit(prefix))).select("name", step.alias("step"))
    kept = mine.orderBy(F.col("step").desc(), F.col("name").desc()).limit(keep)
    return mine.join(F.broadcast(kept.select("name")), "name", "left_anti").select("name")  # the kept are few by definition


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """One row: the complete, readable checkpoint of the greatest (global_step, path)."""
    return checkpoints.where("complete and global_step is not null").agg(F.max(F.struct("global_step", "path")).alias("c")).select("c.*")


def image_bytes(data: DataFrame, available: int) -> DataFrame:
    """One row: bytes of all pictures decoded, and whether they fit the cache."""
    total = F.coalesce(F.sum(F.col("width").cast("long") * F.col("height") * 3), F.lit(0))
    return data.agg(total.alias("bytes")).withColumn("fits", F.col("bytes") <= min(24 << 30, int(available * 0.4)))


def metric_fault(hits: Column, total: Column, acc: Column, mean_iou: Column, failures: Column) -> Column:
    """Which rule an epoch's metrics break; null if none."""
    share = lambda c: c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)
    return (
        F.when(~F.coalesce((total > 0) & (hits >= 0) & (hits <= total), F.lit(False)), "hits")
        .when(~F.coalesce((failures >= 0) & (failures <= total), F.lit(False)), "failures")
        .when(~share(acc), "acc")
        .when(~share(mean_iou), "mean_iou")
        .when(F.abs(acc - hits / total) > 1e-9, "acc is not hits / total")
    )
