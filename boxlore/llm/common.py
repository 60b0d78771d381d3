"""Tables kept between jobs, and other helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import shared_folder


#: Spark's setting of the bytes of an Arrow batch, the value that it has if no one sets it, and the one that the operators take.
ARROW_BYTES, UNSET, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(4 << 20)


def small_batches(spark: SparkSession) -> None:
    """Let texts go to Python workers in batches of 4 MB, where the session has no size of its own: of 64 MB, Spark's default, an
    executor holds several at a time, in the JVM and in Python. A longer row still is a batch."""
    if spark.conf.get(ARROW_BYTES, None) == UNSET:
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)


def _path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) to the shared folder and read it again, which cuts its lineage.

    Every executor sees the files, so a lost executor costs nothing but its running tasks. They are deleted by ``drop``, or
    when the driver's JVM ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    jvm_path, files = _path(spark, path)
    files.deleteOnExit(jvm_path)
    spark._jvm.System.gc()  # Spark deletes the shuffle files of jobs that are done when the driver collects its garbage
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``, once nothing reads it any more; any other DataFrame is left alone."""
    if getattr(df, "kept_at", None):
        jvm_path, files = _path(df.sparkSession, df.kept_at)
        files.delete(jvm_path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
