"""The annotation journal as a stream: a state per id that replays records as they come, and a merge for each batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import merkle
from ..operators.journal import merge, parse_records
from ..sinks import commit
from .source import JournalSource

LIVE = "bbox array<double>, query string, absent boolean, annotator string, ts string"
OUTPUT = f"id string, {LIVE}"
#: ``known``: a box event or a query-only record has said whose the row is, be it nobody's.
STATE = f"{LIVE}, known boolean"
#: Rows of a leaf of a merged dataset; one that grows beyond is split.
LEAF_ROWS = 4000
MANIFEST = "leaf string, v int, n bigint, hash string"


def tail(spark: SparkSession, path: str) -> DataFrame:
    """Records of a journal file or folder of them, as lines are appended and files added; ``path`` must be mounted on every
    executor. In a folder of numbered appends ``pos`` is the order of these; of other files within a batch, that of their times."""
    spark.dataSource.register(JournalSource)
    return parse_records(spark.readStream.format(JournalSource.name()).load(path))


def _replay(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    bbox, query, absent, annotator, ts, known = state.get if state.exists else (None, None, False, None, None, False)
    rows = pd.concat(list(frames)).sort_values("pos")
    for r in rows.to_dict("records"):
        if isinstance(r["query"], str):
            query = r["query"]
        event = r["has_bbox"]
        if event is None or event is pd.NA or event != event:  # a broken box changes nothing else
            continue
        if not event:
            if not known:
                annotator, ts, known = r["annotator"], r["ts"], True
            continue
        if r["bbox"] is not None:
            bbox, absent, annotator, ts, known = [float(v) for v in r["bbox"]], False, r["annotator"], r["ts"], True
        elif isinstance(r["annotator"], str) and r["annotator"].endswith(":absent"):
            bbox, absent, annotator, ts, known = None, True, r["annotator"], r["ts"], True
        else:
            bbox, absent, annotator, ts, known = None, False, None, None, False
    state.update((bbox, query, absent, annotator, ts, known))
    yield pd.DataFrame({"id": [key[0]], "bbox": [bbox], "query": [query], "absent": [absent], "annotator": [annotator], "ts": [ts]})


def live_state(records: DataFrame) -> DataFrame:
    """(id, bbox, query, absent, annotator, ts) of each id that a batch touches, after its records. The state of an id is one row."""
    return records.groupBy("id").applyInPandasWithState(_replay, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def leaf_of(depth) -> Column:
    """The leaf of a row's id at that depth: the first bits of its hash, behind a letter."""
    bits = F.lpad(F.bin(F.expr(f"shiftrightunsigned(xxhash64(id), 64 - ({depth}))")), F.expr(f"CAST({depth} AS INT)"), F.lit("0"))
    return F.concat(F.lit("r"), F.when(F.expr(f"({depth}) > 0"), bits).otherwise(""))


def _manifests(spark: SparkSession, dataset: str) -> list[int]:
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{dataset.rstrip('/')}/manifest/{'[0-9]' * commit.DIGITS}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(s.getPath().getName()) for s in found)


def manifest(spark: SparkSession, dataset: str, number: int | None = None) -> DataFrame:
    """(leaf, v, n, hash): the leaves of a merged dataset, and the version, the number of rows and the value of each; as of the last
    batch, or of entry ``number``."""
    number = _manifests(spark, dataset)[-1] if number is None else number
    return spark.read.schema(MANIFEST).parquet(commit.entry(f"{dataset.rstrip('/')}/manifest", number))


def _publish(leaves: DataFrame, dataset: str, number: int) -> None:
    """The manifest as entry ``number``; one that is there already stays, and so does what it names."""
    spark, folder = leaves.sparkSession, f"{dataset.rstrip('/')}/manifest"
    staged = commit.staging(folder)
    leaves.coalesce(1).write.parquet(staged)
    if not commit.claim(spark, staged, commit.entry(folder, number)):
        commit.discard(spark, staged)


def _write(rows: DataFrame, dataset: str, version: int) -> str:
    """Rows with their ``leaf`` as a version of those leaves, a folder each; what a try before has left is replaced."""
    path = f"{dataset.rstrip('/')}/data/v={version}"
    rows.repartition("leaf").write.mode("overwrite").partitionBy("leaf").parquet(path)
    return path


def _read(spark: SparkSession, dataset: str, leaves: DataFrame, schema: StructType) -> DataFrame:
    """The rows of some leaves of a manifest, and of no other."""
    paths = [f"{dataset.rstrip('/')}/data/v={r.v}/leaf={r.leaf}" for r in leaves.where("n > 0").select("v", "leaf").collect()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _schema(spark: SparkSession, dataset: str) -> StructType:
    return spark.read.parquet(f"{dataset.rstrip('/')}/schema").schema


def begin_merged(rows: DataFrame, dataset: str, leaf_rows: int = LEAF_ROWS) -> None:
    """Write a dataset to merge into, in leaves of about half of ``leaf_rows`` rows at most."""
    spark = rows.sparkSession
    rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{dataset.rstrip('/')}/schema")
    depth = max(0, (2 * rows.count() // leaf_rows).bit_length())
    path = _write(rows.withColumn("leaf", leaf_of(depth)), dataset, -1)
    counts = merkle.leaf_values(spark.read.schema(StructType([*rows.schema.fields, StructField("leaf", StringType())])).parquet(path))
    every = spark.range(1 << depth).select(F.concat(F.lit("r"), F.lpad(F.bin("id"), depth, "0") if depth else F.lit("")).alias("leaf"))
    _publish(every.join(counts, "leaf", "left").select("leaf", F.lit(-1).alias("v"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "hash"), dataset, 1)


def fingerprint(spark: SparkSession, dataset: str) -> str:
    """The hash tree's root of a merged dataset, from what the manifest has of each leaf; no row is read."""
    return merkle.root([(r.leaf, r.n, r.hash) for r in manifest(spark, dataset).select("leaf", "n", "hash").collect()])


def fingerprint_of(rows: DataFrame, leaf_rows: int = LEAF_ROWS) -> str:
    """The same of any rows with an ``id``, from all of them."""
    depth = max(0, (2 * rows.count() // leaf_rows).bit_length())
    return merkle.root([tuple(r) for r in merkle.leaf_values(rows.withColumn("leaf", leaf_of(depth))).collect()])


def current(spark: SparkSession, dataset: str) -> DataFrame:
    """The dataset as the last batches have left it."""
    fields = [*_schema(spark, dataset).fields, StructField("v", IntegerType()), StructField("leaf", StringType())]
    held = spark.read.schema(StructType(fields)).parquet(f"{dataset.rstrip('/')}/data")
    return held.join(manifest(spark, dataset).select("leaf", "v"), ["leaf", "v"], "left_semi").drop("leaf", "v")


def _sweep(spark: SparkSession, dataset: str, numbers: list[int]) -> None:
    """Delete the leaves that the manifest before the last but one names and the one after it does not, and that manifest."""
    if len(numbers) > 2:
        old, kept = numbers[-3], numbers[-2]
        gone = manifest(spark, dataset, old).join(manifest(spark, dataset, kept), ["leaf", "v"], "left_anti").where("n > 0")
        for r in gone.collect():  # leaves that one batch has touched
            commit.discard(spark, f"{dataset.rstrip('/')}/data/v={r.v}/leaf={r.leaf}")
        commit.discard(spark, commit.entry(f"{dataset.rstrip('/')}/manifest", old))


def keep_merged(records: DataFrame, dataset: str, sizes: DataFrame | None, checkpoint: str, on_commit: Callable[[int], None] | None = None, leaf_rows: int = LEAF_ROWS):
    """A query that merges each batch's touched ids into a dataset that ``begin_merged`` has written.

    The dataset lies in leaves by the first bits of the ids' hashes. A batch reads the leaves that its ids fall into, and writes
    them as a version of its own; a leaf that grows beyond ``leaf_rows`` is written as two, or as many as it takes. The batch
    then counts by one rename of its manifest, which names every leaf's version; one that is run again finds it there and
    changes nothing. Versions are deleted when two manifests after them name others. Returns the writer; start it with
    ``.start()``.
    """

    def merge_batch(batch: DataFrame, number: int) -> None:
        spark, entry = batch.sparkSession, number + 2
        done = _manifests(spark, dataset)
        held = batch.persist()
        try:
            held.count()  # a state's batch counts only if all of it is read, and so also one that is done already
            if entry not in done:
                before = manifest(spark, dataset, done[-1])
                depths = [r[0] for r in before.select(F.length("leaf") - 1).distinct().collect()]  # at most 65
                ids = held.select(F.explode(F.array(*(leaf_of(d) for d in depths))).alias("leaf")).distinct()
                touched = before.join(ids, "leaf", "left_semi").persist()
                schema = _schema(spark, dataset)
                merged = merge(_read(spark, dataset, touched, schema), held, sizes)
                at = F.explode(F.array(*(leaf_of(d) for d in depths)))
                placed = merged.select("*", at.alias("__old")).join(touched.select(F.col("leaf").alias("__old")), "__old", "left_semi")
                many = F.count("*").over(Window.partitionBy("__old"))  # of a leaf
                split = F.greatest(F.lit(0), F.ceil(F.log2(many / leaf_rows))).cast("int")
                path = _write(placed.withColumn("__depth", F.length("__old") - 1 + split).withColumn("leaf", leaf_of("__depth")).drop("__old", "__depth"), dataset, number)
                counts = merkle.leaf_values(spark.read.schema(StructType([*schema.fields, StructField("leaf", StringType())])).parquet(path)).persist()
                # the leaves that take a touched one's place cover all that it covered, with rows or without
                deepest = counts.select("leaf", "n", F.explode(F.array(*(F.substring("leaf", 1, d + 1) for d in depths))).alias("old")).join(touched.select(F.col("leaf").alias("old")), "old").groupBy("old").agg(F.max(F.length("leaf")).alias("long"))
                places = touched.select(F.col("leaf").alias("old")).join(deepest, "old", "left").withColumn("more", F.coalesce(F.col("long") - F.length("old"), F.lit(0)))
                places = places.select("old", "more", F.explode(F.sequence(F.lit(0), F.expr("CAST(shiftleft(1, more) - 1 AS INT)"))).alias("k"))
                places = places.select(F.concat("old", F.when(F.col("more") > 0, F.expr("lpad(bin(k), more, '0')")).otherwise("")).alias("leaf"))
                new = places.join(counts, "leaf", "left").select("leaf", F.lit(number).alias("v"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "hash")
                _publish(before.join(touched, "leaf", "left_anti").select("leaf", "v", "n", "hash").unionByName(new), dataset, entry)
                touched.unpersist()
                counts.unpersist()
                _sweep(spark, dataset, _manifests(spark, dataset))
        finally:
            held.unpersist()
        if on_commit is not None:
            on_commit(number)

    return live_state(records).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge_batch)
