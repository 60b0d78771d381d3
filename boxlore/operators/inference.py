"""Batched inference: an adapter predicts boxes for pictures and queries, as a map over partitions.

An adapter is loaded once per Python worker, gets Arrow batches, and keeps their order. The stand-in needs no model and
stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import stand_in_box, valid_box
from ..sinks import commit
from ..sources.scratch import scratch
from .ordering import numbered
from .resume import checked, pending, shard_gaps, unite
from .sharding import by_locality, by_picture, shard_pending

#: Rows of an Arrow batch go to the adapter in batches of its own size.
PREDICTION = "key string, bbox array<double>"
#: Decoded pictures that a worker keeps.
PICTURES = 32


class Adapter(Protocol):
    """What a model offers: ``load`` once, then ``predict`` boxes (or None) for rows in their order."""

    def load(self) -> None: ...

    def predict(self, rows: list[dict]) -> list[list[float] | None]: ...


_REGISTRY: dict[str, Callable[[], Adapter]] = {}


def register(name: str, make: Callable[[], Adapter]) -> None:
    _REGISTRY[name] = make


@contextmanager
def registered(name: str, make: Callable[[], Adapter]) -> Iterator[str]:
    """An adapter's name, which is known within the block only."""
    register(name, make)
    try:
        yield name
    finally:
        _REGISTRY.pop(name, None)


def adapter(name: str) -> Callable[[], Adapter]:
    if name not in _REGISTRY:
        raise ValueError(f"unknown adapter {name!r}; there are {available()}")
    return _REGISTRY[name]


def available() -> list[str]:
    return sorted(["stand-in", *_REGISTRY])


def stand_in(items: DataFrame) -> DataFrame:
    """(key, bbox) from the queries' hashes: the whole path without a model."""
    return items.select("key", stand_in_box(F.col("query")).alias("bbox"))


def predict(items: DataFrame, name: str, batch: int = 2, columns: tuple[str, ...] = ("key", "visible", "query"), decode: Callable[[str], object] | None = None) -> DataFrame:
    """(key, bbox) of every item. ``decode`` turns a path into a picture; rows are then dealt out by picture, and the last PICTURES
    decoded are kept, so that each is read once. An answer that is no valid box is null."""
    if name == "stand-in":
        return stand_in(items)
    make = adapter(name)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        picture = lru_cache(PICTURES)(decode) if decode is not None else None
        for frame in frames:
            if not len(frame):
                continue
            if model is None:  # nothing is loaded where no work is
                model = make()
                model.load()
            rows = frame.to_dict("records")
            boxes: list = []
            for a in range(0, len(rows), batch):
                part = rows[a : a + batch]
                for row in part:
                    if picture is not None:
                        row["image"] = picture(row["visible"])
                answers = model.predict(part)
                if len(answers) != len(part):
                    raise ValueError("an adapter must answer each row")
                boxes += answers
            yield pd.DataFrame({"key": frame["key"], "bbox": pd.Series(boxes, index=frame.index, dtype=object)})

    arranged = by_locality if decode is None else by_picture
    found = arranged(items.select(*columns)).mapInPandas(run, PREDICTION)
    return found.select("key", valid_box(F.col("bbox")).alias("bbox"))


def continue_run(items: DataFrame, saved: DataFrame, name: str, **options) -> DataFrame:
    """(key, bbox): what is saved, and predictions for the rest."""
    return saved.select("key", "bbox").unionAll(predict(pending(items, saved), name, **options))


def _saved(spark: SparkSession, folders: list[str]) -> DataFrame:
    """What the entries of some folders of predictions hold."""
    there = [f for f in folders if commit.last_entry(spark, f)]
    if not there:
        return spark.createDataFrame([], PREDICTION)
    return spark.read.schema(PREDICTION).option("recursiveFileLookup", "true").parquet(*there)


def _run(dealt: DataFrame, name: str, place: Callable[[int], str], step: int, on_commit: Callable[[int], None] | None, **options) -> None:
    """Answer rows (with ``shard`` and ``turn``, 0, 1, ... within it) in rounds of ``step`` of each shard, and save each shard's as an
    entry of its folder.

    The rows are written once, by round, so a round reads its own alone and the run costs in proportion to them; a round is one
    job over all shards. An entry is published by one rename, so a step is saved as a whole or not at all.
    """
    spark = dealt.sparkSession
    work = scratch(spark, "rounds")
    dealt.withColumn("round", F.floor(F.col("turn") / step).cast("long")).write.partitionBy("round").parquet(work)
    columns = [c for c in dealt.columns if c not in ("shard", "turn")]
    rounds = sorted(r.round for r in spark.read.parquet(work).select("round").distinct().collect())  # a number for each round
    done = 0
    for k in rounds:
        todo = spark.read.schema(dealt.schema).parquet(f"{work}/round={k}")
        shards = sorted(r.shard for r in todo.select("shard").distinct().collect())
        found = predict(todo.select(*columns), name, **options).join(todo.select("key", "shard"), "key")
        aside = scratch(spark, "round")
        _save(found, aside)
        for shard in shards:
            commit.add_entry(spark, place(shard), _moved(spark, f"{aside}/shard={shard}", place(shard)))
            done += 1
            if on_commit is not None:
                on_commit(done)
        commit.discard(spark, aside)
    commit.discard(spark, work)


def _save(found: DataFrame, folder: str) -> None:
    """A round's answers, a folder for each shard."""
    found.write.partitionBy("shard").parquet(folder)


def _moved(spark: SparkSession, aside: str, folder: str) -> str:
    """The answers of a shard, staged in the folder that they will be an entry of, which may be on another store."""
    staged = commit.staging(folder)
    spark.read.schema(PREDICTION).parquet(aside).write.parquet(staged)
    return staged


def run_in_steps(items: DataFrame, name: str, folder: str, step: int, on_commit: Callable[[int], None] | None = None, **options) -> DataFrame:
    """The run's predictions, saved in ``folder`` every ``step`` items in order of ``pos``; a run that was stopped goes on where it is.

    A folder that holds all items is returned without loading a model.
    """
    spark, place = items.sparkSession, f"{folder}/predictions"
    todo = pending(items, _saved(spark, [place]))
    if not todo.isEmpty():
        dealt = numbered(todo, F.col("pos"), "turn").withColumn("turn", F.col("turn") - 1).withColumn("shard", F.lit(0))
        _run(dealt, name, lambda _: place, step, on_commit, **options)
    return _saved(spark, [place])


def run_in_shards(items: DataFrame, name: str, folder: str, shards: int, step: int, on_commit: Callable[[int], None] | None = None, **options) -> DataFrame:
    """The run's predictions by shards: what no shard has saved yet is dealt in turn in order of ``pos``, and each shard saves its
    own steps in ``folder/shard=k``. All shards' steps of a round are one job. A shard that has not done all that it was dealt
    raises, as does a key with two answers. A run that was stopped, with as many shards or others, goes on with what is left."""
    from ..sources.readers import shard_folders

    spark = items.sparkSession

    def saved() -> DataFrame:
        found = [_saved(spark, [p]) for p in shard_folders(spark, folder)]
        return checked(unite(found, disjoint=True)) if found else spark.createDataFrame([], PREDICTION)

    dealt = shard_pending(items, saved(), shards).select(*items.columns, "shard", "turn").persist()
    try:
        if not dealt.isEmpty():
            _run(dealt, name, lambda k: f"{folder}/shard={k}/predictions", step, on_commit, **options)
        left = shard_gaps(dealt, saved()).orderBy("shard").first()
        if left:
            raise ValueError(f"shard {left.shard} has done {left.done} of {left.assigned}")
    finally:
        dealt.unpersist()
    return saved()


def summary(predictions: DataFrame) -> DataFrame:
    """One row: predictions and valid ones."""
    return predictions.agg(F.count("*").alias("predictions"), F.count_if(valid_box(F.col("bbox")).isNotNull()).alias("valid"))


def throughput(log: DataFrame) -> DataFrame:
    """The checkpoint log (run, at seconds, done, total) with ``rate`` since the checkpoint before and ``left`` seconds to go."""
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("at")
    rate = (F.col("done") - F.lag("done").over(w)) / (F.col("at") - F.lag("at").over(w))
    return log.withColumn("rate", rate).withColumn("left", F.when(F.col("rate") > 0, (F.col("total") - F.col("done")) / F.col("rate")))
