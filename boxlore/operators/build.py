"""A split built from folders: sequences, ground truth, pictures and their hashes to a train and a val index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import strict_pixel_box
from ..functions.hashing import canonical_json, dataset_hash
from ..functions.text import file_name
from ..sources import readers
from .splits import flag_exclusions, split_groups, split_stats

#: Fixed value: how indexes are split and recorded.
PREPARATION_PROTOCOL = 2
INDEX = ("visible", "infrared", "depth", "bbox", "width", "height")


def candidates(spark: SparkSession, root: str) -> DataFrame:
    """(scene, id, visible, infrared, depth, bbox, width, height, sha) of every annotated frame that has its three pictures.

    Pictures are listed without their contents first; only colour pictures of annotated frames are read, once, for hash
    and header together. A picture without a PNG header goes.
    """
    truth = readers.groundtruth(spark, f"{root}/*/groundtruth.txt").where(r"sequence rlike '^\\d+$'")
    place = F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)\z", 1)
    files = readers.listing(spark, root).select(place.alias("path"))
    at = lambda kind: F.concat_ws("/", "sequence", F.lit(kind), "filename")
    frames = truth.select("*", at("color").alias("visible"), at("infrared").alias("infrared"), at("depth").alias("depth"))
    frames = readers.complete_samples(frames, files)
    pictures = readers.images(spark, f"{root}/*/color", "*").select(place.alias("visible"), "sha", "width", "height").where("width is not null")
    x = frames.join(pictures, "visible")
    number = lambda c: F.col(c).cast("double")
    box = strict_pixel_box(*map(number, ("x", "y", "w", "h", "width", "height")))
    raw = lambda c: F.concat(F.lit("Raw/"), F.col(c)).alias(c)
    stem = F.regexp_replace(file_name(F.col("filename")), r"(?<=[^.])\.[^.]*\z", "")
    return x.select(F.col("sequence").alias("scene"), F.concat_ws("_", "sequence", stem).alias("id"), raw("visible"), raw("infrared"), raw("depth"), box.alias("bbox"), "width", "height", "sha")


def build_index(frames: DataFrame, test_hashes: DataFrame, ratio: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(index, stats): the kept frames with their split, and one row of counts. A frame of a bad box is never counted as a leak."""
    if test_hashes.limit(1).isEmpty():
        raise ValueError("no test hashes to keep apart from")
    marked = split_groups(flag_exclusions(frames, test_hashes, F.col("bbox")), "scene", ratio, seed)
    return marked.where("excluded is null").drop("excluded", "sha"), split_stats(marked, "scene")


def index_fingerprint(index: DataFrame) -> str:
    """The hash of a split's index as it is written."""
    raw = F.to_json(F.struct(*INDEX))
    return dataset_hash(index, "id", canonical_json(raw, "spaced"), compact=False)


def manifest(index: DataFrame, stats: DataFrame) -> dict:
    row = stats.first()
    sides = ("train", "val")
    return {
        "status": "complete", "split_method": "frozen-sequence-assignment", "index_fingerprints": {s: index_fingerprint(index.where(F.col("split") == s)) for s in sides},
        "index_sample_counts": {s: row[s] for s in sides}, "preparation_protocol_version": PREPARATION_PROTOCOL,
    }
