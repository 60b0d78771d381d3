"""Batches merged into leaves: few are rewritten, they split as they grow, and a batch that comes again changes nothing."""

import hashlib
import json
import random

import numpy as np
from pyspark.sql import functions as F

from boxlore.functions import merkle
from boxlore.streaming import journal as stream

SCHEMA = "id string, visible string, infrared string, depth string, bbox array<double>, width int, height int, query string"


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.concat(F.lit("001_"), F.col("id").cast("string")).alias("id"), F.lit("v").alias("visible"), F.lit("i").alias("infrared"), F.lit("d").alias("depth"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(4).alias("width"), F.lit(3).alias("height"), F.lit("").alias("query"))


def merged(spark, tmp_path, lines, sizes, name, leaf_rows, at):
    folder = tmp_path / f"journal{name}"
    folder.mkdir(exist_ok=True)
    (folder / f"{at}.jsonl").write_text("".join(f"{json.dumps(x)}\n" for x in lines))
    stream.keep_merged(stream.tail(spark, str(folder)), f"{tmp_path}/{name}", sizes, f"{tmp_path}/c{name}", leaf_rows=leaf_rows).trigger(availableNow=True).start().awaitTermination()


def test_few_leaves_are_rewritten_and_they_split(spark, tmp_path):
    sizes = spark.range(60_000).select(F.format_string("Raw/001/color/%d.png", F.col("id")).alias("visible"), F.lit(8).alias("width"), F.lit(6).alias("height"))
    stream.begin_merged(rows(spark, 20_000), f"{tmp_path}/m", 100)
    first = stream.manifest(spark, f"{tmp_path}/m").collect()
    assert sum(r.n for r in first) == 20_000 and max(r.n for r in first) <= 100 and len(first) == 512
    before = stream.fingerprint(spark, f"{tmp_path}/m")
    assert before == stream.fingerprint_of(rows(spark, 20_000), 7000)
    edit = lambda k: {"id": f"001_{k}", "bbox": [0.1, 0.2, 0.5, 0.5], "query": f"q{k}", "annotator": "a", "ts": "t"}
    merged(spark, tmp_path, [edit(k) for k in range(5)], sizes, "m", 100, 0)
    after = stream.manifest(spark, f"{tmp_path}/m").collect()
    assert stream.fingerprint(spark, f"{tmp_path}/m") == stream.fingerprint_of(stream.current(spark, f"{tmp_path}/m"), 1000) != before
    assert sum(r.n for r in after if r.v == 0) <= 5 * 100 and sum(r.n for r in after) == 20_000
    assert stream.current(spark, f"{tmp_path}/m").where("query <> ''").count() == 5
    # new ids make leaves grow beyond their bound while the stream runs
    merged(spark, tmp_path, [edit(k) for k in range(20_000, 23_000)] + [{"id": "001_7", "bbox": None, "annotator": "a:absent", "ts": "t"}], sizes, "m", 20, 1)
    last = stream.manifest(spark, f"{tmp_path}/m").collect()
    got = stream.current(spark, f"{tmp_path}/m")
    assert got.count() == sum(r.n for r in last) == 22_999 and got.select("id").distinct().count() == 22_999
    assert stream.fingerprint(spark, f"{tmp_path}/m") == stream.fingerprint_of(got.select(*reversed(got.columns)).repartition(3))
    assert len(last) > 1000 and sum(1.0 / 2 ** (len(r.leaf) - 1) for r in last) == 1.0  # the leaves cover all hashes, once
    assert got.where("depth = 'd' AND infrared = 'i'").count() == 19_999
    assert {r.id for r in got.where("query <> ''").collect()} == {f"001_{k}" for k in [*range(5), *range(20_000, 23_000)]}


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    sizes = spark.createDataFrame([("Raw/001/color/50.png", 8, 6)], "visible string, width int, height int")
    stream.begin_merged(rows(spark, 40), f"{tmp_path}/m", 10)
    lines = [{"id": "001_50", "bbox": [0.1, 0.2, 0.5, 0.5], "query": "q", "annotator": "a", "ts": "t"}]
    merged(spark, tmp_path, lines, sizes, "m", 10, 0)
    one = sorted(map(repr, stream.current(spark, f"{tmp_path}/m").collect()))
    (tmp_path / "cm" / "commits" / "0").unlink()  # the stream died after its batch and before it said so
    (tmp_path / "cm" / "commits" / ".0.crc").unlink(missing_ok=True)
    before = sorted(str(p) for p in (tmp_path / "m").rglob("*.parquet"))
    merged(spark, tmp_path, lines, sizes, "m", 10, 0)
    assert sorted(map(repr, stream.current(spark, f"{tmp_path}/m").collect())) == one and sorted(str(p) for p in (tmp_path / "m").rglob("*.parquet")) == before


def test_leaves_of_an_empty_dataset(spark, tmp_path):
    sizes = spark.createDataFrame([("Raw/001/color/1.png", 8, 6)], "visible string, width int, height int")
    stream.begin_merged(rows(spark, 0), f"{tmp_path}/m", 10)
    assert [tuple(r) for r in stream.manifest(spark, f"{tmp_path}/m").collect()] == [("r", -1, 0, None)]
    merged(spark, tmp_path, [{"id": "001_1", "bbox": [0.1, 0.2, 0.5, 0.5], "query": "q", "annotator": "a", "ts": "t"}], sizes, "m", 10, 0)
    assert stream.current(spark, f"{tmp_path}/m").count() == 1
    assert stream.fingerprint_of(rows(spark, 0)) == merkle.NOTHING != stream.fingerprint(spark, f"{tmp_path}/m") == stream.fingerprint_of(stream.current(spark, f"{tmp_path}/m"))


def test_values_follow_from_the_rows_alone():
    rng = random.Random(2)
    places = sorted(rng.randrange(1 << 64) for _ in range(60)) + [(1 << 64) - 1] * 2
    hashes = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(len(places))]
    whole = merkle.value_of(np.array(places, np.uint64), hashes, 0)
    for depth in (0, 1, 3, 6):
        leaves = {}
        for p, h in zip(places, hashes):
            leaves.setdefault(f"r{p:064b}"[: depth + 1], []).append((p, h))
        cut = [(leaf, *merkle.value_of(np.array([p for p, _ in x], np.uint64), [h for _, h in x], depth)) for leaf, x in leaves.items()]
        assert merkle.root(cut) == whole[1] and whole[0] == 62
    changed = merkle.value_of(np.array(places, np.uint64), [*hashes[:-1], hashes[0]], 0)
    assert changed != whole and merkle.root([]) == merkle.NOTHING
