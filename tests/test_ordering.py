import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from boxlore.functions import text
from boxlore.operators import ordering, session, sharding


def test_positions_over_uneven_partitions(spark):
    n = 300_000
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    try:
        # most ids begin alike, and their columns differ in width by range, so ranges coalesce unevenly
        ids = F.concat(F.when(F.col("id") % 10 < 8, "007_").otherwise(F.lpad((F.col("id") % 97).cast("string"), 3, "0")), F.lpad(((F.col("id") * 7919) % n).cast("string"), 8, "0"))
        rows = spark.range(n).select(ids.alias("id"), F.repeat(F.lit("x"), (F.col("id") % 300).cast("int")).alias("wide")).repartition(23)
        got = session.positions(rows).select("id", "number")
        want = rows.select("id", F.row_number().over(Window.orderBy("id")).alias("number"))
        assert got.count() == n and got.exceptAll(want).count() == 0
        assert got.agg(F.count_distinct("number"), F.min("number"), F.max("number")).first() == (n, 1, n)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_numbers_of_few_null_and_equal_keys(spark):
    rng = random.Random(1)
    for keys in ([], [5], [None, 3, 3, 1], [rng.randrange(40) for _ in range(500)] + [None] * 3):
        rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int").repartition(3)
        got = sorted((r.n, r.k) for r in ordering.numbered(rows, F.col("k"), "n", 8).collect())
        assert [n for n, _ in got] == list(range(1, len(keys) + 1))
        assert [k for _, k in got] == sorted(keys, key=lambda k: (k is not None, k))


def test_a_key_of_most_rows_is_cut_too(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 10 < 8, F.lit("same")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("i"))
    got = ordering.numbered(rows, F.col("k"), "n", 16)
    assert got.agg(F.count_distinct("n"), F.min("n"), F.max("n"), F.count_distinct("i")).first() == (60_000, 1, 60_000, 60_000)
    wrong = got.alias("a").join(got.alias("b"), F.expr("b.n = a.n + 1 AND b.k < a.k"))
    assert wrong.count() == 0 and got.columns == ["k", "i", "n"]
    assert got.select("i", "n").exceptAll(got.select("i", "n")).count() == 0


def test_cleaning_is_linear(spark):
    n = 400_000
    texts = ["a" + " " * n + "b", "a" + "." * n + "b", "`" * n + "x" + "'" * n + "y", " " * n, "a" + '"' * n]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    began = time.time()
    got = [r[0] for r in df.select(text.clean_query(F.col("t"))).collect()]
    assert time.time() - began < 20
    assert got[:2] == texts[:2] and got[2] == "x" + "'" * n + "y" and got[3:] == ["", "a"]


def test_groups_by_rank_are_the_sequential_rules(spark):
    import heapq

    from boxlore.operators import sharding, splits

    rng = random.Random(6)
    sizes = [(f"s{k:04d}é"[: 4 + k % 3] + str(k), rng.choice([1, 1, 2, 2, 2, 5, 300])) for k in range(200)]
    df = spark.createDataFrame([(s, k) for s, n in sizes for k in range(n)] + [(None, 0)] * 7, "scene string, k int").repartition(5)
    load, want = [(0, k) for k in range(6)], {}
    for scene, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        had, shard = heapq.heappop(load)
        want[scene] = shard
        heapq.heappush(load, (had + size, shard))
    got = sharding.shard_scenes(df, 6)
    assert got.columns == ["scene", "k", "shard"] and got.count() == sum(n for _, n in sizes)
    assert {r.scene: r.shard for r in got.select("scene", "shard").distinct().collect()} == want
    ids = sorted(s for s, _ in sizes)
    random.Random(9).shuffle(ids)
    assert {r.scene: r.split for r in splits.split_groups(df, "scene", 0.7, 9).select("scene", "split").distinct().collect()} == {s: "train" if k < 140 else "val" for k, s in enumerate(ids)}
    assert {r.scene for r in splits.sample_groups(df, "scene", 31, 9).select("scene").distinct().collect()} == set(ids[:31])
    assert list(splits.permutation(1000, 3)) == (lambda x: (random.Random(3).shuffle(x), x)[1])(list(range(1000)))


def test_named_scenes_as_a_table(spark):
    rows = spark.createDataFrame([(n, f"s{n % 4}" if n else None) for n in range(13)], "key int, scene string")
    named = lambda *names: spark.createDataFrame([(x,) for x in names], "scene string")
    got = sharding.shard_scenes(rows, 2, only=named("s3", "s1", "s3"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sharding.shard_scenes(rows, 2, only=["s1", "s3"]).collect()))
    assert {r.scene: r.shard for r in got.collect()} == {"s1": 0, "s3": 1}
    with pytest.raises(ValueError, match="unknown scenes: \\['s9'\\]"):
        sharding.shard_scenes(rows, 2, only=named("s1", "s9"))
