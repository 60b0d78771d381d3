import hashlib

from boxlore.operators import sharding


def test_order_is_the_plain_seeded_order(spark):
    rows = spark.range(500).withColumnRenamed("id", "key").repartition(7)
    for epoch in (0, 3):
        got = [r.key for r in sharding.epoch_order(rows, 42, epoch).orderBy("place").collect()]
        assert got == sorted(range(500), key=lambda k: (hashlib.md5(f"{42 + epoch}:{k}".encode()).hexdigest(), str(k))) != list(range(500))
