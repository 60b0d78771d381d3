import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from boxlore.llm import mixture


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        level = (left - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > epochs * sizes[s]]
        if not over:
            return capped | {s: weight[s] * level for s in free}
        capped |= {s: epochs * sizes[s] for s in over}


def test_mix(spark):
    rows = [(k, " ".join(["w"] * (k % 37)), ["hot", "b", "c", None, "é", "A"][0 if k % 3 == 0 else k % 6]) for k in range(600)]
    rows += [(1000, None, "b"), (1001, "", "nothing"), (1002, "x " * 30000, "c"), (5, "again and again", "b"), (None, "p q", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    got = mixture.mix(docs, columns=("doc_id", "text", "source")).collect()
    assert sorted(got, key=repr) == sorted(mixture.mix(docs.repartition(5), columns=("doc_id", "text", "source")).collect(), key=repr)
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == len((r.text or "").split()) and 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_empty_and_wordless(spark):
    docs = spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixture.mix(docs).collect()] == [(1, 0, 0, 0.0, 0)]
    assert mixture.mix(docs.limit(0)).count() == 0


def test_more_share_than_epochs_takes_all(spark):
    docs = spark.createDataFrame([(1, "a b", "a"), (2, "c", "b")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.taken) for r in mixture.mix(docs, share=5.0).collect()) == [(1, 4), (2, 2)]


@pytest.mark.parametrize("few", [1000, 0])
def test_equal_ids_and_equal_rows(spark, monkeypatch, few):
    monkeypatch.setattr(mixture, "FEW", few)
    # most rows have no id; of those many are equal, so the boundary falls among equal rows for some share
    rows = [(None, "x y z", "a")] * 300 + [(None, "w " * (k % 9), "a") for k in range(200)] + [(7, "again", "b")] * 50 + [(k, "p q", "b") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    split = 0
    for share in (0.5, 0.9, 1.3):
        got = mixture.mix(docs, share=share, columns=("doc_id", "text", "source")).collect()
        assert sorted(got, key=repr) == sorted(mixture.mix(docs.repartition(3), share=share, columns=("doc_id", "text", "source")).collect(), key=repr)
        assert len(got) == len(rows)
        for s in "ab":
            mine = [r for r in got if r.source == s]
            assert sum(r.taken for r in mine) == int(mine[0].target + 1e-9)
            assert all(r.taken <= 2 * r["size"] for r in mine)
        split += len({r.taken for r in got if r.text == "x y z"}) > 1
    assert split


def test_order_is_that_of_the_seeded_hash(spark):
    rows = [(k, "w " * (1 + k % 5), "a") for k in range(100)]
    got = {r.doc_id: r.taken for r in mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.5).collect()}
    left, want = int(0.5 * sum(1 + k % 5 for k in range(100))), {}
    for k in sorted(range(100), key=lambda k: hashlib.md5(f"mix:{k}".encode()).hexdigest()):
        want[k] = min(left, 1 + k % 5)
        left -= want[k]
    assert got == want
