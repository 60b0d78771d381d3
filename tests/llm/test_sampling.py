from pyspark.sql import functions as F

from boxlore.llm import toxicity
from boxlore.llm.sampling import labelled_sample


def taken(spark, texts, labels, most_bytes, per_class=100):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    return labelled_sample(docs, rows, "toxic", F.lit(True), per_class, most_bytes)


def test_a_long_text_costs_no_other(spark):
    labels = [int(k % 4 == 0) for k in range(80)]
    texts = [("x" * 9000 if k % 10 == 3 else f"text {k}") for k in range(80)]
    short = {(t, y) for t, y in zip(texts, labels) if len(t) < 100}
    for most_bytes in (2000, 8000, 20_000):
        got = taken(spark, texts, labels, most_bytes)
        assert short <= set(got) and sum(len(t) for t, _ in got) <= most_bytes


def test_each_class_has_its_bytes(spark):
    # the rarer class comes later in the seeded order, where a common bound would cut it alone
    labels = [int(k % 8 == 0) for k in range(800)]
    got = taken(spark, [f"{k:04d}" * 25 for k in range(800)], labels, 10_000)
    assert sum(y for _, y in got) == sum(1 - y for _, y in got) == 50
    # what one class leaves is the other's
    got = taken(spark, [f"{k:04d}" * 25 for k in range(800)], labels, 10_000, 20) + taken(spark, ["a"] + ["b" * 60] * 12, [1] + [0] * 12, 800)
    assert sum(y for _, y in got) == 21 and sum(1 - y for _, y in got) == 32


def test_nothing_is_cut_where_all_fits(spark):
    texts, labels = [f"{k}" * (1 + k * 7 % 40) for k in range(60)], [int(k < 5) for k in range(60)]
    got = taken(spark, texts, labels, sum(map(len, texts)))
    assert sorted(got) == sorted(zip(texts, labels))


def test_a_class_of_one_long_text_is_kept(spark):
    got = taken(spark, ["x" * 5000, "a", "b"], [1, 0, 0], 1000)
    assert sorted(y for _, y in got) == [0, 0, 1]


def test_toxicity_learns_from_all_chosen_documents_of_usual_length(spark):
    n = toxicity.PER_CLASS
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.expr("repeat('some ', 500)").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert len(labelled_sample(docs, labels, "toxic", F.lit(True), n, toxicity.SAMPLE_BYTES)) == 2 * n
