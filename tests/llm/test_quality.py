import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from boxlore.llm import quality
from boxlore.llm.textops import text_of


def corpus(n=600):
    rng = random.Random(6)
    word = ["".join(rng.choices("abcdefghi", k=rng.randint(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for k in range(n):
        w = rng.choices(word, k=rng.randint(20, 120))
        bad = k % 4 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if k % 8 else [w[0]] * len(w)
        docs.append((k, " ".join(w)))
        labels.append((k, int(not bad)))
    return docs, labels


def test_ftrl_is_the_published_update():
    m = quality.FtrlProximal(3, alpha=0.5, beta=1.0, l1=0.0, l2=0.0)
    m.update(np.array([0, 2]), np.array([1.0, 2.0]), 1.0)
    # gradient (p - y) x = -0.5 x; sigma = |g| / alpha; z = g as w was 0
    assert np.allclose(m.z, [-0.5, 0, -1.0]) and np.allclose(m.n, [0.25, 0, 1.0])
    assert np.allclose(m.weights(), [0.5 * 0.5 / 1.5, 0, 0.5 * 1.0 / 2.0])


def test_score_is_the_dot_product_of_frequencies():
    rng = np.random.default_rng(1)
    w = rng.normal(size=quality.DIMENSIONS).astype(np.float32)
    texts = ["One two one two.", "", "x", "été ÉTÉ !! 12 a1"]
    got = quality.scores(w, *text_of(pa.array(texts)))
    for text, p in zip(texts, got):
        row, f, count = quality.ngrams(*text_of(pa.array([text])))
        n = len(text.split())
        assert count[0] == n and len(f) == sum(max(0, n - k + 1) for k in (1, 2, 1, 2, 3))
        want = w[0] + sum(float(w[k]) for k in f) * quality.SCALE / max(n, 1)
        assert abs(np.log(p / (1 - p)) - np.clip(want, -35, 35)) < 1e-3
    together = quality.scores(w, *text_of(pa.array(texts * 2)))
    assert np.allclose(together, np.concatenate([got, got]))


def test_held_out_accuracy_and_rows(spark):
    docs, labels = corpus()
    more = [(9000, None), (9001, ""), (9002, "w " * 60_000), (9002, "again"), (None, "Some text here")]
    d = spark.createDataFrame(docs + more, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("label", F.lit(0))
    x = spark.createDataFrame(labels + [(7777, 1), (None, 1), (3, None)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    rows = quality.quality(d, x).collect()
    assert len(rows) == len(docs) + len(more) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, quality.quality(d.repartition(7), x).collect()), key=repr)
    assert quality.quality(d.limit(0), x).count() == 0 and {r.score for r in quality.quality(d, x.limit(0)).limit(5).collect()} == {0.5}


def test_learns_only_from_the_other_folds(spark):
    docs, labels = corpus(200)
    d, x = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    held = quality.fold(F.col("doc_id"), 5) == 0
    turned = x.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality.quality(d, x).collect()) == sorted(quality.quality(d, turned).collect())


def test_fitted_weights_are_those_of_plain_updates():
    docs, labels = corpus(40)
    truth = dict(labels)
    z, n = {}, {}
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.1

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - np.sign(z[k]) * l1) / ((beta + np.sqrt(n[k])) / alpha + l2)

    for _ in range(4):
        for i, text in docs:
            _, features, count = quality.ngrams(*text_of(pa.array([text])))
            x = {0: 1.0}
            for f in features.tolist():
                x[f] = x.get(f, 0.0) + quality.SCALE / max(int(count[0]), 1)
            w = {k: weight(k) for k in x}
            p = 1 / (1 + np.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - truth[i]) * v
                sigma = (np.sqrt(n.get(k, 0.0) + g * g) - np.sqrt(n.get(k, 0.0))) / alpha
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    got = quality.fit([(t, truth[i]) for i, t in docs])
    want = np.zeros(quality.DIMENSIONS, np.float32)
    for k in z:
        want[k] = weight(k)
    assert np.allclose(got, want, atol=1e-4) and (want != 0).sum() > 100
