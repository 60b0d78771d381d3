import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxlore.llm import toxicity as tx
from boxlore.llm.textops import text_of


@pytest.fixture
def corpus():
    rng = random.Random(9)
    word = ["".join(rng.choices("abcdefghi", k=rng.randint(2, 8))) for _ in range(800)]
    docs, labels = [], []
    for k in range(700):
        w = rng.choices(word, k=rng.randint(10, 200))
        bad = k % 4 == 0
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = rng.choice(["nasty", "vile", "zork" + rng.choice(word)])
        docs.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    return docs, labels


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 200):
        t = tx.Tokens(*text_of(pa.array(["q " * 3, "w " * n, "z"])))
        row, first, size = t.windows()
        seen = set()
        for r, f, s in zip(row, first, size):
            if r == 1:
                seen |= set(range(f - 3, f - 3 + s))
        assert seen == set(range(n))


def test_gradients_are_the_slopes():
    net = tx.Network(1, np.float64)
    t = tx.Tokens(*text_of(pa.array(["alpha beta gamma delta", "epsilon zeta"])))
    row, first, n = t.windows()
    step = np.arange(5)[:, None]
    mask = step < n
    place = np.where(mask, first + step, first)
    label = np.array([1.0, 0.0])

    def loss():
        out, cache = net.forward(net.gates(net.inputs(t))[place], mask.astype(float), keep=True)
        return float((np.logaddexp(0, out) - label * out).sum()), out, cache

    _, out, cache = loss()
    g, gx = net.backward(1 / (1 + np.exp(-out)) - label, cache)
    flat = np.zeros((len(t.word), 6 * tx.HIDDEN))
    np.add.at(flat, place.ravel(), gx.reshape(-1, 6 * tx.HIDDEN))
    g["wf"], g["cb"] = net.inputs(t).T @ flat[:, : 3 * tx.HIDDEN], flat[:, 3 * tx.HIDDEN :].sum(0)
    rng = np.random.default_rng(0)
    for name, grad in g.items():
        for _ in range(4):
            at = tuple(rng.integers(0, k) for k in net.p[name].shape)
            keep, eps = net.p[name][at], 1e-5
            net.p[name][at] = keep + eps
            up = loss()[0]
            net.p[name][at] = keep - eps
            down = loss()[0]
            net.p[name][at] = keep
            assert abs((up - down) / (2 * eps) - grad[at]) < 1e-6, name


def test_held_out_accuracy_and_rows(spark, corpus):
    docs, labels = corpus
    more = [(9000, None), (9001, " ?! "), (9002, "abc " * 40_000 + "vile nasty vile"), (9002, "again"), (None, "some text")]
    d = spark.createDataFrame(docs + more, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("label", F.lit(0))
    x = spark.createDataFrame(labels + [(7777, 1), (None, 1), (3, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    rows = tx.toxicity(d, x).collect()
    assert len(rows) == len(docs) + len(more) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    by = {r.doc_id: r for r in rows}
    assert by[9000].score == by[9001].score == 0 and max(r.predicted for r in rows if r.doc_id == 9002) == 1
    assert tx.toxicity(d.limit(0), x).count() == 0


def test_one_class_or_no_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    x = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in tx.toxicity(d, x).collect())
    assert all(r.predicted == 0 for r in tx.toxicity(d, x.limit(0)).collect())


def plain_score(net, text):
    """The network run step by step over every window of 32 words, by the definition."""
    import math
    import re

    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0.0
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    base, mask = tx.powers()[0], (1 << 64) - 1

    def poly(b):
        return sum((c + 1) * int(base[k]) for k, c in enumerate(b)) & mask

    def hashed(b, salt=0):
        return int(tx.mix(np.array([poly(b) ^ salt], np.uint64))[0])

    def vector(word):
        b = word.encode()
        grams = [hashed(b[k : k + size], salt) % tx.GRAMS for size, salt in ((3, 1), (4, 2), (5, 3)) for k in range(max(1, len(b) - size + 1))]
        grams.append(hashed(b[:4], 9) % tx.GRAMS)
        return np.concatenate([p["word"][hashed(b) % tx.WORDS], np.mean([p["gram"][g] for g in grams], axis=0)])

    sig, h = lambda v: 1 / (1 + np.exp(-v)), tx.HIDDEN
    x = [vector(w) for w in words]
    starts = sorted({*range(0, max(1, len(words) - tx.WINDOW + 1), tx.STRIDE), max(0, len(words) - tx.WINDOW)})
    best = -math.inf
    for s in starts:
        window = x[s : s + tx.WINDOW]
        states = {}
        for d in "fb":
            state, out = np.zeros(h), []
            for v in window if d == "f" else window[::-1]:
                g, r = v @ p[f"w{d}"] + p[f"c{d}"], state @ p[f"u{d}"]
                z, reset = sig(g[:h] + r[:h]), sig(g[h : 2 * h] + r[h : 2 * h])
                new = np.tanh(g[2 * h :] + reset * r[2 * h :])
                state = z * state + (1 - z) * new
                out.append(state)
            states[d] = out if d == "f" else out[::-1]
        both = [np.concatenate(v) for v in zip(states["f"], states["b"])]
        e = np.array([np.tanh(v @ p["a"]) @ p["v"] for v in both])
        share = np.exp(e - e.max())
        best = max(best, float((share / share.sum()) @ np.array(both) @ p["o"] + p["k"][0]))
    return 1 / (1 + math.exp(-best))


def test_scores_are_those_of_the_plain_network(corpus):
    docs, labels = corpus
    truth = dict(labels)
    net = tx.train([(t, truth[i]) for i, t in docs[:200]], rounds=2, epochs=1, least_steps=20)
    texts = [t for _, t in docs[200:230]] + ["", "?!", "x", "ÉTÉ Été nasty", "vile " * 33, " ".join(f"w{k}" for k in range(97)), "a" * 300 + " zorkx"]
    for data, offsets in (text_of(pa.array(texts)),):
        got = tx.scores(net, data, offsets)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=2e-5)
