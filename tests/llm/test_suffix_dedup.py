import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxlore.llm import suffix_dedup as sd


def brute(texts, length):
    seen = defaultdict(int)
    texts = [(t or "").encode() for t in texts]
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] += 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(400)]
    passages = [" ".join(rng.choices(word, k=k)) for k in (30, 60, 60, 120, 400)]
    texts = [None, "", "short", "short", "ab" * 700, "x" * 199, "x" * 200, "y" * 201]
    for k in range(60):
        parts = [" ".join(rng.choices(word, k=rng.randint(0, 120)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            parts += [p[a:b] if rng.random() < 0.6 else p, " ".join(rng.choices(word, k=rng.randint(0, 90)))]
        texts.append("".join(parts))
    for k in range(12):
        t = list(rng.choice(texts[8:40]))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = "#" if t else ""
        texts.append("".join(t))
    return texts


@pytest.mark.parametrize(("seed", "limit"), [(1, 2000), (2, 2)])
def test_against_brute_force(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(sd, "LIMIT", limit)
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("c", F.lit("clash")).withColumn("u1", F.lit(1))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(docs).collect()}
    want = brute(texts, 200)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(w[1] for w in want) > 1000


def test_repeated_rows_null_ids_and_empty(spark):
    long_text = "".join(random.Random(4).choices("abcdefgh ", k=150_000))
    rows = [(1, "q" * 3 + "z" * 10), (1, "q" * 3 + "z" * 10), (5, long_text[:300]), (5, long_text[:300]), (None, long_text), (5, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in sd.remove_repeats(docs).collect()), key=repr)
    assert got == sorted([(1, 13, 0), (1, 13, 0), (5, 300, 300), (5, 300, 300), (None, 150_000, 300), (5, 5, 0)], key=repr)
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_interval_tree_outputs_maximal_repeats():
    text = b"xabcabdyabcabc"
    suffixes, left = [text[k:] for k in range(len(text))], [-1, *text[:-1]]
    found = {(suffixes[m[0]][:n], tuple(sorted(m))) for n, m in sd.interval_repeats(suffixes, left, 2)}
    want = set()
    for i in range(len(text)):
        for j in range(i + 2, len(text) + 1):
            s = text[i:j]
            at = tuple(k for k in range(len(text)) if text.startswith(s, k))
            rights = {text[k + len(s)] if k + len(s) < len(text) else ("end", k) for k in at}
            lefts = {text[k - 1] if k else "begin" for k in at}
            if len(at) > 1 and len(rights) > 1 and len(lefts) > 1:
                want.add((s, at))
    assert found == want


def test_groups_have_all_occurrences(spark):
    p = "".join(random.Random(8).choices("abcdefgh ", k=260))
    docs = spark.createDataFrame([(1, "1" + p + "!"), (2, "22" + p + "?"), (3, p + "#" + p)], "doc_id long, text string")
    found = sd.maximal_repeats(docs).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.group_id].add((r.doc_id, r.start))
        text = {1: "1" + p + "!", 2: "22" + p + "?", 3: p + "#" + p}[r.doc_id]
        assert text[r.start : r.start + r.n_bytes] in p and r.n_bytes >= 200
    assert any(g == {(1, 1), (2, 2), (3, 0), (3, 261)} for g in groups.values())


def test_many_repeated_rows_are_searched_once(spark):
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefgh ", k=719))
    rows = [(None, text)] * 20_000 + [(1, text), (2, "x" + text[:300]), (3, "short")]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 719, 719, 1, 20_000), (1, 719, 719, 1, 1), (2, 301, 300, 1, 1), (3, 5, 0, 0, 1)], key=repr)


def test_pieces_give_the_same(spark, monkeypatch):
    texts = corpus(3)
    monkeypatch.setattr(sd, "PIECE", 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {}
    for k, (data, offsets) in enumerate([sd.text_of(pa.array([t or "" for t in texts]))]):
        for piece in (sd.CHUNK - 400, 300):
            runs = list(sd.anchors(data, offsets, 48, piece=piece))
            whole[piece] = sorted((int(r), w) for rows, _, first, last, _ in runs for r, a, b in zip(rows, first, last) for w in range(a, b + 1))
    assert whole[300] == whole[sd.CHUNK - 400] and len(whole[300]) > 1000
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 200)
