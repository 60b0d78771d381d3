import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from boxlore.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, longest=5, reported=2000, share=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in candidates.items():
            if p in inside and 100 * inside[p] >= share * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:reported], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus(seed, docs, words):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(12)] + ["The", "ÉCU", "漢字", "of", "😀", "x\x85y"]
    ends = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r", "\x0c"]
    runs = ["new york city hall is", "one two one two", "a a a a a a"]
    rows = []
    for k in range(docs):
        text = "".join((rng.choice(runs) if rng.random() < 0.05 else rng.choice(pool)) + rng.choice(ends) for _ in range(rng.choice([0, 1, 5, words])))
        rows.append((k if k % 9 else None, text if k % 11 else None, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS a", "'x' AS phrase", "2 AS shard")
    return sorted(map(tuple, co.collocations(df.repartition(3), **more).collect()))


def test_against_plain_counts(spark):
    rows = corpus(0, 120, 120)
    want = brute(rows, 12)
    assert {r[0] for r in want} >= {"en", "de", "und"} and {len(r[2].split(" ")) for r in want} >= {2, 3, 4}
    assert run(spark, rows, least=12) == want
    assert run(spark, rows + rows[:40], least=12, reported=5, share=80, longest=3) == brute(rows + rows[:40], 12, 3, 5, 80)


def test_texts_cut_into_many_shards(spark):
    rows = corpus(1, 12, 900) + [(7, "one two " * 400 + "z" * 3000 + " one two", "en"), (8, "a " * 700, "en")]
    assert run(spark, rows, least=12, shard_bytes=300) == brute(rows, 12)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, None), (2, "", "en"), (3, " .,", "en")]) == []
    got = co.collocations(spark.createDataFrame([], SCHEMA))
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"


def test_scores_beyond_64_bits(spark, monkeypatch):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    big = 10**13
    totals = table([("en", 2 * big)], "lang string, n long")
    phrases = table([("en", "a", big), ("en", "b", big - 1), ("en", "a b", big // 3)], "lang string, phrase string, f long")
    monkeypatch.setattr(co, "frequencies", lambda *a: (totals, phrases))
    got = co.collocations(table([], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", big // 3, big, big - 1, 2 * big, 1000 * (big // 3) * 2 * big // (big * (big - 1)))]


def test_extend_is_a_merge_of_neighbours():
    words = co.Lists.of(np.array([0, 1, 0, 1, 0]), np.array([0, 1, 2, 4, 5]), 2)
    at, ids = words.merged()
    assert at.tolist() == [0, 1, 2, 4, 5] and ids.tolist() == [0, 1, 0, 1, 0]
    hit, word = co.extend(at, at, 1)
    assert at[hit].tolist() == [0, 1, 4] and ids[word].tolist() == [1, 0, 0]
    hit, word = co.extend(at[hit], at, 2)
    assert hit.tolist() == [True, False, False] and word.tolist() == [2]


def test_buckets_of_any_number_lose_no_phrase(spark, monkeypatch):
    rows = corpus(3, 60, 200)
    monkeypatch.setattr(co, "FEWEST", 1 << 13)
    fine = run(spark, rows, least=150)  # counts beyond a byte's half
    monkeypatch.setattr(co, "MOST", 8)
    monkeypatch.setattr(co, "SEGMENT", 8)
    assert run(spark, rows, least=150) == fine == brute(rows, 150)
    assert co.bucket_count(0) == 8


def test_words_and_positions():
    words, positions, starts = co.words_of(np.frombuffer("The, cat\tSAT. É  x".encode(), np.uint8))
    assert words.to_pylist() == ["the", "cat", "sat", "É", "x"] and positions.tolist() == [0, 2, 3, 5, 6] and starts.tolist() == [0, 5, 9, 14, 18]
    assert len(co.words_of(np.zeros(0, np.uint8))[0]) == 0 and isinstance(words, pa.Array)
