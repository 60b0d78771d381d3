import random

import pytest
import xxhash
from pyspark.sql import functions as F

from boxlore.llm import simhash
from boxlore.llm.components import connected_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_is_spark_hash_of_shingles(spark):
    text = "The quick\tbrown  FOX jumps\nover Äpfel"
    got = simhash.fingerprint(text.encode())
    assert got == plain_fingerprint(text)
    row = spark.sql("select xxhash64('the quick brown') h").first()
    assert simhash.fingerprint(b"The quick  brown") == row.h % 2**64
    assert simhash.fingerprint(b" \n") == 0 and simhash.fingerprint("été".encode()) == plain_fingerprint("été")


@pytest.mark.parametrize("tile", [2000, 3])
def test_links_connect_all_within_three_bits(spark, tile):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(6):
            x = base
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    edges = simhash.links(nodes, tile)
    for r in edges.collect():
        assert (fps[r.a] ^ fps[r.b]).bit_count() <= 3
    want = plain_components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_near_duplicates_edge_rows(spark):
    long_text = " ".join(f"w{k % 997}" for k in range(20000))
    rows = [(1, None), (2, ""), (3, "a b c d e"), (4, "a  b c\td e"), (5, long_text), (6, long_text), (6, long_text), (7, "one"), (None, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("rep", F.lit("x"))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (6, 5), (7, 7), (None, None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(1)
    vocabulary = [f"v{k}" for k in range(300)]
    texts = {}
    for g in range(30):
        words = rng.choices(vocabulary, k=400)
        for c in range(4):
            w = list(words)
            for _ in range(c):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[g * 10 + c] = " ".join(w)
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fp[i], want[i]) for i in fp}


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 9), (3, 20)] + [(k, k + 1) for k in range(100, 160)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert all(got.get(k, k) == 100 for k in range(100, 161)) and got[20] == 1 and got[5] == 4 and got[9] == got[10] == 8 and 7 not in got
    assert connected_components(df.limit(0)).count() == 0
