import hashlib
import random
import re

from pyspark.sql import functions as F

from boxlore.llm import decontaminate as dec

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, held = words(text), set(), set()
        for item_id, item in items:
            i = words(item)
            for k in range(max(1, len(i) - 9) if i else 0):
                p = i[k : k + 10]
                for a in range(len(w) - len(p) + 1):
                    if w[a : a + len(p)] == p:
                        hit |= set(range(a, a + len(p)))
                        held.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("terms", F.lit(0)).withColumn("item_id", F.lit(3))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    return sorted((tuple(r)[:6] for r in dec.contamination(d, i, **more).collect()), key=repr)


def corpus():
    rng = random.Random(3)
    vocabulary = ["été", "x1", "Über", "日本", *"abcdefghij"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 14, 25])))) for k in range(30)] + [(99, None), (98, " .. "), (10, "a")]
    docs = []
    for k in range(60):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))
        if k % 3 == 0:
            text += "-" + rng.choice(items[:30])[1] + ", " + text
        docs.append((k, text))
    return docs + [(100, None), (101, ""), (101, "a b"), (None, "a"), (102, "b " * 70000 + items[4][1])], items


def test_against_brute_force(spark):
    docs, items = corpus()
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark):
    docs, items = corpus()
    assert run(spark, docs, items, query_bytes=200) == brute(docs, items)
    assert run(spark, docs, items + [(97, "a b " * 300 + "x1")], query_bytes=300) == brute(docs, items + [(97, "a b " * 300 + "x1")])


def test_long_documents_in_parts_give_the_same(spark):
    docs, items = corpus()
    assert run(spark, docs, items, limit=1500) == brute(docs, items)


def near(text, item, window=10, slop=2):
    w, i = words(text), words(item)
    for k in range(max(1, len(i) - window + 1) if i else 0):
        p = set(i[k : k + window])
        n = len(i[k : k + window]) + slop
        if any(p <= set(w[a : a + n]) for a in range(len(w))):
            return True
    return False


def test_proximity_against_brute_force(spark):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choices("abcdefgh", k=rng.choice([1, 2, 5, 12])))) for k in range(12)] + [(None, "g h"), (None, "a z")]
    docs = [(k, " ".join(rng.choices("abcdefghxyzuv", k=rng.randint(0, 40)))) for k in range(60)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 40):
        got = {r.doc_id: r.n_near for r in dec.contamination(d, i, window=4, limit=limit).collect()}
        assert got == {k: len({x for x, item in items if near(t, item, 4)}) for k, t in docs}
    index = dec.build_index(d)
    for slop in (0, 3, 250):
        got = {(r.doc_id, r.item_id) for r in dec.search(index, i, 4, slop).collect()}
        assert got == {(k, x) for k, t in docs for x, item in items if near(t, item, 4, slop)}


def test_items_without_an_id_count_once_and_are_not_listed(spark):
    docs, items = [(1, "a b"), (2, "b c"), (3, "x")], [(None, "a"), (None, "b"), (5, "b")]
    sha = hashlib.sha256(b"5").hexdigest()
    assert [(r[0], r[2], r[3], r[4], r[5]) for r in run(spark, docs, items)] == [(1, 2, 2, sha, True), (2, 1, 2, sha, True), (3, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


def test_flags_are_the_same_for_one_block_and_many(spark):
    docs, items = corpus()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((r[0], r[5]) for r in brute(docs, items)), key=repr)
    for size in (1 << 20, 200):
        assert sorted(((r.doc_id, r["__contaminated"]) for r in dec.flagged(d, i, query_bytes=size).collect()), key=repr) == want
    assert not any(r["__contaminated"] for r in dec.flagged(d, i.limit(0)).collect())


def test_empty_tables(spark):
    docs, items = corpus()
    assert run(spark, [], items) == [] and all(not r[5] for r in run(spark, docs, []))


def test_matches_and_proximity(spark):
    docs = spark.createDataFrame([(1, "p q a b c d"), (2, "a x c y b"), (3, "a b . c")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "A b c")], "item_id long, text string")
    index = dec.build_index(docs)
    assert sorted(map(tuple, dec.search(index, items).collect())) == [(1, 7, 2, 3), (3, 7, 0, 3)]
    assert {r.doc_id for r in dec.search(index, items, slop=2).collect()} == {1, 2, 3}
    assert {r.doc_id for r in dec.search(index, items, slop=0).collect()} == {1, 3}
