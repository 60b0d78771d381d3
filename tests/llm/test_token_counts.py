import os
import random

import pytest
from pyspark.sql import functions as F

from boxlore.llm import token_counts as tc

pytestmark = pytest.mark.skipif(not os.path.exists(tc.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def count():
    with open(tc.VOCABULARY, "rb") as f:
        return tc.load(f.read())


def test_leaves_sum_to_the_whole(count):
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choices(["a", "bc ", " ", "  ", "\n", "É", "'s", "'", "12", "½", " d", "!", "日本", "\t", " "], k=rng.randint(0, 200)))
        parts = tc.cut(text, 5)
        assert "".join(parts) == text and sum(map(count, parts)) == count(text)


def test_edits_against_full_counts(count):
    rng = random.Random(1)
    for leaf in (3, 40):
        text = " ".join("".join(rng.choices("abcdeé'1. ", k=rng.randint(1, 9))) for _ in range(300))
        tree = tc.TokenTree(text, count, leaf)
        assert tree.encoded == len(text)
        for _ in range(250):
            a = rng.randint(-2, len(text) + 2)
            b = a + rng.choice([0, 0, 1, 2, 5, 60, -1])
            new = rng.choice(["", "x", " ", "'s", " y z ", "\n\n", "[EMAIL]", "word " * 30])
            tree.edit(a, b, new)
            s = min(max(a, 0), len(text))
            e = min(max(b, s), len(text))
            text = text[:s] + new + text[e:]
            assert tree.text() == text and tree.tokens == count(text)


def test_an_edit_encodes_its_region_only(count):
    text = "some words here and more of them " * 5000
    tree = tc.TokenTree(text, count)
    before = tree.encoded
    for _ in range(200):
        tree.edit(80_000, 80_003, "abc d")
    assert tree.encoded - before < 200 * 4 * tc.LEAF and tree.tokens == count(tree.text())


def test_query(spark, count):
    rows = [(1, None), (2, ""), (3, "mail a.b@c.org or +1 (555) 123-4567 now"), (4, "word " * 40_000), (4, "x"), (None, "hello there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = sorted((tuple(r)[:4] for r in tc.token_counts(docs).collect()), key=repr)
    want = []
    for i, t in rows:
        clean = "mail [EMAIL] or [PHONE] now" if i == 3 else t or ""
        want.append((i, count(t or ""), 2 if i == 3 else 0, count(clean)))
    assert got == sorted(want, key=repr) and tc.token_counts(docs.limit(0)).count() == 0
    edits = spark.createDataFrame([(4, 2, 0, 5, "AB"), (4, 1, 0, 0, "some more words "), (9, 1, 0, 1, "x"), (None, 1, 0, 1, "x")], "doc_id long, turn int, start int, end int, replacement string")
    by = sorted((tuple(r)[:4] for r in tc.token_counts(docs, edits).collect() if r.doc_id == 4), key=repr)
    assert by == sorted([(4, count("x"), 2, count("ABmore words x")), (4, count("word " * 40_000), 2, count("ABmore words " + "word " * 40_000))], key=repr)


def test_many_appends_behind_a_large_insert_stay_balanced(count):
    tree = tc.TokenTree("word and " * 180, count, 64)
    tree.edit(800, 800, "some more " * 20_000)
    for _ in range(10_000):
        tree.edit(tree.root.chars, tree.root.chars, " and more words here to add")

    def height(node):
        if node.left is None:
            return 0
        a, b = height(node.left), height(node.right)
        assert abs(a - b) <= 1
        return 1 + max(a, b)

    assert height(tree.root) == tree.root.height < 25 and tree.tokens == count(tree.text())


@pytest.mark.parametrize("filler", [" ", "\n", "^", "0", "a", "漢"])
def test_a_run_of_millions(count, filler):
    tree = tc.TokenTree("a" + filler * 2_000_000 + " b", count)
    assert tree.tokens > 100_000


def test_texts_of_digits_signs_lines_or_one_script_have_leaves(count):
    for text in ("12.5, 13.7, " * 10_000, "----++++\n\n" * 12_000, "，漢字。" * 30_000, "12\n\n13\n" * 20_000):
        tree = tc.TokenTree(text, count)
        before, rng = tree.encoded, random.Random(5)
        for _ in range(20):
            at = rng.randrange(len(text))
            tree.edit(at, at + 1, "7")
        assert tree.encoded - before < 20 * 4 * tc.LEAF and tree.tokens == count(tree.text())


def test_long_white_space_through_spark(spark, count):
    text = "a" + " " * 1_000_000 + "b"
    docs = spark.createDataFrame([(1, text), (2, "x y")], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in tc.token_counts(docs).collect()) == [(1, count(text), 0), (2, 2, 0)]
