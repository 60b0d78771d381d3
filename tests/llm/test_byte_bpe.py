import hashlib
import os
import random

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers

from boxlore.llm import bpe, byte_bpe

PARTS = ["a", "b", "'", "s", "'s", "re", " ", "  ", "\n", "\t", "1", "9", ".", "^", "漢", "，", "é", "　", "\x85", "😀", "́", "ll", "\x1c", "ß", "<|endoftext|>"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(byte_bpe.default_vocabulary(), "rb") as f:
        return bpe.Vocabulary(f.read())


def random_text(rng, n):
    out, size = [], 0
    while size < n:
        out.append(rng.choice(PARTS) * rng.choice([1, 1, 1, 2, 3, 40, 150]))
        size += len(out[-1])
    return "".join(out)[:n]


def plain(vocabulary, text):
    """The library's own encoding of the whole text."""
    ids = vocabulary.encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_pattern_is_the_vocabularies_own():
    assert bpe.PATTERN == public_tokenizers.PATTERN and os.path.exists(byte_bpe.default_vocabulary())


def test_encoding_in_runs_and_boundaries(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "SAFE", 64)
    rng = random.Random(0)
    for _ in range(800):
        text = random_text(rng, rng.choice([0, 1, 50, 400, 1500]))
        assert vocabulary.encode(text) == vocabulary.encoding.encode_ordinary(text)
        ends = {0, *(m.end() for m in vocabulary.pattern.finditer(text))}
        assert ends.issuperset(m.start() for m in vocabulary.boundary.finditer(text))


@pytest.mark.parametrize("filler", [" ", "\n", "^", "0", "a", "漢"])
def test_a_run_of_millions(vocabulary, filler):
    text = "a" + filler * 2_000_000 + "b."
    assert vocabulary.decode(vocabulary.encode(text)) == text.encode()


def test_chunks_cover_the_text():
    for n in (0, 1, 7, 40, 41, 64, 65, 100):
        text = "".join(chr(97 + k % 26) for k in range(n))
        found = byte_bpe.chunks_of(text, 32, 8)
        assert "".join(t[:32] for _, t in found[:-1]) + found[-1][1] == text and all(len(t) <= 40 for _, t in found)


def test_stitched_pieces_against_whole_texts(spark, vocabulary):
    rng = random.Random(1)
    texts = [None, "", "x", *(random_text(rng, rng.choice([30, 90, 300, 1200])) for _ in range(150)), "x" + " " * 500 + "y z", "word " * 300, "漢" * 400, "1" * 300 + " a" * 100, "don't " * 200, "'re" * 200]
    rows = [(k // 2 if k % 7 else None, t, "n") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = byte_bpe.encoded_digests(docs, chunk=32, overlap=8)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *plain(vocabulary, t)) for i, t, _ in rows), key=repr)
    assert byte_bpe.encoded_digests(docs.limit(0)).count() == 0


def test_long_texts_through_production_chunks(spark, vocabulary):
    rng = random.Random(2)
    rows = [(1, "".join(rng.choices(["some ", "words, ", "漢字", "\n", "12.5 ", "isn't "], k=90_000))), (2, "a" + " " * 1_000_000 + "b"), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in byte_bpe.encoded_digests(docs).collect()}
    assert got[1] == plain(vocabulary, rows[0][1]) and got[3] == plain(vocabulary, "short")
    assert got[2][2] == hashlib.sha256(rows[1][1].encode()).hexdigest()


def test_rejects_chunks_that_cannot_be_stitched(spark):
    with pytest.raises(ValueError):
        byte_bpe.encoded_digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"), chunk=8, overlap=8)
