"""Texts that are taken in pieces give what they give whole, in time and memory that grow with the text or less."""

import os
import random
import subprocess
import sys
import time

import numpy as np
import pyarrow as pa
import pytest

from boxlore.llm import language, quality, simhash, textops, toxicity
from boxlore.llm.textops import text_of


def test_span_hashes_over_chunks():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3 * textops.CHUNK + 77).astype(np.uint8)
    data[textops.CHUNK - 3 : textops.CHUNK + 9] = data[:12]
    starts = np.sort(np.concatenate([rng.integers(0, len(data) - 500, 300), [0, textops.CHUNK - 3, textops.CHUNK, 2 * textops.CHUNK, len(data) - 1]]))
    for n in (1, 7, 400):
        ends = np.minimum(starts + n, len(data))
        want = [int(textops.span_hashes(data[a:b], np.array([0]), np.array([b - a]))[0]) for a, b in zip(starts, ends)]
        assert textops.span_hashes(data, starts, ends).tolist() == want
    assert textops.span_hashes(data, np.array([0, textops.CHUNK - 3]), np.array([12, textops.CHUNK + 9]))[:].tolist().count(want[0]) == 0
    a, b = textops.span_hashes(data, np.array([0, textops.CHUNK - 3]), np.array([12, textops.CHUNK + 9])).tolist()
    assert a == b


def test_words_over_chunks(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab ,é", k=rng.randint(0, 40))) for _ in range(200)]
    want = [textops.Words(*text_of(pa.array([t])), textops.ALNUM) for t in texts]
    for chunk in (1 << 18, 64, 7):
        monkeypatch.setattr(textops, "CHUNK", chunk)
        textops._POWERS.clear()
        got = textops.Words(*text_of(pa.array(texts)), textops.ALNUM)
        assert got.count.tolist() == [int(w.count[0]) for w in want]
        assert (got.ends - got.starts).tolist() == [n for w in want for n in (w.ends - w.starts).tolist()]
    monkeypatch.undo()
    textops._POWERS.clear()


def test_pieces_of_quality_toxicity_and_fingerprints():
    rng = random.Random(1)
    weights = np.random.default_rng(1).normal(size=quality.DIMENSIONS).astype(np.float32) * 0.05
    net = toxicity.Network(2)
    for _ in range(60):
        text = "".join(rng.choices("abAB9!é  \n", k=rng.randint(0, 3000)))
        data, offsets = text_of(pa.array([text]))
        whole, worst = quality.scores(weights, data, offsets), toxicity.scores(net, data, offsets)
        for piece in (10, 100, 700):
            assert np.allclose(quality.scores(weights, data, offsets, piece), whole, atol=1e-9)
            assert np.allclose(toxicity.scores(net, data, offsets, piece), worst, atol=1e-5)
        for piece in (1, 7, 900):
            assert simhash.fingerprint(text.encode(), piece=piece) == simhash.fingerprint(text.encode())


def test_grams_of_long_words_are_the_same(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdef", k=rng.choice([1, 3, 8, 40, 200]))) for _ in range(200))
    data, offsets = text_of(pa.array([text]))
    net = toxicity.Network(2)
    want = net.inputs(toxicity.Tokens(data, offsets))
    monkeypatch.setattr(toxicity, "LONG", 16)
    monkeypatch.setattr(toxicity, "CHUNK", 10)
    got = toxicity.Tokens(data, offsets)
    assert got.weight is not None and np.allclose(net.inputs(got), want, atol=1e-6)


PAGE = ["<script", "</script>", "</script  >", "<!--", "-->", "<a href=x>", "<", ">", "&amp;", "&#65", "&#x41;", "text ", "é", "<style>", "</style", "</STYLE >", "/", "!", " ", "<b", "scriptx", "-", "&", "日本", "hello world "]


def test_pages_in_parts():
    rng = random.Random(2)
    logp = np.log(np.random.default_rng(0).random((3, language.BUCKETS)))
    for k in range(6000):
        page = "".join(rng.choices(PAGE, k=rng.randint(0, 25)))
        n = rng.choice([1, 2, 3, 7])
        assert "".join(language.visible_parts([page[a : a + n] for a in range(0, len(page), n)])) == language.visible_text(page), page
        if k < 300:
            data = np.frombuffer(page.encode(), np.uint8)
            for limit in (5, 40):
                (a, n), (b, m) = language.likelihoods(logp, [data]), language.likelihoods(logp, [data], limit)
                assert np.allclose(a, b) and n.tolist() == m.tolist()


@pytest.mark.parametrize("page", ["<" * 1_000_000, "<a " * 300_000, "<!--" * 300_000, "<script>" + "</script " * 100_000, "&" * 1_000_000])
def test_open_tags_are_linear(page):
    began = time.time()
    language.visible_text(page)
    assert time.time() - began < 3


def test_declared_language_and_hosts_are_linear(spark):
    page, host = "<html lang " * 100_000, "http://" + "a" * 100_000 + ".b" * 50_000
    df = spark.createDataFrame([(page, host), ('<HTML class="x" lang = \'De-at\'>', "http://WWW.a.Co.uk/x")], "p string, u string")
    h = language.host_of(df.u)
    began = time.time()
    rows = df.select(language.declared_language(df.p), h, language._domain(h), language._suffix(h)).collect()
    assert time.time() - began < 15 and tuple(rows[1]) == ("de", "www.a.co.uk", "co.uk", "uk") and rows[0][0] == "" and rows[0][2] == "b.b"


MEMORY = """
import sys
import numpy as np, pyarrow as pa
sys.path.insert(0, {repo!r})
from boxlore.llm import decontaminate, language, quality, simhash, suffix_dedup, toxicity
from boxlore.llm.textops import text_of
rng = np.random.default_rng(0)
words = np.array(["".join(w) for w in rng.choice(list("abcdefgh"), (5000, 6))])
text = "".join(" ".join(words[rng.integers(0, 5000, 1 << 16)].tolist()) + " " for _ in range({n} // (7 << 16)))
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text], pa.large_string())], names=["id", "text"])
q = decontaminate.phrases_of([("a", text[:3000])], 10, near=True)
net, weights = toxicity.Network(1), np.zeros(quality.DIMENSIONS, np.float32)
logp = np.zeros((3, language.BUCKETS))
data, offsets = text_of(batch.column("text"))
del text
def peak():
    return int(next(x for x in open("/proc/self/status") if x.startswith("VmHWM")).split()[1])
open("/proc/self/clear_refs", "w").write("5")  # the peak starts anew
before = peak()
todo = {{
    "op2": lambda: language.likelihoods(logp, [data]),
    "op3": lambda: sum(len(x[0]) for x in suffix_dedup.anchors(data, offsets, 48)),
    "op4": lambda: sum(len(decontaminate.intersect(s, q, 2)[0][0]) for s in decontaminate.shards(batch)),
    "op6": lambda: quality.scores(weights, data, offsets),
    "op8": lambda: simhash.fingerprint(data),
    "op10": lambda: toxicity.scores(net, data, offsets),
}}
todo[sys.argv[1]]()
print((peak() - before) // 1024)
"""


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op6", "op8", "op10"])
def test_a_long_text_takes_bounded_memory(name):
    """20 MB of text take under 300 MB beside themselves, most of it the same for any length."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", MEMORY.format(repo=repo, n=20 << 20), name], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 300
