import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlore.llm import language as lg

WORDS = {"en": "the of and that with house street".split(), "de": "der und nicht mit über haus straße".split(), "fr": "le et avec dans été maison rue".split()}


def text(rng, lang, n=60):
    return " ".join(rng.choices(WORDS[lang], k=n))


def corpus():
    rng = random.Random(2)
    docs = [(k, text(rng, lang := rng.choice(list(WORDS))), lang) for k in range(120)] + [(500, None, "en"), (501, "", "de"), (502, "x", None)]
    pages = []
    for k in range(80):
        lang = ("fr", "en", "de")[k % 3]
        host = {"fr": "www.a.fr", "en": "b.example.com", "de": "c.example.de"}[lang]
        pages.append((k, f"https://{host}/{k}", f'<html lang="{lang}"><script>var der = "und";</script><body>{text(rng, lang, rng.choice([2, 40]))}</body></html>', lang))
    pages += [(100, "https://www.a.fr/x", "<html><body>ok</body></html>", "fr"), (101, None, '<html lang="de"></html>', "de"), (102, "http://www.a.fr", None, "fr"), (103, "ftp://new.host.de", "", None), (103, "nonsense", "<p>" + text(rng, "en", 30_000), "en"), (None, "//www.a.fr/", "<html lang=fr-CA>" + text(rng, "en", 300), "en")]
    return docs, pages


def brute(docs, pages):
    langs = sorted({d[2] for d in docs if d[2] and d[1] is not None})

    def grams(t):
        b = t.encode()
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
        ok = lambda c: 97 <= c <= 122 or c >= 128 or c == 32
        return [int(lg.mix(np.array([b[i] << 16 | b[i + 1] << 8 | b[i + 2]], np.uint64))[0] % lg.BUCKETS) for i in range(len(b) - 2) if all(map(ok, b[i : i + 3]))]

    counts = {x: defaultdict(lambda: 1) for x in langs}
    for _, t, x in docs:
        if x and t is not None:
            for g in grams(t):
                counts[x][g] += 1
    size = {x: sum(v - 1 for v in counts[x].values()) + lg.BUCKETS for x in langs}
    facts = []
    for i, url, page, _ in pages:
        g = grams(lg.visible_text(page))
        ll = [sum(math.log(counts[x][q] / size[x]) for q in g) * min(1, lg.EFFECTIVE / max(1, len(g))) for x in langs]
        p = [math.exp(v - max(ll)) for v in ll]
        p = [v / sum(p) for v in p]
        import re

        host = (re.search(r"//([^/]*)", url or "") or [None, ""])[1]
        declared = (re.search(r'<html[^>]*lang="?(\w\w)', page or "") or [None, ""])[1]
        facts.append((i, host, declared, ll, p))
    total = [sum(f[4][j] for f in facts) for j in range(len(langs))]

    def group(key):
        out = defaultdict(lambda: [0.0] * len(langs))
        for f in facts:
            out[key(f)] = [a + b for a, b in zip(out[key(f)], f[4])]
        return out

    suffix = lambda f: f[1].split(".")[-1]
    domain = lambda f: ".".join(f[1].split(".")[-2:])
    by = [group(k) for k in (suffix, domain, lambda f: f[1], lambda f: f[2])]
    out = []
    for f in facts:
        prior = [(t + 1) / (sum(total) + len(langs)) for t in total]
        for level, key in zip(by[:2], (suffix, domain)):
            c = level[key(f)]
            prior = [(c[j] + lg.KAPPA * prior[j]) / (sum(c) + lg.KAPPA) for j in range(len(langs))]
        c = by[2][f[1]]
        prior = [max(1e-6, (c[j] - f[4][j] + lg.KAPPA * prior[j]) / (sum(c) - 1 + lg.KAPPA)) for j in range(len(langs))]
        score = [f[3][j] + math.log(prior[j]) for j in range(len(langs))]
        for table, key, there in ((by[0], suffix(f), f[1]), (by[3], f[2], f[2])):
            if there:
                score = [s + math.log((table[key][j] + lg.ALPHA) / (total[j] + lg.ALPHA * (len(langs) + 1))) for j, s in enumerate(score)]
        best = max(range(len(langs)), key=lambda j: (score[j], -j))
        out.append((f[0], langs[best], 1 / sum(math.exp(s - score[best]) for s in score)))
    return out


def test_against_plain_python(spark):
    docs, pages = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("p", F.lit("clash"))
    p = spark.createDataFrame([x[:3] for x in pages], "page_id long, url string, html string").withColumn("lang", F.lit("zz")).withColumn("text", F.lit(1))
    got = sorted(((r.page_id, r.lang, r.probability) for r in lg.identify(p, d).collect()), key=lambda r: (repr(r[0]), r[2]))
    want = sorted(brute(docs, pages), key=lambda r: (repr(r[0]), r[2]))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-6)
    truth = {x[0]: x[3] for x in pages if x[0] not in (103,)}
    right = [g[1] == truth[g[0]] for g in got if g[0] in truth]
    assert sum(right) / len(right) > 0.95


def test_empty_tables(spark):
    docs, pages = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    p = spark.createDataFrame([x[:3] for x in pages], "page_id long, url string, html string")
    assert lg.identify(p.limit(0), d).count() == 0
    assert {r.lang for r in lg.identify(p, d.limit(0)).collect()} == {None}
