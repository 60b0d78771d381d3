import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from boxlore.llm import pii, simhash, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = ["".join(rng.choices("abcdefghi", k=rng.randint(2, 8))) for _ in range(3000)]
    items = [(k, " ".join(rng.choices(word, k=15))) for k in range(5)]
    rows, labels = [], []

    def add(text, source="s0"):
        rows.append((len(rows), text, "en", source, len(text or "")))

    for k in range(400):
        w = rng.choices(word, k=rng.randint(60, 200))
        if k % 5 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["nasty", "vile"])
        if k % 7 == 3:
            w[10:10] = items[k % 5][1].split()
        if k % 11 == 4:
            w[5:5] = [f"u{k}@mail.example.com", "10.1.2.3"]
        labels.append((len(rows), 1, int(k % 5 == 0)))
        add(" ".join(w), f"s{k % 3 if k % 2 else 0}")
        if k % 9 == 1:
            add(" ".join(w), "s1")
            add(" ".join(w[:-1]), "s2")
    for t in (None, "", "short text", "word " * 30_000):
        add(t, None)
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows + [rows[7], (None, "no id", None, "s0", 5)], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {(r.doc_id, r.text): r for r in docs.collect()}
    score = {(r.doc_id): r.score for r in toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder).cache()
        got = out.collect()
        if name != "source_mixing":
            assert out.columns == docs.columns
        rows = docs.collect()
        if name == "toxicity":
            assert sorted(map(repr, got)) == sorted(repr(r) for r in rows if score[r.doc_id] < 0.7)
            assert 50 < len(rows) - len(got) < 130
        elif name == "simhash_near_dedup":
            fp = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in rows if r.doc_id is not None}
            root = {i: i for i in fp}
            changed = True
            while changed:
                changed = False
                for a in fp:
                    for b in fp:
                        if root[a] > root[b] and (fp[a] ^ fp[b]).bit_count() <= 3:
                            root[a], changed = root[b], True
            assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(i for i in root if root[i] == i)
            assert sum(r.doc_id is None for r in got) == 1 and len(rows) - len(got) > 40
        elif name == "benchmark_decontamination":
            items = [r.text.split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            grams = {tuple(i[k : k + 10]) for i in items for k in range(len(i) - 9)}
            dirty = lambda t: any(tuple((w := (t or "").split())[k : k + 10]) in grams for k in range(len((t or "").split())))
            assert sorted(map(repr, got)) == sorted(repr(r) for r in rows if not dirty(r.text))
            assert len(rows) - len(got) > 20
        elif name == "personal_data":
            by = {r.doc_id: r for r in got}
            assert len(got) == len(rows)
            for r in rows:
                new = by[r.doc_id]
                assert new.text == (None if r.text is None else pii.redact(r.text, pii.find(r.text, *pii.model())[1]))
                assert new.n_chars == (r.n_chars if r.text is None else len(new.text)) and "@mail" not in (new.text or "")
        else:
            sizes, taken, target = defaultdict(int), defaultdict(int), {}
            for r in rows:
                sizes[r.source] += len((r.text or "").split())
            for r in got:
                taken[r.source] += r.taken
                target[r.source] = r.target
                assert r["size"] == len(r.text.split()) and 0 < r.taken <= 2 * r["size"]
            assert all(abs(taken[s] - target[s]) <= 1 for s in target) and sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
        docs = spark.createDataFrame(got, out.schema)
    assert len(before) > len(got) > 50


def test_run_is_the_stages(spark, folder):
    assert cp.run(spark, folder).select(F.sum("taken")).first()[0] > 0 and cp.ORACLE_SQL is None
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "personal_data", "source_mixing"]


def test_repeated_ids_are_one_document(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60")
    once = cp.drop_near_duplicates(spark, docs.dropDuplicates(["doc_id"]), folder)
    twice = cp.drop_near_duplicates(spark, docs.unionAll(docs), folder)
    assert once.columns == docs.columns and sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))
