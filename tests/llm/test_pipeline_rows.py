import random

import pytest

import corpus_pipeline as cp
from boxlore.llm.common import drop, materialise

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices("abcdefghi", k=6)) for _ in range(80)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


@pytest.mark.parametrize("sent", [1 << 19, 0])
def test_near_dedup_takes_rows_by_id_and_text(spark, monkeypatch, sent):
    monkeypatch.setattr(cp, "SENT", sent)  # beyond it the keys are joined by a shuffle
    a, b, c, d, e = texts(5, 1)
    rows = [(1, a), (1, b), (1, b), (2, a), (None, c), (None, c), (None, c), (None, d), (3, d), (None, None), (4, e), (5, None), (5, "")]
    got = sorted(((r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, frame(spark, rows), "").collect()), key=repr)
    assert [x for x in got if x[0] != 5] == sorted([(1, a), (1, b), (None, c), (3, d), (4, e)], key=repr)
    assert sum(x[0] == 5 for x in got) == 1
    assert cp.drop_near_duplicates(spark, frame(spark, rows).limit(0), "").count() == 0


def test_decontamination_judges_rows_by_their_own_text(spark, tmp_path):
    item, a, b = texts(3, 2)
    spark.createDataFrame([(0, " ".join(item.split()[:15])), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, a), (1, item), (1, b), (2, None), (3, "")]
    docs = frame(spark, rows)
    got = cp.drop_contaminated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(None, a), (1, b), (2, None), (3, "")], key=repr)


def test_drop_deletes_what_was_kept_and_nothing_else(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/own")
    own, kept = spark.read.parquet(f"{tmp_path}/own"), materialise(spark.range(5), "kept")
    assert kept.count() == 5
    drop(own)
    drop(kept)
    assert spark.read.parquet(f"{tmp_path}/own").count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST"):
        spark.read.parquet(kept.kept_at).count()
