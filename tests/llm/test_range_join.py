import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlore.llm.range_join import near_vectors


def brute(rows, t):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    ids = sorted({i for i, _ in rows if i is not None})
    link = {i: set() for i in ids}
    for i in ok:
        for j in ok:
            if i < j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= t:
                link[i].add(j)
                link[j].add(i)
    root = {}
    for i in ids:
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo += link[x]
    return sorted((i, len(link[i]), root[i], root[i] == i) for i in ids)


def data(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(25):
        centre = rng.normal(size=8)
        spread = rng.choice([0.02, 0.1, 0.3])
        rows += [(len(rows) + k, (rng.uniform(0.1, 9) * (centre + spread * rng.normal(size=8))).tolist()) for k in range(12)]
    hot = rng.normal(size=8)
    rows += [(1000 + k, (hot + 0.01 * rng.normal(size=8)).tolist()) for k in range(150)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] + [0.0] * 6), (2003, [float("nan")] * 8), (2004, [float("inf")] + [1.0] * 7), (2005, []), (2006, [3.0, 0.0]), (2007, [1.0, 0.0]), (2008, rows[0][1][:4]), (2009, [c * 1e-200 for c in rows[1][1]]), (2010, [c * 1e200 for c in rows[1][1]])]
    return rows


@pytest.mark.parametrize(("pivots", "part"), [(None, 1500), (6, 20), (40, 1500), (1, 7)])
def test_against_all_pairs(spark, pivots, part):
    rows = data(pivots or 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x")).withColumn("label", F.lit(1))
    got = sorted(tuple(r) for r in near_vectors(df, pivots=pivots, part=part).collect())
    want = brute([(i, [c * 1e200 for c in v] if i == 2009 else [c * 1e-200 for c in v] if i == 2010 else v) for i, v in rows], 0.95)
    assert got == want


def test_repeated_null_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (None, [1.0, 0.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, near_vectors(df).collect()), key=repr) == [(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, None)]
    assert near_vectors(df.limit(0)).count() == 0
