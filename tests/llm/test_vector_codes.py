import hashlib
import math

import numpy as np
import pytest

from boxlore.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """The whole in plain Python: rows of (vec_id, embedding, label)."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    d = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == d]
    limit = vc.LARGEST
    ints = [[max(-limit, min(limit, math.floor(256 * x))) for x in r[1]] for r in kept]
    at = vc.cuts(d, parts)
    books = [[v[at[p] : at[p + 1]] for v in ints[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((dist(v[at[p] : at[p + 1]], c), j) for j, c in enumerate(books[p])) for p in range(parts)] for v in ints]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [v[at[p] : at[p + 1]] for v, f in zip(ints, found) if f[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(kept, errors):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in f), e, by[r[2]], sha) for r, f, e in zip(kept, found, errors)), key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS error", "'x' AS code", "0 AS part")
    return sorted(map(tuple, vc.vector_codes(df.repartition(3), **more).collect()), key=repr)


@pytest.mark.parametrize("seed,entries,d,scale", [(0, 64, 64, 0.1), (1, 5, 32, 0.01), (2, 3, 20, 3.0), (3, 8, 7, 0.5), (4, 4, 16, 5000.0)])
def test_against_plain_lloyd(spark, seed, entries, d, scale):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(0, scale, d).round(3)], [None, 1, 2][i % 3] if i % 2 else 1) for i in rng.permutation(300)]
    rows += rows[:7] + [(1000 + k, rows[3][1], 2) for k in range(40)]  # repeated rows, and many equal vectors
    assert run(spark, rows, entries=entries) == brute(rows, entries=entries)


def test_edge_rows(spark):
    good = [(k, [0.01 * ((k * j) % 7 - 3) for j in range(32)], k % 2) for k in range(20)]
    odd = [(100, None, 1), (101, [], 1), (102, [1.0] * 31 + [None], 1), (103, [math.nan] + [0.0] * 31, 0), (104, [math.inf] * 32, 0), (105, [1.0] * 16, 0), (None, [0.5] * 32, None), (106, [1e300] * 32, 5), (107, [-1e300] * 32, 5)]
    got = run(spark, good + odd)
    assert got == brute(good + odd) and len(got) == 23
    assert run(spark, odd[:2]) == [] and run(spark, []) == []
    assert vc.vector_codes(spark.createDataFrame([], SCHEMA)).dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]


def test_bounds_save_scans_and_change_nothing():
    rng = np.random.default_rng(7)
    centres = rng.integers(-900, 900, (16, 4))
    part = centres[rng.integers(0, 16, 5000)] + rng.integers(-30, 30, (5000, 4))
    old = centres + rng.integers(-20, 20, centres.shape)
    new = old + rng.integers(-8, 8, old.shape)
    code, upper, lower = vc.scan(part, old)
    scans = vc.renew(part, code, upper, lower, old, new)
    exact = vc.squares(part, new)
    assert (code == exact.argmin(1)).all() and scans < 1000
    true = np.sqrt(exact.astype(float))
    assert (upper >= true[np.arange(5000), code]).all()
    true[np.arange(5000), code] = np.inf
    assert (lower <= true.min(1)).all()


def test_ties_take_the_lower_index_after_moves():
    old, new = np.array([[0], [10], [30]]), np.array([[2], [8], [30]])
    part = np.array([[5], [4], [6], [19], [5]])
    code, upper, lower = vc.scan(part, old)
    assert code.tolist() == [0, 0, 1, 1, 0]
    vc.renew(part, code, upper, lower, old, new)
    assert code.tolist() == vc.squares(part, new).argmin(1).tolist() == [0, 0, 1, 1, 0]


def test_large_components_are_exact():
    part = np.array([[vc.LARGEST, -vc.LARGEST], [3, 4]])
    assert vc.squares(part, np.array([[-vc.LARGEST, vc.LARGEST], [0, 0]])).tolist() == [[8 * vc.LARGEST**2, 2 * vc.LARGEST**2], [(vc.LARGEST + 3) ** 2 + (vc.LARGEST - 4) ** 2, 25]]
