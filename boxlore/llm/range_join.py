"""Near-duplicate embeddings: an exact metric range join over pivots.

Vectors are scaled to length one, where a cosine of t is a distance of sqrt(2 - 2 t). Each goes to the cell of its
nearest pivot. By the triangle inequality a vector x of one cell can be within eps of a vector of cell j only if x lies
within eps of the plane halfway between the two pivots, and within eps of the ball that holds cell j; just these cells
(of lower number than its own) get a copy of x. Cells are joined independently. A cell is cut into parts of bounded
size, and pairs of parts are the tasks, so a cell may hold any share of the rows; a task keeps one part in memory and
streams the other. Tasks return numbers of links and a spanning forest of them, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components
from .textops import thrifty

#: Vectors of a cell's part, about; vectors that a cell should hold; most pivots.
PART, CELL, PIVOTS = 4000, 3000, 256


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # the squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, n, x): one vector per id (the least), those that can link; x as doubles, padded later."""
    one = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x")).where("vec_id is not null")
    one = one.groupBy("vec_id").agg(F.min("x").alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return one.where(F.col("x").isNotNull()).where(~bad & F.exists("x", lambda v: v != 0)).select("vec_id", F.size("x").alias("n"), "x")


def _forest(near: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of a spanning forest of the links in a matrix; with ``own`` rows and columns are the same vectors."""
    if own:
        todo = near.any(1)
        while todo.any():
            front = np.flatnonzero(todo)[:1]
            todo[front] = False
            while len(front):
                reach = np.flatnonzero(near[front].any(0) & todo)
                yield front[near[np.ix_(front, reach)].argmax(0)], reach
                todo[reach] = False
                front = reach
        return
    rows, columns = near.any(1), near.any(0)
    while rows.any():
        front = np.flatnonzero(rows)[:1]
        rows[front] = False
        while len(front):
            reach = np.flatnonzero(near[front].any(0) & columns)
            yield front[near[np.ix_(front, reach)].argmax(0)], reach
            columns[reach] = False
            front = np.flatnonzero(near[:, reach].any(1) & rows) if len(reach) else reach
            if len(front):
                yield front, reach[near[np.ix_(front, reach)].argmax(1)]
                rows[front] = False


def range_links(vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", column: str = "embedding", pivots: int | None = None, part: int = PART) -> DataFrame:
    """(kind, a, b): kind 0: vector a has b more links; kind 1: an edge a, b of forests that connect all linked vectors."""
    spark = vectors.sparkSession
    usable = materialise(_usable(vectors, id_column, column), "vectors")
    total, width = usable.agg(F.count("*"), F.max("n")).first()
    links = "kind int, a bigint, b bigint"
    if not total:
        return spark.createDataFrame([], links)
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7
    pad = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(width) - F.col("n")))
    number = pivots or max(1, min(PIVOTS, total // CELL))
    chosen = usable.orderBy(F.xxhash64(F.lit(1), F.col("vec_id"))).limit(number).select(pad.alias("x")).collect()  # at most PIVOTS rows
    centres = _unit(np.array([r.x for r in chosen]))
    between = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))

    def distances(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * x @ centres.T, 0))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(np.array(batch.column("x").to_pylist(), np.float64))
                d = distances(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("n"), pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1)), pa.array([row.tobytes() for row in x], pa.binary())],
                    names=["vec_id", "n", "cell", "r", "x"],
                )

    homes = materialise(usable.select("vec_id", "n", pad.alias("x")).mapInArrow(thrifty(home), "vec_id bigint, n int, cell int, r double, x binary"), "homes")
    parts, radius = np.ones(number, np.int64), np.zeros(number)
    for r in homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect():  # a row per pivot
        parts[r.cell], radius[r.cell] = -(-r.n // part), r.r

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cell, r = _matrix(batch.column("x"), width), batch.column("cell").to_numpy(), batch.column("r").to_numpy()
            d = distances(x)
            plane = (d**2 - r[:, None] ** 2) / np.maximum(2 * between[cell], 1e-12)
            near = (plane <= eps) & (d <= radius + eps) & (np.arange(number) < cell[:, None])
            row, to = np.nonzero(near)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(row)) for k in ("vec_id", "n")] + [pa.array(to.astype(np.int32)), batch.column("x").take(pa.array(row))], names=["vec_id", "n", "cell", "x"])

    moved = homes.mapInArrow(thrifty(copies), "vec_id bigint, n int, cell int, x binary")
    # tiles of a cell: pairs of its parts (left <= right), and each part with each part of the copies (right < 0)
    count = F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("cell") + 1)
    own = F.pmod(F.xxhash64("vec_id"), count).cast("int")
    every = F.transform(F.sequence(F.lit(0), count - 1), lambda k: k.cast("int"))
    outer = F.lit(1 if number == 1 else max(1, int(total // (16 * part))))  # parts of a cell's copies, at most as many as all rows need
    outer_list = F.transform(F.sequence(F.lit(1), outer), lambda k: (-k).cast("int"))
    tile = lambda left, right, side: F.struct(left.cast("int").alias("left"), right.cast("int").alias("right"), F.lit(side).alias("side"))
    at_home = F.concat(F.transform(every, lambda k: F.when(own <= k, tile(own, k, 0)).otherwise(tile(k, own, 1))), F.transform(outer_list, lambda k: tile(own, k, 0)))
    abroad = F.transform(every, lambda k: tile(k, -1 - F.pmod(F.xxhash64(F.col("vec_id"), F.lit(5)), outer), 1))
    dealt = homes.select("vec_id", "n", "cell", "x", F.explode(at_home).alias("t")).unionAll(moved.select("vec_id", "n", "cell", "x", F.explode(abroad).alias("t")))
    dealt = dealt.select("cell", "t.*", "vec_id", "n", "x").repartition("cell", "left", "right").sortWithinPartitions("cell", "left", "right", "side")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile_key, left = None, []
        held = None

        def rows(found) -> pa.RecordBatch:
            kind, a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

        def compare(lx, li, ln, rx, ri, rn, own):
            near = lx @ rx.T >= threshold
            if (ln != ln[0]).any() or (rn != ln[0]).any():
                near &= ln[:, None] == rn[None, :]
            if own:
                np.fill_diagonal(near, False)
            out = []
            for ids, n in ((li, near.sum(1)),) if own else ((li, near.sum(1)), (ri, near.sum(0))):
                some = n > 0
                out.append((np.zeros(some.sum(), np.int64), ids[some], n[some].astype(np.int64)))
            if len(out[0][0]):
                for i, j in _forest(near, own):
                    out.append((np.ones(len(i), np.int64), li[i], ri[j]))
            return out

        def close():
            if held is not None and tile_key[1] == tile_key[2]:
                yield rows(compare(*held, *held, True))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in ("cell", "left", "right", "side")], 1)
            ids, n, x = batch.column("vec_id").to_numpy(), batch.column("n").to_numpy(), _matrix(batch.column("x"), width)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                key, side = tuple(keys[a][:3].tolist()), keys[a][3]
                if key != tile_key:
                    yield from close()
                    tile_key, left, held = key, [], None
                if side == 0:
                    left.append((x[a:b], ids[a:b], n[a:b]))
                    held = tuple(np.concatenate([p[k] for p in left]) for k in range(3))
                elif held is not None:
                    for c in range(a, b, 2048):
                        s = slice(c, min(b, c + 2048))
                        yield rows(compare(*held, x[s], ids[s], n[s], False))
        if tile_key is not None:
            yield from close()

    return dealt.mapInArrow(thrifty(join), links)


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", column: str = "embedding", pivots: int | None = None, part: int = PART) -> DataFrame:
    """Per vector: vec_id, n_links, component_id (the smallest vec_id reachable), kept (vec_id = component_id).

    Vectors link where their cosine, in double precision, is at least ``threshold``. A vector that is null, empty or zero,
    or holds a null or non-finite component, links with nothing, nor do vectors of different lengths. Rows of one id are
    one vector, the least by its components; a null id gives one row without links, whose component and kept are null. An
    empty table gives an empty one. Extra columns are ignored.
    """
    found = materialise(range_links(vectors, threshold, id_column, column, pivots, part), "links")
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links")).withColumnRenamed("a", "vec_id")
    roots = connected_components(found.where("kind = 1").select("a", "b")).withColumnRenamed("id", "vec_id")
    ids = vectors.select(F.col(id_column).cast("long").alias("vec_id")).distinct()
    out = ids.join(counts, "vec_id", "left").join(roots, "vec_id", "left")
    root = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col("vec_id") == root).alias("kept"))
