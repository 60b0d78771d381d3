"""Vectors as one byte per part: Lloyd's rounds over integer parts, with Hamerly's bounds kept beside each part.

Every part of every vector keeps an upper bound of its distance to the entry that it is assigned to, and a lower bound of
its distance to every other entry. When a round moves the entries, the bounds are widened by what they moved; only parts
whose bounds do not fail to be strictly apart are left alone. All others are measured against their own entry, and, if
that does not part the bounds, against all entries, in integers. Bounds are rounded outwards, and equal ones count as
failed, so ties always go to the full scan, which takes the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise
from .textops import thrifty

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components saturate here (a component of 2**18 and more, if SCALE is 256), so that all sums of squares fit 64 bits.
LARGEST = 1 << 26
#: Components whose products, summed over a part, a double holds exactly.
_EXACT = 1 << 20
#: Rows that a kernel takes at once.
ROWS = 4096
#: Labels whose sums of errors are sent to every task; beyond that Spark plans the join.
SENT = 1 << 16


def cuts(dimension: int, parts: int = PARTS) -> list[int]:
    """Where the parts begin and end; equal ones if ``parts`` divides the dimension, else ones that differ by a component."""
    return [p * dimension // parts for p in range(parts + 1)]


def squares(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all parts to all entries, exact."""
    if not part.shape[1]:
        return np.zeros((len(part), len(entries)), np.int64)
    if max(np.abs(part).max(initial=0), np.abs(entries).max(initial=0)) * part.shape[1] <= _EXACT:
        a, b = part.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(part), len(entries)), np.int64)
    for k in range(part.shape[1]):
        out += (part[:, k, None] - entries[None, :, k]) ** 2
    return out


def above(square: np.ndarray) -> np.ndarray:
    """Roots of squared distances, rounded up to single precision."""
    return np.nextafter(np.sqrt(square.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def below(square: np.ndarray) -> np.ndarray:
    """Roots of squared distances, rounded down."""
    return np.nextafter(np.sqrt(square.astype(np.float64)).astype(np.float32), np.float32(-np.inf))


def scan(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower index of equals), and bounds of the distances to it and to every other one."""
    found = squares(part, entries)
    nearest = found.argmin(1)
    rows = np.arange(len(part))
    upper = above(found[rows, nearest])
    found[rows, nearest] = np.iinfo(np.int64).max
    lower = below(found.min(1)) if len(entries) > 1 else np.full(len(part), np.inf, np.float32)
    return nearest.astype(np.uint8), upper, lower


def moves(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry moved at most, and for each the farthest move of any other."""
    own = above(((new - old) ** 2).sum(1))
    own[(new == old).all(1)] = 0
    other = np.zeros_like(own)
    if len(own) > 1:
        order = np.argsort(own)
        other[:] = own[order[-1]]
        other[order[-1]] = own[order[-2]]
    return own, other


def renew(part: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> int:
    """Bring code and bounds, in place, from the old entries to the new ones; the number of parts that took a full scan."""
    own, other = moves(old, new)
    up, down = np.float32(np.inf), np.float32(-np.inf)
    upper[:] = np.where(own[code] > 0, np.nextafter(upper + own[code], up), upper)
    lower[:] = np.where(other[code] > 0, np.nextafter(lower - other[code], down), lower)
    open_ = np.flatnonzero(~(upper < lower))
    upper[open_] = above(((part[open_] - new[code[open_]]) ** 2).sum(1))
    open_ = open_[~(upper[open_] < lower[open_])]
    for a in range(0, len(open_), ROWS):
        some = open_[a : a + ROWS]
        code[some], upper[some], lower[some] = scan(part[some], new)
    return len(open_)


def integers(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) of the vectors of that dimension whose components are all finite, and which rows they are."""
    n = len(column)
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    x = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    size = np.diff(offsets)
    whole = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    fine = (size == dimension) & (whole[offsets[1:]] == whole[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.arange(n)[fine]
    found = x[offsets[:-1][fine][:, None] + np.arange(dimension)] if len(rows) else np.zeros((0, dimension))
    return np.clip(np.floor(SCALE * found), -LARGEST, LARGEST).astype(np.int64), rows


def _arrays(batch: pa.RecordBatch, at: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Components, codes and bounds of a batch of the state."""

    def plain(name: str, kind, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(batch[name].to_pylist()), kind).reshape(batch.num_rows, width).copy()

    parts = len(at) - 1
    return plain("v", np.int32, at[-1]).astype(np.int64), plain("code", np.uint8, parts), plain("upper", np.float32, parts), plain("lower", np.float32, parts)


def _binaries(x: np.ndarray) -> pa.Array:
    """A row of bytes for each row of numbers."""
    x = np.ascontiguousarray(x)
    width = x.itemsize * (x.shape[1] if x.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def _first(codebooks: list[np.ndarray], at: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                v, rows = integers(pa.concat_arrays([batch["embedding"]]), at[-1])
                code, upper, lower = np.zeros((len(v), len(at) - 1), np.uint8), *(np.zeros((len(v), len(at) - 1), np.float32) for _ in range(2))
                for p, entries in enumerate(codebooks):
                    code[:, p], upper[:, p], lower[:, p] = scan(v[:, at[p] : at[p + 1]], entries)
                kept = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch["vec_id"].take(kept), batch["label"].take(kept), *map(_binaries, (v.astype(np.int32), code, upper, lower))], names=["vec_id", "label", "v", "code", "upper", "lower"])

    return thrifty(run)


def _again(old: list[np.ndarray], new: list[np.ndarray], at: list[int], last: bool):
    """The state after the entries moved; of the last one the codes in hex and the errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                v, code, upper, lower = _arrays(batch, at)
                error = np.zeros(len(v), np.int64)
                for p in range(len(at) - 1):
                    part = v[:, at[p] : at[p + 1]]
                    own = [np.ascontiguousarray(x[:, p]) for x in (code, upper, lower)]
                    renew(part, *own, old[p], new[p])
                    code[:, p], upper[:, p], lower[:, p] = own
                    if last:
                        error += ((part - new[p][own[0]]) ** 2).sum(1)
                if last:
                    yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["v"], *map(_binaries, (code, upper, lower))], names=["vec_id", "label", "v", "code", "upper", "lower"])

    return thrifty(run)


def _sums(entries: int, at: list[int]):
    """Of a partition, for each part and entry: how many parts it has, and their sum by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((at[-1], entries), np.int64), np.zeros((len(at) - 1, entries), np.int64)
        for batch in batches:
            v, code, *_ = _arrays(batch, at)
            for p in range(len(at) - 1):
                counts[p] += np.bincount(code[:, p], minlength=entries)
                for k in range(at[p], at[p + 1]):
                    sums[k] += np.bincount(code[:, p], v[:, k], entries).astype(np.int64)  # of a batch: exact in doubles
        p, e = np.nonzero(counts)
        found = [sums[at[i] : at[i + 1], j].tolist() for i, j in zip(p, e)]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(found, pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return thrifty(run)


def moved(state: DataFrame, codebooks: list[np.ndarray], at: list[int]) -> list[np.ndarray]:
    """Each entry as the floor of the mean of its parts, by exact sums; one without parts stays."""
    per_task = state.mapInArrow(_sums(len(codebooks[0]), at), "part int, entry int, n bigint, sums array<bigint>")
    exact = "decimal(38,0)"
    flat = per_task.select("part", "entry", "n", F.posexplode_outer("sums").alias("k", "x"))
    rows = flat.groupBy("part", "entry", "k").agg(F.sum(F.col("n").cast(exact)).alias("n"), F.sum(F.col("x").cast(exact)).alias("x")).collect()  # a row for each number of the codebooks
    out = [c.copy() for c in codebooks]
    for r in rows:
        if r.k is not None:
            out[r.part][r.entry, r.k] = int(r.x) // int(r.n)
    return out


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per vector: vec_id, code (two hex digits a part), error, label_error (summed over equal labels), codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped, and so are those of another dimension than the
    first kept vector's (by vec_id, nulls last; repeated ids by their components), and empty ones. Components beyond 2**18
    count as that. Where the dimension is no multiple of ``parts``, parts differ by one component. Fewer vectors than
    ``entries`` make smaller codebooks; rows of one id are vectors each on its own; null labels are one label; an empty table
    gives an empty one; extra columns are ignored. A round's state is written, so no vector is read from the input twice.
    """
    if rounds < 1:
        raise ValueError("at least one round")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    fine = rows.where(F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(False)) & (F.size("embedding") > 0))
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = fine.orderBy(*order).select("embedding").limit(1).collect()
    label = rows.schema["label"].dataType.simpleString()
    if not first:
        return rows.limit(0).selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    dimension = len(first[0].embedding)
    at = cuts(dimension, parts)
    start = [r.embedding for r in fine.where(F.size("embedding") == dimension).orderBy(*order).select("embedding").limit(entries).collect()]
    seeds, _ = integers(pa.array(start, pa.list_(pa.float64())), dimension)
    codebooks = [seeds[:, at[p] : at[p + 1]] for p in range(parts)]
    kept = f"vec_id bigint, label {label}, v binary, code binary, upper binary, lower binary"
    state = materialise(rows.mapInArrow(_first(codebooks, at), kept), "codes", compression="zstd")
    for turn in range(rounds):
        new = moved(state, codebooks, at)
        last = turn == rounds - 1
        after = state.mapInArrow(_again(codebooks, new, at, last), f"vec_id bigint, label {label}, code string, error bigint" if last else kept)
        before, state, codebooks = state, materialise(after, "codes", compression="zstd"), new
        drop(before)
    said = ",".join(str(x) for c in codebooks for entry in c.tolist() for x in entry)
    totals = materialise(state.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label_errors")
    if totals.count() <= SENT:
        totals = F.broadcast(totals)
    joined = state.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(said.encode()).hexdigest()).alias("codebooks_sha256"))
