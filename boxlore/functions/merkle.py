"""A fingerprint of a set of rows that follows a change: a hash tree over the bits of the ids' hashes.

The value of no row is that of nothing, the value of one row is its own hash, and the value of more is the hash of the values
of those whose next bit is 0 and of those whose next bit is 1. It depends on the rows alone, not on how they are cut into
leaves, so a leaf's value can be kept beside it, and a change asks for the leaves that it touches and what is above them.
The whole-dataset hash in order of the keys stays the one to compare with other programs; this one is the engine's own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTHING = hashlib.sha256(b"").hexdigest()
LEAF_VALUE = "leaf string, n bigint, hash string"


def joined(left: tuple[int, str], right: tuple[int, str]) -> tuple[int, str]:
    """(rows, value) of two halves."""
    n = left[0] + right[0]
    if n < 2:
        return left if left[0] else right
    return n, hashlib.sha256(bytes.fromhex(left[1]) + bytes.fromhex(right[1])).hexdigest()


def value_of(places: np.ndarray, hashes: list[str], depth: int) -> tuple[int, str]:
    """(rows, value) of rows by their unsigned 64-bit places, which rise and share their first ``depth`` bits."""
    if not len(places):
        return 0, NOTHING
    if len(places) == 1:
        return 1, hashes[0]
    if depth == 64:  # different ids of one hash: in order of their own hashes
        return len(places), hashlib.sha256("".join(sorted(hashes)).encode()).hexdigest()
    middle = int(np.searchsorted(places >> np.uint64(63 - depth) & np.uint64(1), 1))
    return joined(value_of(places[:middle], hashes[:middle], depth + 1), value_of(places[middle:], hashes[middle:], depth + 1))


def leaf_values(rows: DataFrame) -> DataFrame:
    """(leaf, n, hash) of rows with a column ``leaf``, ``r`` and the first bits of xxhash64 of the id; a leaf is one group."""
    fields = sorted(c for c in rows.columns if c != "leaf")
    own = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)

    def leaf(frame: pd.DataFrame) -> pd.DataFrame:
        places = frame["place"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.lexsort((frame["own"].to_numpy().astype(str), places))
        name = frame["leaf"].iloc[0]
        n, value = value_of(places[order], frame["own"].to_numpy()[order].tolist(), len(name) - 1)
        return pd.DataFrame({"leaf": [name], "n": [n], "hash": [value]})

    return rows.select("leaf", F.xxhash64("id").alias("place"), own.alias("own")).groupBy("leaf").applyInPandas(leaf, LEAF_VALUE)


def root(leaves: list[tuple[str, int, str | None]]) -> str:
    """The value of all rows from (leaf, n, hash) of leaves that cover all hashes; a leaf without rows has none of its own."""
    level = {leaf[1:]: (n, value if n else NOTHING) for leaf, n, value in leaves}
    for depth in range(max(map(len, level), default=0), 0, -1):
        for prefix in {p[:-1] for p in level if len(p) == depth}:
            level[prefix] = joined(level.pop(prefix + "0", (0, NOTHING)), level.pop(prefix + "1", (0, NOTHING)))
    return level.get("", (0, NOTHING))[1]
