"""SimHash near-duplicates, with candidates from the pigeonring principle.

A fingerprint has 64 bits in a ring of 8 segments. If two differ in at most 3 bits, some segment starts a chain in
which the first j segments differ in at most floor(3 j / 8) bits, for every j: none in the first two, one in the first
five, two in the first seven. So of the three segments after the first two, two agree, which gives 24 keys of 32 bits
(start of the chain, and the segment left out). Fingerprints that share a key are tested against the chain's budgets,
then by the full Hamming distance, in tiles of bounded size; a tile returns a spanning forest of its links, never all
pairs. Equal fingerprints are one vertex from the start, so copies of a text cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components
from .textops import VISIBLE, blocks, pieces, text_of, thrifty

SEGMENTS, BITS = 8, 3
#: Fingerprints of one key beyond this number are dealt to tiles, pairs of parts of about this size.
TILE = 2000


def fingerprint(text: bytes | np.ndarray, width: int = 3, seed: int = 42, piece: int = 1 << 20) -> int:
    """SimHash over the XXH64 of word shingles: a bit is 1 if over half of the shingles have it. A long text is taken in pieces."""
    data = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    digest = xxhash.xxh64_intdigest
    ones, n, before = np.zeros(64, np.int64), 0, []
    for begin, end in pieces(data, VISIBLE, piece):
        words = before + data[begin:end].tobytes().lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
        if len(words) < width and (end < len(data) or not words):
            before = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        if len(words) > width:
            starts, ends = starts[: 1 - width or None], ends[width - 1 :]
        elif n == 0 or len(words) == width:
            starts, ends = starts[:1], ends[-1:]
        else:  # nothing but the last words of the piece before
            break
        for at in range(0, len(starts), 4096):
            part = [joined[a:b] for a, b in zip(starts[at : at + 4096].tolist(), ends[at : at + 4096].tolist())]
            h = np.fromiter(map(digest, part, repeat(seed)), np.uint64, len(part))
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(starts)
        before = words[1 - width :] if width > 1 else []
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", width: int = 3, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long, and the long columns ``carried``): the fingerprint of each whole text; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            data, offsets = text_of(block.column("text"))
            fp = [fingerprint(data[a:b], width) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(np.array(fp, np.uint64).view(np.int64)), *map(block.column, carried)], names=["doc_id", "fp", *carried])

    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"), *carried)
    return source.mapInArrow(thrifty(run), ", ".join(f"{c} bigint" for c in ("doc_id", "fp", *carried)))


def chain_keys(fp) -> list:
    """The 24 keys as longs: number of the key, then four segments that must agree."""

    def segment(k: int):
        return F.shiftrightunsigned(fp, 8 * (k % SEGMENTS)).bitwiseAND(F.lit(0xFF))

    keys = []
    for start in range(SEGMENTS):
        for left_out in range(3):
            parts = [start, start + 1, *(start + 2 + k for k in range(3) if k != left_out)]
            key = F.lit(3 * start + left_out).cast("long")
            for p in parts:
                key = F.shiftleft(key, 8).bitwiseOR(segment(p))
            keys.append(key)
    return keys


def _chain(x: np.ndarray, start: int, most: int = BITS) -> np.ndarray:
    """Which differences keep the chain's budgets from segment ``start`` on, the whole ring being the Hamming check."""
    turned = (x >> np.uint64(8 * start)) | (x << np.uint64((64 - 8 * start) % 64)) if start else x
    keep = np.ones(x.shape, bool)
    for j in range(1, SEGMENTS + 1):
        mask = np.uint64((1 << 8 * j) - 1)
        if (j * most) // SEGMENTS != ((j + 1) * most) // SEGMENTS or j == SEGMENTS:  # elsewhere the next budget is the same
            keep &= np.bitwise_count(turned & mask) <= (j * most) // SEGMENTS
    return keep


def forest(fp: np.ndarray, start: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within one key's rows; with ``side``, of those between rows of different sides."""
    n, out = len(fp), []
    todo = np.ones(n, bool)
    for first in range(n):
        if not todo[first]:
            continue
        todo[first] = False
        queue = [first]
        while queue:
            v = queue.pop()
            rest = np.flatnonzero(todo if side is None else todo & (side != side[v]))
            if not len(rest):
                continue
            near = rest[_chain(fp[rest] ^ fp[v], start)]
            todo[near] = False
            out.extend((v, int(x)) for x in near)
            queue.extend(near.tolist())
    return out


def links(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b): edges between the ``rep`` ids of distinct fingerprints that connect all that differ in at most 3 bits.

    nodes: fp long (distinct), rep long. Every link's ends are connected by the edges; an edge always is a link.
    """
    keyed = nodes.select("fp", "rep", F.explode(F.array(*chain_keys(F.col("fp")))).alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tile_of = lambda tile, side: F.struct(tile.alias("tile"), side.cast("int").alias("side"))
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: tile_of(F.least(j, part) * F.col("parts") + F.greatest(j, part), F.when(j == part, 2).otherwise((j < part).cast("int"))))
    tiles = F.when(F.col("parts").isNull(), F.array(tile_of(F.lit(0), F.lit(2)))).otherwise(every)
    dealt = keyed.join(hot, "key", "left").select("key", "fp", "rep", F.explode(tiles).alias("t")).select("key", "fp", "rep", "t.*")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # rows of the last run of a batch, which may go on

        def edges(key, tile_, fp, rep, side):
            cut = np.flatnonzero((key[1:] != key[:-1]) | (tile_[1:] != tile_[:-1])) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            a, b = [], []
            size = end - begin
            two = begin[size == 2]  # most runs have two rows
            for start in range(SEGMENTS):
                s = two[(key[two] >> 32) // 3 == start]
                s = s[_chain(fp[s] ^ fp[s + 1], start)]
                a.append(rep[s])
                b.append(rep[s + 1])
            for k in np.flatnonzero(size > 2):
                s = slice(begin[k], end[k])
                e = np.array(forest(fp[s], int(key[begin[k]] >> 32) // 3, None if side[begin[k]] == 2 else side[s]), np.int64).reshape(-1, 2)
                a.append(rep[s][e[:, 0]])
                b.append(rep[s][e[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "tile", "fp", "rep", "side")]
            cols[2] = cols[2].view(np.uint64)
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            at = int(last[-1]) + 1 if len(last) else 0
            held = tuple(x[at:] for x in cols)
            if at:
                yield edges(*(x[:at] for x in cols))
        if held is not None:
            yield edges(*held)

    return dealt.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(thrifty(scan), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are linked, directly or through others, share a component.

    component_id is the smallest doc_id of the component. Every text counts, whole; texts without words have fingerprint 0
    and are linked like others. Repeated doc_ids give a row each; a null doc_id keeps its row, takes part in no group and
    has a null component. An empty table gives an empty one. Extra columns are ignored.
    """
    prints = materialise(fingerprints(docs, id_column, width), "fingerprints")
    nodes = materialise(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = connected_components(links(nodes))
    roots = nodes.join(found, nodes["rep"] == found["id"], "left").select("fp", F.coalesce("component", "rep").alias("root"))
    out = prints.join(roots, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))
