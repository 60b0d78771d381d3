"""Words and their hashes over Arrow text columns, in numpy: bytes in, arrays out, no Python loop over words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: A block holds at most so many text bytes; a single longer text makes a block of its own, which operators take in pieces.
BLOCK_BYTES = 2 << 20
#: Bytes whose words or hashes are found at once, whatever the block's length.
CHUNK = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that are runs of digits, letters and any non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words that are runs of anything but ASCII white space.
VISIBLE = np.ones(256, bool)
VISIBLE[[32, *range(9, 14)]] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_TURN = 1 << 64
_POWERS: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """The first CHUNK + 1 powers of the hash base modulo 2**64, and of its inverse."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, _TURN)):
            x = np.full(CHUNK + 1, base, np.uint64)
            x[0] = 1
            _POWERS.append(np.cumprod(x, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def release() -> None:
    """Give memory that is no longer used back to the system; a Python worker waits for its next task with what it has kept."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's function that releases its memory at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column whose nulls count as empty; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``limit`` text bytes or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def pieces(data: np.ndarray, member: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of pieces of one text, of about ``limit`` bytes; no word is cut, so one that is longer makes its piece longer."""
    at = 0
    while at < len(data):
        end = at + limit
        while end < len(data):
            outside = np.flatnonzero(~member[data[end : end + CHUNK]])
            if len(outside):
                end += int(outside[0])
                break
            end += CHUNK
        end = min(end, len(data))
        yield at, end
        at = end


class Words:
    """The words of a block: ``starts`` and ``ends`` (bytes in the block), ``doc`` (row of each word), ``count`` (words by row)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        self.data, self.offsets = data, offsets
        flips, was = [], False
        for a in range(0, len(data), CHUNK):
            inside = member[data[a : a + CHUNK]]
            turn = np.flatnonzero(inside[1:] != inside[:-1]) + (a + 1)
            flips.append(turn if inside[0] == was else np.concatenate([[a], turn]))
            was = bool(inside[-1])
        turns = np.concatenate([*flips, np.array([len(data)] if was else [], np.int64)]).astype(np.int64)
        cuts = np.unique(offsets)
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        cuts = cuts[member[data[cuts - 1]] & member[data[cuts]]]  # a word of one row and one of the next adjoin
        self.starts, self.ends = (np.sort(np.concatenate([x, cuts])) if len(cuts) else x for x in (turns[::2], turns[1::2]))
        self.first = np.searchsorted(self.starts, offsets[:-1])
        self.count = np.diff(np.append(self.first, len(self.starts)))
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word's bytes, A-Z lowered."""
        return span_hashes(self.data, self.starts, self.ends, LOWER if lower else None)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans, whose starts rise and whose ends rise: a polynomial modulo 2**64 by prefix sums, scrambled.

    Sums run over chunks, so memory goes with the spans and not with the bytes. ``table`` maps bytes before they count.
    """
    up, down = powers()
    if len(data) <= CHUNK:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(((data if table is None else table[data]) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])
    at = [np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)]
    before, scale = 0, 1
    for a in range(0, len(data) + 1, CHUNK):
        part = data[a : a + CHUNK]
        if table is not None:
            part = table[part]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * up[: len(part)], out=sums[1:])
        for place, out in ((starts, at[0]), (ends, at[1])):
            x, y = np.searchsorted(place, (a, a + CHUNK))
            if a + CHUNK > len(data):
                y = len(place)
            out[x:y] = sums[place[x:y] - a] * np.uint64(scale) + np.uint64(before)
        before, scale = (before + int(sums[-1]) * scale) % _TURN, scale * int(up[CHUNK]) % _TURN
    total = at[1] - at[0]
    step, far = int(down[CHUNK]), [1]
    while len(far) <= len(data) // CHUNK:
        far.append(far[-1] * step % _TURN)
    return mix(total * down[starts % CHUNK] * np.array(far, np.uint64)[starts // CHUNK])
