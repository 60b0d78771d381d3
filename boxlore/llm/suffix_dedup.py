"""Removal of repeated passages by an enhanced suffix array's common-prefix interval tree, distributed by anchors.

A passage counts if at least ``LENGTH`` bytes start in two places. Every window of LENGTH bytes names the smallest hash
among its grams of ``GRAMS[0]`` bytes as its anchor; equal windows name equal anchors, so windows of different anchors
never need to meet. The windows that share one anchor occurrence form a context of less than twice LENGTH bytes. Equal
contexts are counted before anything else; each anchor that occurs more than once has the bytes of its different
contexts fetched, each context once, with its count. Their suffixes, as often as their contexts occur (twice stands for
more), are grouped by their first LENGTH bytes and those groups whose left neighbours differ are suffix-sorted; a stack
scan over the common prefixes visits the interval tree and outputs each interval that left neighbours differ in, a
maximal repeat, with all its occurrences. Whatever is repeated lies in one of them.

An anchor with more than ``LIMIT`` different contexts (a very common line between other texts) is cut again by longer
grams, and at last by whole windows, which have one context each: no task ever holds an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textops import CHUNK, blocks, mix, powers, span_hashes, text_of, thrifty

LENGTH = 200
#: Bytes of an anchor's gram, by level.
GRAMS = (48, 120, 180, 200)
#: Different contexts of an anchor that are compared in one task.
LIMIT = 2000
#: Bytes of contexts that are sorted at once.
BATCH = 1 << 19
#: Window starts handled at once, whatever the text's length; a place among them fits below the hash in 64 bits.
PIECE = CHUNK - 2 * LENGTH
NO_ID = -(1 << 63)

#: A span is its first byte times two to this power, plus its length.
SPAN_BITS = 20


def anchors(data: np.ndarray, offsets: np.ndarray, gram: int, length: int = LENGTH, piece: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, anchor hash, first window, last window, context hash) of each run of windows that name one anchor, a piece of the data
    at a time; places are in ``data``. A run that goes on into the next piece gives a context in each."""
    piece = PIECE if piece is None else piece
    span = length - gram + 1
    ends = offsets[1:]
    up, down = powers()
    for begin in range(0, max(len(data) - length + 1, 0), piece):
        part = data[begin : begin + piece + length - 1]
        n = len(part) - gram + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * up[: len(part)], out=sums[1:])
        g = mix((sums[gram:] - sums[:-gram]) * down[:n])  # as span_hashes of every gram
        key = (g & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        start = np.arange(len(key)) + begin
        row = np.searchsorted(offsets, start, "right") - 1
        fits = start + length <= ends[row]
        start, row, at = start[fits], row[fits], (key[fits] & np.uint64(0xFFFFFF)).astype(np.int64)
        if len(start):
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1])])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(start)]]) - 1
            low, high = start[first] - begin, start[last] - begin + length
            ctx = mix(mix((sums[high] - sums[low]) * down[low]) ^ np.uint64(0xC0117E47))
            yield row[first], g[at[first]], start[first], start[last], ctx


def _occurrences(gram: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "bytes"):
            data, offsets = text_of(block.column("bytes"))
            names = [block.column(k).to_numpy(zero_copy_only=False) for k in ("u1", "u2", "c")]
            for row, h, first, last, ctx in anchors(data, offsets, gram, length):
                u1, u2, c = (x[row] for x in names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(u1), pa.array(u2), pa.array((first - offsets[row]).astype(np.int32)), pa.array((last - first + length).astype(np.int32)), pa.array(c)],
                    names=["h", "ctx", "u1", "u2", "lo", "n", "c"],
                )

    return run


def interval_repeats(suffixes: list[bytes], left: list[int], least: int) -> list[tuple[int, list[int]]]:
    """Maximal repeats among suffixes: (length, numbers of all suffixes that start with it), by a stack scan.

    The suffixes are sorted; each interval of neighbours with a common prefix of at least ``least`` bytes is a node of the
    interval tree, closed when the common prefix falls below its own. A node is output if its left neighbours differ;
    a negative one differs from any other.
    """
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    found = []
    stack: list[list] = []  # [common prefix, first place in order, left neighbour or None if they differ]

    def same(x, y):
        return x if x is not None and x == y and x >= 0 else None

    for place in range(1, len(order) + 1):
        common, begin = 0, place - 1
        if place < len(order):
            x, y = suffixes[order[place - 1]], suffixes[order[place]]
            common = min(len(x), len(y))
            if x[:common] != y[:common]:
                differ = np.frombuffer(x, np.uint8, common) != np.frombuffer(y, np.uint8, common)
                common = int(differ.argmax())
        side = left[order[place - 1]]
        if stack and stack[-1][0] > 0:
            stack[-1][2] = same(stack[-1][2], side)
        while stack and stack[-1][0] > common:
            length, begin, side = stack.pop()
            if side is None:
                found.append((length, order[begin:place]))
            if stack and stack[-1][0] >= max(common, least):
                stack[-1][2] = same(stack[-1][2], -1 if side is None else side)
        if common >= least and (not stack or stack[-1][0] < common):
            stack.append([common, begin, -1 if side is None else side])
    return found


def _within(keys: list[tuple[int, int]], contexts: list[bytes], copies: list[int], length: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """For each context (of anchors' whole groups; ``copies``: how often it occurs): its maximal repeats as (group, first byte, length)."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in contexts])])
    count = np.diff(offsets) - length + 1
    owner = np.repeat(np.arange(len(contexts)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[owner] + inner
    head = span_hashes(data, start, start + length)
    order = np.argsort(head, kind="stable")
    head = head[order]
    first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    size = np.diff(np.append(first, len(head)))
    weight = np.add.reduceat(np.minimum(np.array(copies), 2)[owner[order]], first)
    left = np.where(inner == 0, 300, data[np.maximum(start - 1, 0)].astype(np.int64))[order]
    low, high = np.minimum.reduceat(left, first), np.maximum.reduceat(left, first)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for k in np.flatnonzero((weight > 1) & ((low != high) | (high == 300))).tolist():
        run = [x for x in order[first[k] : first[k] + size[k]].tolist() for _ in range(min(copies[owner[x]], 2))]
        at = [(int(owner[x]), int(inner[x])) for x in run]
        sides = [-1 if i == 0 else contexts[o][i - 1] for o, i in at]
        for n, members in interval_repeats([contexts[o][i:] for o, i in at], sides, length):
            o, i = at[members[0]]
            group = int.from_bytes(hashlib.blake2b(contexts[o][i : i + n], digest_size=8).digest(), "little", signed=True)
            for o, i in {at[m] for m in members}:
                out.setdefault(o, []).append((group, i, n))
    for o, found in out.items():
        yield (*keys[o], found)


def _compare(length: int):
    def rows(keys, contexts, copies):
        found = list(_within(keys, contexts, copies, length))
        columns = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
        columns.append(pa.array([[g for g, _, _ in x[2]] for x in found], pa.list_(pa.int64())))
        columns.append(pa.array([[(a << SPAN_BITS) + n for _, a, n in x[2]] for x in found], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names=["h", "ctx", "group", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        contexts: list[bytes] = []
        copies: list[int] = []
        held = 0
        for batch in batches:
            for h, ctx, c, text in zip(*(batch.column(k).to_pylist() for k in ("h", "ctx", "c", "bytes"))):
                if keys and keys[-1] == (h, ctx):  # a repeated row of the table
                    continue
                if held >= BATCH and keys[-1][0] != h:
                    yield rows(keys, contexts, copies)
                    keys, contexts, copies, held = [], [], [], 0
                keys.append((h, ctx))
                contexts.append(text)
                copies.append(c)
                held += len(text)
        if keys:
            yield rows(keys, contexts, copies)

    return run


def repeats_in(units: DataFrame, length: int = LENGTH, level: int = 0, limit: int | None = None, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """(u1, u2, lo, group, span): maximal repeats in each unit, by context; ``lo`` is the context's first byte in the unit.

    units: u1, u2 (long, name a unit; rows with equal names are equal), c (long: how often it occurs), bytes (binary).
    group and span are arrays with an entry per repeat: a hash of its bytes; its first byte in the context and its length
    there, packed by ``SPAN_BITS``.

    What is joined by anchor is written first, so that both sides of each join are dealt by Spark itself and a partition
    with a very common anchor can be split.
    """
    limit = LIMIT if limit is None else limit
    seen = units.mapInArrow(thrifty(_occurrences(grams[level], length)), "h bigint, ctx bigint, u1 bigint, u2 bigint, lo int, n int, c bigint")
    twice = materialise(seen.groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h"), "twice")
    again = materialise(seen.join(twice, "h"), "anchors")
    contexts = materialise(again.groupBy("h", "ctx").agg(F.sum("c").alias("c"), F.min(F.struct("u1", "u2", "lo", "n")).alias("rep")).select("h", "ctx", "c", "rep.*"), "contexts")
    many = materialise(contexts.groupBy("h").agg(F.count("*").alias("m")), "many")
    asked = contexts.join(many, "h").groupBy("u1", "u2").agg(F.collect_list(F.struct("h", "ctx", "c", "m", "lo", "n")).alias("asked"))
    fetched = units.select("u1", "u2", "bytes").join(asked, ["u1", "u2"]).select("bytes", F.explode("asked").alias("r"))
    fetched = materialise(fetched.select("r.h", "r.ctx", "r.c", "r.m", F.substring("bytes", F.col("r.lo") + 1, F.col("r.n")).alias("bytes")), "fetched")
    compared = fetched.where(F.col("m") <= limit).select("h", "ctx", "c", "bytes").repartition("h").sortWithinPartitions("h", "ctx")
    verdict = compared.mapInArrow(thrifty(_compare(length)), "h bigint, ctx bigint, group array<bigint>, span array<bigint>")
    hot = fetched.where(F.col("m") > limit)
    if hot.limit(1).count():
        hot = hot.select(F.col("h").alias("u1"), F.col("ctx").alias("u2"), "c", "bytes").dropDuplicates(["u1", "u2"])
        deeper = repeats_in(materialise(hot, "hot"), length, level + 1, limit, grams)
        verdict = verdict.unionAll(deeper.select(F.col("u1").alias("h"), F.col("u2").alias("ctx"), "group", _moved().alias("span")))
    return again.select("h", "ctx", "u1", "u2", "lo").join(verdict, ["h", "ctx"]).select("u1", "u2", "lo", "group", "span")


def _moved():
    """Spans counted from the unit's first byte."""
    return F.transform("span", lambda p: p + F.shiftleft(F.col("lo").cast("long"), SPAN_BITS))


def _units(docs: DataFrame, id_column: str) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("u1"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("u2"), F.lit(1).cast("long").alias("c"), F.coalesce(text, F.lit("")).cast("binary").alias("bytes"))


def _distinct(units: DataFrame) -> DataFrame:
    """The units, those of repeated rows once, with their number in ``c``. Only if a row repeats are any texts moved, and the
    repeated ones are put together before they are."""
    repeated = materialise(units.groupBy("u1", "u2").agg(F.sum("c").alias("many")).where("many > 1"), "repeated")
    if repeated.isEmpty():
        return units
    once = units.join(repeated, ["u1", "u2"], "left_anti")
    more = units.join(repeated, ["u1", "u2"]).groupBy("u1", "u2").agg(F.first("many").alias("c"), F.first("bytes").alias("bytes"))
    return materialise(once.unionByName(more), "units")


def maximal_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id") -> DataFrame:
    """(group_id, n_bytes, doc_id, start): each maximal repeat of at least ``length`` bytes, with all its occurrences.

    A repeat is maximal within its anchor's context, so it is cut at less than twice ``length`` bytes; a longer one is
    given as several that overlap or adjoin, and their union is the whole.
    """
    found = repeats_in(_distinct(_units(docs, id_column)), length).select("u1", F.explode(F.arrays_zip("group", _moved().alias("span"))).alias("r"))
    span = F.col("r.span")
    return found.select(F.col("r.group").alias("group_id"), span.bitwiseAND((1 << SPAN_BITS) - 1).alias("n_bytes"), F.nullif("u1", F.lit(NO_ID)).alias("doc_id"), F.shiftright(span, SPAN_BITS).alias("start")).distinct()


def _runs(spans: np.ndarray) -> np.ndarray:
    """Packed spans as rows of [first byte, byte after the last] of what they cover together."""
    spans = np.sort(spans)
    x = spans >> SPAN_BITS
    y = np.maximum.accumulate(x + (spans & ((1 << SPAN_BITS) - 1)))
    new = np.concatenate([[True], x[1:] > y[:-1]]) if len(x) else np.zeros(0, bool)
    return np.stack([x[new], y[np.append(np.flatnonzero(new)[1:] - 1, len(y) - 1)]], 1) if len(x) else np.zeros((0, 2), np.int64)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Per document: what is left if each byte that a maximal repeat of at least ``length`` bytes covers is removed.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of [first byte, byte after the last]), and with
    ``with_text`` the kept bytes. Every occurrence is removed, in the same document too; spans are judged on the input.
    Null texts are empty; texts shorter than ``length`` stay whole; null doc_ids stay null; a row that occurs twice is
    repeated, so it is removed in both, and however often it occurs its text is searched once. A very long text is taken
    in pieces. An empty table gives an empty one. Extra columns are ignored.
    """
    units = _units(docs, id_column)
    found = repeats_in(_distinct(units), length)
    # of one row of each name, so a document's spans are bounded by its own length
    covered = found.groupBy("u1", "u2").agg(F.flatten(F.collect_list(_moved())).alias("spans"))
    joined = units.select("u1", "u2", "bytes").join(covered, ["u1", "u2"], "left").select("u1", "bytes", "spans")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "bytes"):
            out = []
            data, offsets = text_of(batch.column("bytes"))
            for k, u1 in enumerate(batch.column("u1").to_pylist()):
                text = data[offsets[k] : offsets[k + 1]]
                found = batch.column("spans")[k].values
                runs = _runs(found.to_numpy(zero_copy_only=False)) if found is not None else np.zeros((0, 2), np.int64)
                h, left, kept, at = hashlib.sha256(), 0, [], 0
                for x, y in [*runs.tolist(), [len(text), len(text)]]:
                    h.update(text[at:x])
                    left += x - at
                    if with_text:
                        kept.append(text[at:x].tobytes())
                    at = y
                out.append((None if u1 == NO_ID else u1, len(text), len(text) - left, len(runs), h.hexdigest(), runs.tolist(), b"".join(kept) if with_text else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    done = joined.mapInArrow(thrifty(digest), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>, kept binary")
    return done if with_text else done.drop("kept")
