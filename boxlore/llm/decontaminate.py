"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` cuts the documents into shards and stores each shard's token postings (term, then word position).
Searches intersect the offset-adjusted posting lists of a phrase from its rarest term on, and find every exact phrase match
and every proximity match. How rare a term is follows from the whole index, and phrases are listed under their rarest
term: a shard looks its own terms up, so it only meets phrases whose rarest term it has, and equal phrases once. The
phrases go to the tasks in blocks of a bounded number of bytes, one pass over the stored index for each, so that neither
the driver nor a worker ever holds more than one block. No key gathers rows, and a lost executor repeats only the shards
of its own tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textops import ALNUM, Words, blocks, pieces, text_of, thrifty

#: Bytes of text in a shard, about: its postings are small objects for the JVM too, which writes and reads them.
SHARD_BYTES = 1 << 18
#: How an index is written: its columns are no dictionary's, and row groups are small.
INDEX_OPTIONS = {"parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false"}
#: Bytes of item texts that are searched for in one pass.
QUERY_BYTES = 4 << 20
#: Words that the parts of a long document share, and so the longest span that a match may take.
REACH = 256
#: Words by which a proximity match may be longer than its window.
SLOP = 2

INDEX_SCHEMA = "rows array<bigint>, doc_ids array<bigint>, firsts array<bigint>, n_words array<bigint>, held array<bigint>, terms binary, starts binary, positions binary"


@dataclass
class Shard:
    """Documents, or a part of a long one: the number and id of each, its first word there, how many words the shard adds to those
    of the parts before, how many it holds, and the postings."""

    rows: np.ndarray
    doc_ids: list
    firsts: np.ndarray
    n_words: np.ndarray
    held: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    positions: np.ndarray

    def base(self) -> np.ndarray:
        """The position of each document's first word."""
        return np.concatenate([[0], np.cumsum(self.held)])


def _shard(words: Words, rows: np.ndarray, doc_ids: list, firsts: np.ndarray, skip: int = 0) -> Shard:
    hashes = words.hashes()
    order = np.argsort(hashes, kind="stable")  # words stand in order of their positions
    hashes = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return Shard(rows, doc_ids, firsts, words.count - skip, words.count, hashes[starts], np.append(starts, len(hashes)).astype(np.int64), order)


def shards(block: pa.RecordBatch, number: int = 0, limit: int = SHARD_BYTES) -> Iterator[Shard]:
    """The shards of a block of rows (id, text), whose rows are numbered from ``number``; a long row's parts overlap by REACH words."""
    data, offsets = text_of(block.column("text"))
    ids = block.column("id").to_pylist()
    if block.num_rows > 1 or len(data) <= limit:
        words = Words(data, offsets, ALNUM)
        yield _shard(words, np.arange(number, number + len(ids)), ids, np.zeros(len(ids), np.int64))
        return
    begin = skip = first = 0
    for _, end in pieces(data, ALNUM, limit):
        words = Words(data[begin:end], np.array([0, end - begin]), ALNUM)
        yield _shard(words, np.array([number]), ids, np.array([first]), skip)
        keep = words.starts[-REACH + 1 :]
        first += int(words.count[0]) - len(keep)
        skip = len(keep)
        begin = begin + int(keep[0]) if skip else end


def build_index(docs: DataFrame, id_column: str = "doc_id", limit: int = SHARD_BYTES) -> DataFrame:
    """One row per shard of about ``limit`` bytes of text. Rows are numbered by task, so read an index only after it is written.

    Words are runs of digits, letters and non-ASCII characters, with A-Z lower-cased. A null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        names = ("rows", "doc_ids", "firsts", "n_words", "held", "terms", "starts", "positions")
        for block in blocks(batches, limit=limit):
            for s in shards(block, number, limit):
                lists = [pa.array([list(x)], pa.list_(pa.int64())) for x in (s.rows, s.doc_ids, s.firsts, s.n_words, s.held)]
                small = np.uint16 if len(s.positions) <= 1 << 16 else np.int32
                binary = [pa.array([x.tobytes()], pa.binary()) for x in (s.terms, s.starts.astype(np.int32), s.positions.astype(small))]
                yield pa.RecordBatch.from_arrays(lists + binary, names=names)
            number += block.num_rows

    return _texts(docs, id_column).mapInArrow(thrifty(run), INDEX_SCHEMA)


def _texts(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of an index, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            lists = [batch.column(c)[k].as_py() for c in ("rows", "doc_ids", "firsts", "n_words", "held")]
            terms, starts = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("terms", np.uint64), ("starts", np.int32)))
            positions = np.frombuffer(batch.column("positions")[k].as_buffer(), np.uint16 if starts[-1] <= 1 << 16 else np.int32)
            yield Shard(np.array(lists[0]), lists[1], *(np.array(x, np.int64) for x in lists[2:]), terms, starts.astype(np.int64), positions.astype(np.int64))


class Owners:
    """Which items have each of some rows: numbers of items, listed by row."""

    def __init__(self, rows: np.ndarray, items: np.ndarray, n: int):
        pair = np.unique(rows.astype(np.int64) << 32 | items)
        self.ptr, self.items = np.searchsorted(pair >> 32, np.arange(n + 1)), pair & 0xFFFFFFFF

    def spread(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, item): for each of the rows asked for, its place among them with each of its items."""
        sizes = (self.ptr[1:] - self.ptr[:-1])[rows]
        which = np.repeat(np.arange(len(rows)), sizes)
        return which, self.items[np.repeat(self.ptr[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(which))]


@dataclass
class Group:
    """Different rows of term numbers, -1 beyond their end, listed under their rarest term; ``order`` has a row's places from the
    rarest term on, ``length`` its words."""

    terms: np.ndarray
    length: np.ndarray
    owners: Owners
    order: np.ndarray
    ptr: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, terms: np.ndarray, length: np.ndarray, item: np.ndarray, rank: np.ndarray) -> Group:
        """``rank``: of each term, 0 for the rarest."""
        whole = np.ascontiguousarray(np.column_stack([terms, length]).astype(np.int32))
        _, first, number = np.unique(whole.view(f"V{whole.shape[1] * 4}").ravel(), return_index=True, return_inverse=True)
        terms, length = terms[first], length[first]
        order = np.argsort(np.append(rank, len(rank))[terms], axis=1, kind="stable").astype(np.int16)
        rarest = terms[np.arange(len(terms)), order[:, 0]] if len(terms) else np.zeros(0, np.int32)
        return cls(terms, length, Owners(number, item, len(first)), order, np.concatenate([[0], np.cumsum(np.bincount(rarest, minlength=len(rank)))]), np.argsort(rarest, kind="stable"))


@dataclass
class Phrases:
    """Windows of items: as they are written for exact matches, and as sets of terms for those by proximity."""

    vocabulary: np.ndarray  # sorted term hashes
    counts: np.ndarray  # how often each stands in the windows
    windows: Group
    sets: Group | None
    item_ids: list


def phrases_of(items: list[tuple[str | None, str]], window: int, totals=None, near: bool = False) -> Phrases:
    """All windows of ``window`` consecutive words of the items; a shorter item that has words is one phrase.

    ``totals`` tells for sorted term hashes how often each occurs where is searched, for their ranks; without it they are ranked by
    how often the windows have them.
    """
    words = Words(*text_of(pa.array([x for _, x in items], pa.large_string())), ALNUM)
    many = np.where(words.count > 0, np.maximum(words.count - window + 1, 1), 0)
    item = np.repeat(np.arange(len(items), dtype=np.int32), many)
    start = words.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    length = np.minimum(words.count[item], window).astype(np.int32)
    vocabulary, number = np.unique(words.hashes(), return_inverse=True)
    number = np.append(number, -1).astype(np.int32)
    inner = np.arange(window)
    terms = number[np.where(inner < length[:, None], start[:, None] + inner, len(number) - 1)] if len(item) else np.zeros((0, window), np.int32)
    counts = np.bincount(number[:-1], minlength=len(vocabulary))
    rank = np.empty(len(vocabulary), np.int32)
    rank[np.lexsort((vocabulary, counts if totals is None else totals(vocabulary)))] = np.arange(len(vocabulary), dtype=np.int32)
    sets = None
    if near:
        found = np.sort(terms, axis=1)[:, ::-1].copy()
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        sets = Group.of(np.sort(found, axis=1)[:, ::-1].copy(), length, item, rank)
    return Phrases(vocabulary, counts, Group.of(terms, length, item, rank), sets, [i for i, _ in items])


#: Occurrences of rarest terms that are tried at once.
CANDIDATES = 1 << 18


def _candidates(s: Shard, g: Group, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, position) of each occurrence of the rarest term of rows all of whose terms the shard has, some at a time."""
    here = np.flatnonzero(at[:-1] >= 0)
    sizes = g.ptr[here + 1] - g.ptr[here]
    alive = g.rows[np.repeat(g.ptr[here] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
    for k in range(1, g.terms.shape[1]):
        term = g.terms[alive, g.order[alive, k]]
        alive = alive[(term < 0) | (at[term] >= 0)]
    rare = at[g.terms[alive, g.order[alive, 0]]]
    lists = s.starts[rare + 1] - s.starts[rare]
    ends = np.cumsum(lists)
    low = 0
    while low < len(alive):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - lists[low] + CANDIDATES, "right")))
        part = lists[low:high]
        which = np.repeat(np.arange(low, high), part)
        yield alive[which], s.positions[s.starts[rare[which]] + np.arange(len(which)) - np.repeat(np.cumsum(part) - part, part)]
        low = high


def _exact(s: Shard, g: Group, at: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    base, last = s.base(), len(key) - 1
    for row, seen in _candidates(s, g, at):
        begin = seen - g.order[row, 0]
        for k in range(1, g.terms.shape[1]):
            offset = g.order[row, k]
            term = g.terms[row, offset]
            want = (at[term] << 32) + begin + offset
            keep = (term < 0) | (key[np.minimum(np.searchsorted(key, want), last)] == want)
            row, begin = row[keep], begin[keep]
        doc = np.searchsorted(base, begin, "right") - 1
        keep = (begin >= 0) & (begin + g.length[row] <= base[np.minimum(doc + 1, len(base) - 1)])  # positions of documents adjoin
        yield row[keep], begin[keep]


def _near(s: Shard, g: Group, at: np.ndarray, key: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    base, last = s.base(), len(key) - 1
    for row, seen in _candidates(s, g, at):
        doc = np.searchsorted(base, seen, "right") - 1
        low, high, long = base[doc], base[doc + 1], g.length[row].astype(np.int64) + slop

        def next_of(k: int, some: np.ndarray, first: np.ndarray) -> np.ndarray:
            """Where the k-th rarest term of some rows next occurs from there on; where a row has none, there."""
            term = g.terms[row[some], g.order[row[some], k]]
            spot = key[np.minimum(np.searchsorted(key, (at[term] << 32) + first), last)]
            beyond = (spot >> 32 != at[term]) | ((spot & 0xFFFFFFFF) < first)
            return np.where(term < 0, first, np.where(beyond, np.iinfo(np.int64).max >> 1, spot & 0xFFFFFFFF))

        every = np.arange(len(row))
        for k in range(1, g.terms.shape[1]):  # near enough on either side
            keep = next_of(k, every, np.maximum(low, seen - long + 1)[every]) < np.minimum(high, seen + long)[every]
            every = every[keep]
        # a run begins where it may at the earliest, and then as far on as the term that is missing from it asks for
        held, begin, todo = np.zeros(len(row), bool), np.maximum(low, seen - long + 1), every
        while len(todo):
            reach = begin[todo].copy()
            for k in range(1, g.terms.shape[1]):
                reach = np.maximum(reach, next_of(k, todo, begin[todo]))
            good = (reach < begin[todo] + long[todo]) & (reach < high[todo]) & (seen[todo] < begin[todo] + long[todo])
            held[todo[good]] = True
            begin[todo] = np.maximum(begin[todo] + 1, reach - long[todo] + 1)  # no earlier run reaches that term
            todo = todo[~good & (reach < high[todo]) & (begin[todo] <= seen[todo])]
        yield row[held], seen[held]


def intersect(s: Shard, q: Phrases, slop: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(window, position of its first word) of each exact match], by posting lists joined from the rarest term on; with ``slop``
    also (set, position of its rarest term) of each proximity match: some run of at most ``slop`` more words than the
    phrase has, in one document, holds all its terms, in any order."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(s.terms) or not len(q.vocabulary):
        return [nothing] * (1 if slop is None else 2)
    spot = np.minimum(np.searchsorted(q.vocabulary, s.terms), len(q.vocabulary) - 1)
    mine = np.flatnonzero(q.vocabulary[spot] == s.terms)
    at = np.full(len(q.vocabulary) + 1, -1, np.int64)  # where the shard has each term; the last for none
    at[spot[mine]] = mine
    key = np.repeat(np.arange(len(s.terms), dtype=np.int64) << 32, np.diff(s.starts)) + s.positions
    found = [_exact(s, q.windows, at, key)] + ([] if slop is None else [_near(s, q.sets, at, key, slop)])
    return [tuple(np.concatenate(x) for x in zip(nothing, *parts)) for parts in found]


def _query_blocks(items: DataFrame, window: int, query_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items, in blocks of about ``query_bytes`` of text; a longer item is cut where no window is lost."""
    if window > REACH:
        raise ValueError(f"a window has at most {REACH} words")
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        begin = 0
        for _, end in pieces(data, ALNUM, query_bytes) if len(data) > query_bytes else [(0, len(data))]:
            part = data[begin:end]
            held.append((r.item_id, part.tobytes().decode()))
            size += len(part)
            if end < len(data):
                back = Words(part, np.array([0, len(part)]), ALNUM).starts[-window + 1 :] if window > 1 else []
                begin = begin + int(back[0]) if len(back) else end
            if size >= query_bytes:
                yield held
                held, size = [], 0
    if held:
        yield held


def occurrences(index: DataFrame):
    """A function of sorted term hashes: how often each occurs in the index. Only the terms asked for are counted, in the tasks."""

    def totals(vocabulary: np.ndarray) -> np.ndarray:
        sent = index.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(sent.value), np.int64)
            for batch in batches:
                for terms, starts in zip(batch["terms"], batch["starts"]):
                    terms, starts = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(starts.as_buffer(), np.int32)
                    spot = np.minimum(np.searchsorted(sent.value, terms), len(sent.value) - 1)
                    mine = sent.value[spot] == terms
                    total[spot[mine]] += np.diff(starts)[mine]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["term", "n"])

        out = np.zeros(len(vocabulary), np.int64)
        if len(vocabulary):
            found = index.select("terms", "starts").mapInArrow(thrifty(run), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
            out[found["term"].to_numpy()] = found["n"].to_numpy()
        sent.destroy()
        return out

    return totals


def _passes(index: DataFrame, items: DataFrame, window: int, query_bytes: int, near: bool, find, schema: str) -> DataFrame:
    """``find`` of every shard and every block of phrases: a job over the index for each block, which is given up after it."""
    spark, out, totals = index.sparkSession, None, occurrences(index)
    for block in _query_blocks(items, window, query_bytes):
        sent = spark.sparkContext.broadcast(phrases_of(block, window, totals, near))
        found = materialise(index.mapInArrow(thrifty(lambda batches, sent=sent: find(sent.value, batches)), schema), "found")
        sent.destroy()
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out


def search(index: DataFrame, items: DataFrame, window: int = 10, slop: int | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(doc_id, item_id, position, n_words): every match of a window of an item; position counts a document's words from 0.

    With ``slop`` the proximity matches, each at its rarest term in the index. No match crosses documents. A null doc_id or
    item_id is null here too. Terms' counts take a job over a stored index, so read one that is written.
    """
    if slop is not None and window + slop > REACH:
        raise ValueError(f"a match spans at most {REACH} words")

    def find(q: Phrases, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _read(batches):
            group = q.windows if slop is None else q.sets
            phrase, begin = intersect(s, q, slop)[-1]
            which, item = group.owners.spread(phrase)
            phrase, begin, base = phrase[which], begin[which], s.base()
            doc = np.searchsorted(base, begin, "right") - 1
            columns = [pa.array([s.doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array([q.item_ids[i] for i in item.tolist()], pa.string()), pa.array(begin - base[doc] + s.firsts[doc], pa.int64()), pa.array(group.length[phrase].astype(np.int64)), pa.array(s.rows[doc])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "position", "n_words", "row"])

    kind = items.schema["item_id"].dataType
    found = _passes(index, items, window, query_bytes, slop is not None, find, "doc_id bigint, item_id string, position bigint, n_words bigint, row bigint")
    return found.distinct().select("doc_id", F.col("item_id").cast(kind).alias("item_id"), "position", "n_words")


def _merged(spans: np.ndarray) -> np.ndarray:
    """Rows of [first, after the last], as runs that do not overlap or adjoin."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    end = np.maximum.accumulate(spans[:, 1]) if len(spans) else spans[:, 1]
    new = np.concatenate([[True], spans[1:, 0] > end[:-1]]) if len(spans) else np.zeros(0, bool)
    return np.stack([spans[new, 0], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], 1) if len(spans) else spans


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = SLOP, query_bytes: int = QUERY_BYTES, limit: int = SHARD_BYTES) -> DataFrame:
    """Per document: how many of its words lie in a window of a benchmark item, and of which items.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with a proximity match: all words of a
    window within ``slop`` more words than it has, in any order; exact matches are such too), and hit_spans (array of
    [first word, word after the last]) of the covered runs. Null or empty texts have no words and are clean; a null doc_id
    stays null and a repeated doc_id gives a row each time; an empty item matches nothing; items with one id count once,
    and so do all items without an id, which count but have no id to list. Extra columns are ignored. Documents of any
    length are searched whole, and any number of items, a pass over the stored index for each block of ``query_bytes``.
    """
    index = materialise(build_index(docs, limit=limit), "index", **INDEX_OPTIONS)

    def find(q: Phrases, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _read(batches):
            base = s.base()
            spans: dict[int, np.ndarray] = {}
            named: list[dict[int, set]] = [{}, {}]
            for (phrase, begin), names, group in zip(intersect(s, q, slop), named, (q.windows, q.sets)):
                doc = np.searchsorted(base, begin, "right") - 1
                once = np.unique(doc << 32 | phrase)
                which, item = group.owners.spread(once & 0xFFFFFFFF)
                pair = np.unique((once >> 32)[which] * len(q.item_ids) + item)
                for d, i in zip((pair // len(q.item_ids)).tolist(), (pair % len(q.item_ids)).tolist()):
                    names.setdefault(d, set()).add(q.item_ids[i])
                if names is named[0]:
                    for d in names:
                        here = doc == d
                        first = begin[here] - base[d] + s.firsts[d]
                        spans[d] = _merged(np.stack([first, first + q.windows.length[phrase[here]]], 1))
            some = sorted(named[1])
            columns = [pa.array(s.rows[some], pa.int64()) if some else pa.array([], pa.int64()), pa.array([list(named[0].get(d, ())) for d in some], pa.list_(pa.string())), pa.array([list(named[1][d]) for d in some], pa.list_(pa.string()))]
            columns.append(pa.array([spans[d].tolist() if d in spans else [] for d in some], pa.list_(pa.list_(pa.int64()))))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "items", "near", "spans"])

    found = _passes(index, items, window, query_bytes, True, find, "row bigint, items array<string>, near array<string>, spans array<array<bigint>>")
    every = index.select(F.explode(F.arrays_zip("rows", "doc_ids", "n_words")).alias("d")).select("d.*")
    every = every.groupBy(F.col("rows").alias("row")).agg(F.max("doc_ids").alias("doc_id"), F.sum("n_words").alias("n_words"))
    together = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    # what one document has of blocks and parts, bounded by its own length
    hits = found.groupBy("row").agg(together("items").alias("items"), together("near").alias("near"), F.flatten(F.collect_list("spans")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merged(np.array(x or [], np.int64).reshape(-1, 2)) for x in batch.column("spans").to_pylist()]
            n_hit = [int((x[:, 1] - x[:, 0]).sum()) for x in spans]
            held = [x or [] for x in batch.column("items").to_pylist()]
            sha = [hashlib.sha256(",".join(sorted(i for i in x if i is not None)).encode()).hexdigest() for x in held]
            columns = [batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in held], pa.int64()), pa.array(sha, pa.string())]
            columns += [pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array([len(x or []) for x in batch.column("near").to_pylist()], pa.int64()), pa.array([x.tolist() for x in spans], pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "hit_spans"])

    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, n_near bigint, hit_spans array<array<bigint>>"
    return every.join(hits, "row", "left").mapInArrow(finish, schema)


def _hit(block: pa.RecordBatch, q: Phrases) -> np.ndarray:
    """Which rows of a block (a column ``__text``) hold a phrase."""
    hit = np.zeros(block.num_rows, bool)
    numbered = pa.RecordBatch.from_arrays([pa.array(range(block.num_rows), pa.int64()), block.column("__text")], names=["id", "text"])
    for s in shards(numbered):
        begin = intersect(s, q)[0][1]
        hit[s.rows[np.searchsorted(s.base(), begin, "right") - 1]] = True
    return hit


def flagged(docs: DataFrame, items: DataFrame, window: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The documents with a column ``__contaminated``; every other column is carried along, and nothing is joined or shuffled.

    A row is judged by its own text, whatever its doc_id, null or repeated. Null and empty texts are clean. Shards are made
    and searched in one worker. Only where the items take more than one block are the flags, by a hash of each row's id and
    text, joined to the documents at the end.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("__contaminated", "__text", "__key1", "__key2")]
    source = docs.select(*names, F.col("text").cast("string").alias("__text"))
    queue = _query_blocks(items, window, query_bytes)
    phrases = lambda block: None if block is None else phrases_of(block, window)
    q, more = phrases(next(queue, None)), next(queue, None)
    if q is None:
        return docs.select(*names, F.lit(False).alias("__contaminated"))
    if more is None:
        sent = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, "__text"):
                yield pa.RecordBatch.from_arrays([block.column(c) for c in names] + [pa.array(_hit(block, sent.value))], names=[*names, "__contaminated"])

        return source.mapInArrow(thrifty(run), docs.select(*names).schema.add("__contaminated", "boolean"))
    key = ["__key1", "__key2"]
    keyed = source.select("*", *(F.xxhash64(F.lit(k), F.col("doc_id").isNull(), "doc_id", "__text").alias(c) for k, c in enumerate(key)))
    hits = None
    while q is not None:
        sent = spark.sparkContext.broadcast(q)

        def keys(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, "__text"):
                yield pa.RecordBatch.from_arrays([block.column(c) for c in key], names=key).filter(pa.array(_hit(block, sent.value)))

        found = materialise(keyed.select(*key, "__text").mapInArrow(thrifty(keys), ", ".join(f"{c} bigint" for c in key)).distinct(), "hits")
        sent.destroy()
        hits = found if hits is None else hits.unionAll(found)
        q, more = phrases(more), next(queue, None)
    return keyed.join(hits.distinct().withColumn("__contaminated", F.lit(True)), key, "left").select(*names, F.coalesce("__contaminated", F.lit(False)).alias("__contaminated"))


def is_clean(n_hit: Column, n_words: Column, share: float) -> Column:
    """Whether at most ``share`` of a document's words were hit."""
    return n_hit <= n_words * F.lit(share)
