"""Phrase collocations from vertical positional lists.

The texts are cut into shards, each of one language. A shard holds, for every word, the sorted list of its positions;
a piece's end leaves a gap, so that two words are neighbours just where their positions are. Occurrences of a phrase are
found from those of its first words: their positions, moved by the phrase's length, are merged with the postings of the
word behind. The length of a phrase's list is its count in the shard, and the sum over shards its frequency.

Which phrases to extend is known before any phrase is shuffled: each pass counts the occurrences of one length by a hash
of the phrase, and only phrases whose bucket reaches the least frequency are extended, if their last words' bucket does
as well. A bucket's count is never below that of its phrases, so none is lost; the lists that are left at the end are
counted exactly, by their text. No list leaves its shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialise
from .textops import CHUNK, LOWER, mix, span_hashes, thrifty

#: Longest phrase, least count of a candidate, and phrases of a language's report.
LONGEST, LEAST, REPORTED = 5, 100, 2000
#: A phrase goes if a longer one that holds it has at least so many hundredths of its count.
SHARE = 100
#: Text bytes of a shard; a shard's lists and what is made of them take some thirty times its words.
SHARD_BYTES = 12 << 20
#: Shuffled rows of a report's first cut by language and hash, so that no task sorts a language alone.
SALTS = 64
#: Words a bucket holds on average, and how many buckets there are at least and at most: a task counts in as many bytes, and an
#: eighth of that is sent to every task. With more words than both allow, buckets say less and more phrases are counted by text.
LOAD, FEWEST, MOST = 32, 1 << 12, 1 << 27
#: Buckets of a shuffled row.
SEGMENT = 1 << 12
#: Buckets for each segment that phrases are added up in, and phrases that a task adds up before it gives them on.
SEGMENT_PHRASES, HELD = 1 << 15, 1 << 21

#: Fixed values of the contract: what ends a piece, and what ends a word.
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAPS = _ENDS.copy()
_GAPS[[32, 9]] = True

_SHARD = "lang string, owned bigint, n bigint, words array<string>, ptr binary, positions binary"


class Lists:
    """Sorted positions by list: list k holds ``positions[ptr[k]:ptr[k + 1]]``."""

    def __init__(self, ptr: np.ndarray, positions: np.ndarray):
        self.ptr, self.positions = ptr, positions

    @classmethod
    def of(cls, ids: np.ndarray, positions: np.ndarray, n: int) -> Lists:
        """Lists of the positions, which rise, by id."""
        return cls(np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=n))]), positions[np.argsort(ids, kind="stable")])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """All positions in order, and the list of each; no two lists share one."""
        at = np.full(int(self.positions.max(initial=-1)) + 1, -1, np.int32)
        at[self.positions] = np.repeat(np.arange(len(self.ptr) - 1, dtype=np.int32), self.counts)
        places = np.flatnonzero(at >= 0)
        return places, at[places]


def extend(at: np.ndarray, behind: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(which, word): the occurrences at ``at``, of phrases of ``length`` words, that a word's posting goes on, and which posting.

    Two merges of sorted lists: with the postings ``behind``, and of the occurrences with themselves, as the last words of a
    longer phrase must occur in it too.
    """
    found = np.searchsorted(behind, at + length)
    hit = found < len(behind)
    hit[hit] = behind[found[hit]] == at[hit] + length
    if length > 1:  # of a single word the word behind is the last words
        hit[:-1] &= at[1:] == at[:-1] + 1
        hit[-1:] = False
    return hit, found[hit]


class _Shard:
    """Words of one language, gathered text by text."""

    def __init__(self) -> None:
        self.parts: list[tuple[pa.Array, np.ndarray]] = []
        self.bytes = self.at = 0

    def add(self, words: pa.Array, positions: np.ndarray, size: int) -> None:
        """Words and their positions from 0, which are moved behind what is there."""
        if len(positions):
            self.parts.append((words, positions + self.at))
            self.at += int(positions[-1]) + 2
        self.bytes += size

    def row(self, lang: str, owned: int | None = None) -> pa.RecordBatch:
        """``owned``: phrases that begin there or behind belong to the next shard."""
        coded = pa.chunked_array([w for w, _ in self.parts], pa.large_string()).combine_chunks()
        coded = (coded if isinstance(coded, pa.Array) else pa.concat_arrays(coded.chunks)).dictionary_encode()
        positions = np.concatenate([p for _, p in self.parts])
        lists = Lists.of(coded.indices.to_numpy(), positions, len(coded.dictionary))
        owned = int(positions[-1]) + 1 if owned is None else owned
        cells = [
            pa.array([lang], pa.string()), pa.array([owned], pa.int64()), pa.array([int((positions < owned).sum())], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string())),
            pa.array([lists.ptr.astype(np.int32).tobytes()], pa.binary()), pa.array([np.diff(lists.positions, prepend=0).astype(np.int32).tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cells, names=["lang", "owned", "n", "words", "ptr", "positions"])


def words_of(data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of one text's bytes in lower case, their positions (a piece's end leaves a gap), and where they begin."""
    gap = np.concatenate([[True], _GAPS[data], [True]])
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = turns[::2], turns[1::2]
    kept = LOWER[data[~gap[1:-1]]]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes())])
    breaks = np.concatenate([[0], np.cumsum(_ENDS[data])])
    parted = np.zeros(len(starts), np.int64)
    parted[1:] = breaks[starts[1:]] != breaks[ends[:-1]]
    return words, np.arange(len(starts)) + np.cumsum(parted), starts


def _cut(text: bytes, limit: int) -> Iterator[np.ndarray]:
    """A text in parts of about ``limit`` bytes that end at a word's end, each with the words up to LONGEST - 1 behind it."""
    data = np.frombuffer(text, np.uint8)
    at = 0
    while at < len(data):
        end = at + limit
        while end < len(data):
            gaps = np.flatnonzero(_GAPS[data[end : end + CHUNK]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += CHUNK
        end = min(end, len(data))
        yield data[at:end]
        at = end


def _sharded(limit: int):
    """Rows of shards of a partition's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Shard] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                text = text.encode()
                if len(text) <= limit:
                    shard = open_.setdefault(lang, _Shard())
                    words, positions, _ = words_of(np.frombuffer(text, np.uint8))
                    shard.add(words, positions, len(text))
                    if shard.bytes >= limit or sum(x.bytes for x in open_.values()) >= 2 * limit:
                        lang = max(open_, key=lambda x: open_[x].bytes)
                        shard = open_.pop(lang)
                        if shard.parts:
                            yield shard.row(lang)
                    continue
                yield from _long(text, limit, lang)  # a text that is longer than a shard is cut into some of its own
        for lang, shard in open_.items():
            if shard.parts:
                yield shard.row(lang)

    return thrifty(run)


def _long(text: bytes, limit: int, lang: str) -> Iterator[pa.RecordBatch]:
    """Shards of one long text: each owns the phrases that begin in it, and holds the words behind that they go on with."""
    data = np.frombuffer(text, np.uint8)
    begin = 0
    for part in _cut(text, limit):
        end = begin + len(part)
        reach, step = end, CHUNK
        while reach < len(data):  # the words behind, with at least one gap after the last
            reach, step = min(len(data), reach + step), 2 * step
            turns = np.flatnonzero(np.diff(_GAPS[data[end:reach]].astype(np.int8)) == 1)
            if len(turns) >= LONGEST:
                reach = end + int(turns[LONGEST - 1]) + 1
                break
        words, positions, starts = words_of(data[begin:reach])
        inside = int(np.searchsorted(starts, len(part)))
        if inside:
            shard = _Shard()
            keep = inside + LONGEST - 1
            shard.add(words[:keep], positions[:keep], 0)
            yield shard.row(lang, int(positions[inside - 1]) + 1)
        begin = end


class Buckets:
    """Which buckets of hashes reach the least frequency, for each length; a power of two of them."""

    def __init__(self, n: int):
        self.n, self.maps = n, {}

    def of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.n.bit_length() + 1)).astype(np.int64)

    def frequent(self, length: int, keys: np.ndarray) -> np.ndarray:
        at = self.of(keys)
        return (self.maps[length][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


class _Read:
    """A shard as its rows' words and their merged lists, and the occurrences of phrases in it."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.lang, self.owned = batch["lang"][row].as_py(), batch["owned"][row].as_py()
        self.words = batch["words"][row].values
        ptr, steps = (np.frombuffer(batch[c][row].as_buffer(), np.int32) for c in ("ptr", "positions"))
        self.at, self.ids = Lists(ptr, np.cumsum(steps, dtype=np.int64)).merged()

    def keys(self) -> np.ndarray:
        """A hash of each word of the language."""
        data = np.frombuffer(self.words.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(self.words.buffers()[1], np.int32)[self.words.offset : self.words.offset + len(self.words) + 1].astype(np.int64)
        own = np.frombuffer(self.lang.encode(), np.uint8)
        seed = span_hashes(own, np.array([0]), np.array([len(own)]))
        return mix(span_hashes(data, offsets[:-1], offsets[1:]) ^ seed)

    def chain(self, buckets: Buckets, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, at, keys, before, word) of the occurrences of each length, where the buckets leave any: their places, hashes,
        and of which occurrence of the length before and which posting each is made. Those of known buckets are cut to the
        frequent ones before they are extended."""
        behind, ids, keys = self.at, self.ids, self.keys()[self.ids]
        at, word_keys, before, word = behind, keys, np.arange(len(behind)), np.arange(len(behind))
        for length in range(1, longest + 1):
            if length > 1:
                hit, word = extend(at, behind, length - 1)
                before = np.flatnonzero(hit)
                at, keys = at[hit], mix(keys[hit] * np.uint64(0x9E3779B97F4A7C15) + word_keys[word])
            if length in buckets.maps:
                keep = buckets.frequent(length, keys)
                at, keys, before, word = at[keep], keys[keep], before[keep], word[keep]
                if length == 1:  # from now on only frequent words have postings
                    behind, word_keys, self.ids = at, keys, ids[keep]
            yield length, at, keys, before, word


def _bucketed(sent: Broadcast, length: int, least: int):
    """Of a partition, the buckets' counts of one length, no higher than the least frequency; a row for each segment that has any."""
    kind = np.uint8 if least < 1 << 7 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = sent.value
        total = np.zeros(buckets.n, kind)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = _Read(batch, row)
                for found, at, keys, _, _ in shard.chain(buckets, length):
                    if found == length:
                        places, counts = np.unique(buckets.of(keys[at < shard.owned]), return_counts=True)
                        total[places] = np.minimum(np.minimum(counts, least) + total[places], least)
        for a in range(0, buckets.n, SEGMENT):
            part = total[a : a + SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([a // SEGMENT], pa.int32()), pa.array([zlib.compress(part.astype(np.uint32).tobytes() if kind is np.uint32 else part.tobytes(), 1)], pa.binary())], names=["segment", "counts"])

    return thrifty(run), kind


def _summed(least: int, kind):
    """Which buckets of a partition's segments are frequent, a bit for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, counts in zip(batch["segment"].to_pylist(), batch["counts"].to_pylist()):
                own = np.frombuffer(zlib.decompress(counts), kind)
                held = totals.get(segment)
                totals[segment] = own.astype(np.uint32) if held is None else np.minimum(held + own, least).astype(np.uint32)
        for segment, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["segment", "bits"])

    return thrifty(run)


_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.large_string()), ("n", pa.int64())])


def _together(parts: list[pa.Table]) -> pa.Table:
    """Counts of each phrase, added up."""
    return pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"]).cast(_PHRASES)


def _packed(table: pa.Table) -> bytes:
    """In order, so that neighbours share much, and compressed."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _PHRASES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table.sort_by([("lang", "ascending"), ("phrase", "ascending")]))
    return out.getvalue().to_pybytes()


def _counted(sent: Broadcast, longest: int, segments: int):
    """Of a partition, the lengths of the lists that the buckets leave, added up by phrase: a row for each segment of the phrases."""

    def rows(held: dict[int, list[pa.Table]]) -> Iterator[pa.RecordBatch]:
        for segment, parts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([_packed(_together(parts))], pa.binary())], names=["segment", "phrases"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = sent.value
        held: dict[int, list[pa.Table]] = {}
        size = 0
        for batch in batches:
            for row in range(batch.num_rows):
                shard = _Read(batch, row)
                for spelled, counts, keys in _lengths(shard, buckets, longest):
                    segment = (keys % np.uint64(segments)).astype(np.int64)
                    order = np.argsort(segment, kind="stable")
                    ends = np.searchsorted(segment[order], np.arange(segments + 1))
                    for k in np.flatnonzero(np.diff(ends)).tolist():
                        part = pa.array(order[ends[k] : ends[k + 1]])
                        held.setdefault(k, []).append(pa.table([pa.repeat(pa.scalar(shard.lang), len(part)), spelled.take(part), pa.array(counts).take(part)], schema=_PHRASES))
                    size += len(counts)
                if size > HELD:
                    held = {k: [_together(x)] for k, x in held.items()}
                    size = sum(x[0].num_rows for x in held.values())
                if size > HELD // 2:  # more would not become less
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    return thrifty(run)


def _lengths(shard: _Read, buckets: Buckets, longest: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(phrases, lengths of their lists, hashes) of each length, of those that begin in the shard's own words."""
    number = spelled = words = word_number = None
    for length, at, keys, before, word in shard.chain(buckets, longest):
        if length == 1:
            kinds, first, number = np.unique(shard.ids, return_index=True, return_inverse=True)
            words = spelled = shard.words.cast(pa.large_string()).take(pa.array(kinds))
            word_number = number
        else:
            kinds, first, number = np.unique(number[before] * max(len(words), 1) + word_number[word], return_index=True, return_inverse=True)
            spelled = pc.binary_join_element_wise(spelled.take(pa.array(kinds // max(len(words), 1))), words.take(pa.array(kinds % max(len(words), 1))), pa.scalar(" ", pa.large_string()))
        counts = Lists.of(number[at < shard.owned], at[at < shard.owned], len(spelled)).counts
        some = np.flatnonzero(counts)
        yield spelled.take(pa.array(some)), counts[some], keys[first[some]]


def _added(least: int):
    """The frequent phrases of a partition's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}
        for batch in batches:
            for segment, phrases in zip(batch["segment"].to_pylist(), batch["phrases"]):
                own = held.setdefault(segment, [])
                own.append(pa.ipc.open_stream(phrases.as_buffer()).read_all())
                if len(own) > 64:
                    held[segment] = [_together(own)]
        for segment in list(held):
            total = _together(held.pop(segment))
            yield from total.filter(pc.field("n") >= least).rename_columns(["lang", "phrase", "f"]).cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])).to_batches(1 << 15)

    return thrifty(run)


def bucket_count(words: int) -> int:
    """A power of two of buckets for so many words."""
    return min(max(FEWEST, 1 << max(words // LOAD, 1).bit_length()), MOST)


def frequencies(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(totals, phrases): all words of each language (lang, n), and the phrases of up to ``longest`` words with at least
    ``least`` occurrences (lang, phrase, f), both as written tables."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shards = materialise(texts.mapInArrow(_sharded(shard_bytes), _SHARD), "postings", compression="zstd")
    totals = materialise(shards.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    context = docs.sparkSession.sparkContext
    buckets = Buckets(bucket_count(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    for length in range(1, longest + 1):
        sent = context.broadcast(buckets)  # no more than longest * MOST / 8 bytes
        count, kind = _bucketed(sent, length, least)
        rows = shards.mapInArrow(count, "segment int, counts binary").repartition("segment").mapInArrow(_summed(least, kind), "segment int, bits binary")
        bits = np.zeros(buckets.n // 8, np.uint8)
        for r in rows.collect():  # an eighth of a byte for each bucket
            bits[r.segment * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(r.bits, np.uint8)
        sent.unpersist()
        buckets.maps[length] = bits
    sent = context.broadcast(buckets)
    counted = shards.mapInArrow(_counted(sent, longest, max(64, buckets.n // SEGMENT_PHRASES)), "segment int, phrases binary")
    phrases = materialise(counted.repartition("segment").mapInArrow(_added(least), "lang string, phrase string, f bigint"), "phrases")
    drop(shards)
    return totals, phrases


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, reported: int = REPORTED, share: int = SHARE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per language its phrases of highest score: lang, rank, phrase, a, l, r, n, score.

    A candidate is a phrase of 2 to ``longest`` words with a >= ``least`` occurrences within pieces. Of its cuts into first
    and last words, with l and r occurrences, the one of least floor(1000 * a * n / (l * r)) counts, of equal ones the
    shortest first part. Candidates in a longer candidate with at least ``share`` hundredths of their count are dropped;
    one word more on either side shows that, as what lies between has no smaller count. Ranks go by score, a, phrase.

    Null texts are empty, a null lang is ``und``, rows of one id count each, an empty table has no rows; extra columns are
    ignored. Arithmetic is in integers of up to 38 digits.
    """
    totals, every = frequencies(docs, least, longest, shard_bytes)
    words = F.split("phrase", " ")
    numbered = materialise(every.select(F.monotonically_increasing_id().alias("id"), "lang", "phrase", "f", F.size(words).alias("size")), "numbered")  # written, so that an id stays
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    candidates = numbered.where("size > 1")
    ends = candidates.where("size > 2").select("lang", F.col("f").alias("longer"), F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"))
    longer = ends.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    inside = longer.join(candidates, ["lang", "phrase"]).where(100 * F.col("longer") >= share * F.col("f")).select("id")
    # each cut asks for the frequencies of both its parts; the answers meet by the candidate's number
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("id", "lang", "phrase", "size", cut)
    asked = cuts.select("id", "lang", "k", F.explode(F.array(F.struct(F.lit(True).alias("left"), part(F.lit(1), F.col("k")).alias("of")), F.struct(F.lit(False).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("of")))).alias("x"))
    answers = asked.select("id", "lang", "k", "x.left", F.col("x.of").alias("phrase")).join(numbered.select("lang", "phrase", "f"), ["lang", "phrase"]).select("id", "k", "left", "f")
    own = candidates.select("id", F.lit(0).alias("k"), F.lit(True).alias("left"), "f")
    gone = inside.select("id", F.lit(-1).alias("k"), F.lit(True).alias("left"), F.lit(0).cast("long").alias("f"))
    answer = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f")))
    sides = [answer(k, left).alias(f"{name}{k}") for k in range(1, longest) for name, left in (("l", True), ("r", False))]
    met = answers.unionByName(own).unionByName(gone).groupBy("id").agg(answer(0, True).alias("a"), answer(-1, True).alias("gone"), *sides).where("gone is null")
    exact = "decimal(38, 0)"
    met = met.join(candidates.select("id", "lang", "phrase"), "id").join(totals, "lang")
    score = lambda k: F.expr(f"cast(a as {exact}) * 1000 * n div (cast(l{k} as {exact}) * r{k})")
    scores = [F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    lowest = met.select("lang", "phrase", "a", "n", F.array_min(F.array_compact(F.array(*scores))).alias("x")).select("lang", "phrase", "a", "n", "x.score", "x.l", "x.r")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = lowest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= reported)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= reported)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
