"""One JSON object of any size, read by many tasks: a structural scan by ranges of bytes, and the members cut in a second pass.

Spark's text reader deals the file out at its commas, so any store and any split will do. Whether a range begins within a
string, and how deep, depends on all before it; but what a range does to either state is a function that the range alone
gives: for a beginning outside and within a string, where it ends and how much deeper. So are the commas that part the
members: in an object that is whole they lie at the range's least depth or one deeper. The functions of all ranges, some
numbers each, are composed on the driver; then every range knows its state and the number of its first member, and cuts.
Members that lie side by side are cut, sent and parsed together, some at a time; only one that lies across ranges is put
together from its pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import scratch

#: Characters of a member that tell its key, in a list of the keys.
HEAD = 4096

#: Bytes of members that are parsed together; a longer member is parsed alone.
BATCH = 1 << 16

WHITE = (9, 10, 13, 32)


@dataclass
class Range:
    """What the scan knows of a range when it begins: its order, whether in a string, the depth, and numbers of the members so far."""

    order: int
    quoted: bool = False
    depth: int = 0
    member: int = 0
    inner: int = 0


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(quoted, deeper): whether each byte lies within a string, or opens one, if the first does not; and +1 and -1 at all brackets.

    No escape reaches over the beginning, which is a comma or a file's.
    """
    quotes = np.flatnonzero(data == 34)
    slash = data == 92
    if len(quotes) and slash.any():
        plain = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))  # the last byte that is no backslash
        before = np.where(quotes > 0, plain[quotes - 1], -1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    flips = np.zeros(len(data), np.int8)
    flips[quotes] = 1
    quoted = np.cumsum(flips, dtype=np.int64) & 1 == 1
    deeper = np.zeros(len(data), np.int8)
    deeper[(data == 123) | (data == 91)] = 1
    deeper[(data == 125) | (data == 93)] = -1
    return quoted, deeper


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the text between commas; a row that is no file's first has a comma before it. There is a row for each
    comma, so the file's name is given by its hash."""
    x = spark.read.option("lineSep", ",").text(path)
    return x.select(F.xxhash64("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _names(spark: SparkSession, path: str) -> dict[int, str]:
    """The files' names by their hashes; of two that share one the order would be unknown, which raises."""
    rows = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("name")).select("name", F.xxhash64("name").alias("file")).distinct().collect()
    names = {r.file: r.name for r in rows}
    if len(names) != len(rows):
        raise ValueError(f"{path}: names of files share a hash")
    return names


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, np.ndarray]]:
    """(range, whether it begins here, bytes) of the rows as they come, with their commas."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch["file"].to_numpy(), batch["block"].to_numpy()
        edges = [0, *(np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            at = int(files[begin]), int(blocks[begin])
            first = at != last
            values = pc.binary_join_element_wise(pa.scalar(b",", pa.large_binary()), batch["value"].slice(begin, end - begin).cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
            data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[: int(pc.sum(pc.binary_length(values)).as_py())]
            yield at, first, data[1:] if first and at[1] == 0 else data
            last = at


def _least(data: np.ndarray, quoted: np.ndarray, depth: np.ndarray) -> list[int]:
    """The least depth outside strings, the commas there, those one deeper, and the solid bytes there; nothing if all is quoted."""
    text, depth = data[~quoted], depth[~quoted]
    if not len(text):
        return []
    least = int(depth.min())
    there = text[depth == least]
    return [least, int((there == 44).sum()), int((text[depth == least + 1] == 44).sum()), int((~np.isin(there, WHITE)).sum())]


def _least_of(a: list[int], b: list[int]) -> list[int]:
    """What ``_least`` gives of two texts, of both as one."""
    if not a or not b:
        return a or b
    a, b = sorted((a, b))
    same, next_ = b[0] == a[0], b[0] == a[0] + 1
    return [a[0], a[1] + same * b[1], a[2] + same * b[2] + next_ * b[1], a[3] + same * b[3]]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: whether it turns strings about, its first byte that is no white space and, if it begins outside a string and if
    within, how much deeper it ends and what ``_least`` says."""
    turned, depths, least, at, head = False, [0, 0], [[], []], None, b""

    def row():
        cells = [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([turned]), pa.array([head], pa.binary()), *(pa.array([[depths[k], *least[k]]], pa.list_(pa.int64())) for k in (0, 1))]
        return pa.RecordBatch.from_arrays(cells, names=["file", "block", "turned", "head", "outside", "inside"])

    for now, first, data in _ranges(batches):
        if first:
            if at is not None:
                yield row()
            turned, depths, least, at, head = False, [0, 0], [[], []], now, b""
        if not head:
            solid = np.flatnonzero(~np.isin(data, WHITE))
            head = data[solid[:1]].tobytes()
        if not len(data):
            continue
        quoted, deeper = _marks(data)
        for k in (0, 1):
            inside = quoted ^ (turned ^ bool(k))
            depth = depths[k] + np.cumsum(np.where(inside, 0, deeper), dtype=np.int64)
            least[k] = _least_of(least[k], _least(data, inside, depth))
            depths[k] = int(depth[-1])
        turned ^= bool(quoted[-1])
    if at is not None:
        yield row()


def _walk(batches: Iterator[pa.RecordBatch], known: dict[tuple[int, int], Range]) -> Iterator[tuple[bool, Range, np.ndarray, np.ndarray]]:
    """(whether a range begins, its state before, bytes, depth of each byte or -1 within strings) of ranges whose state is known;
    the states go on with the bytes."""
    state = None
    for at, first, data in _ranges(batches):
        if first:
            r = known[at]
            state = Range(r.order, r.quoted, r.depth, r.member, r.inner)
        quoted, deeper = _marks(data)
        quoted ^= state.quoted
        depth = state.depth + np.cumsum(np.where(quoted, 0, deeper), dtype=np.int64)
        yield first, state, data, np.where(quoted, -1, depth)
        if len(data):
            state.quoted, state.depth = bool(quoted[-1]), int(depth[-1])


def _cuts(state: Range, data: np.ndarray, depth: np.ndarray, within: int | None) -> np.ndarray:
    """Where the commas are that part members, of the object or of what its member ``within`` holds; the state counts them."""
    outer = np.flatnonzero((data == 44) & (depth == 1))
    if within is None:
        state.member += len(outer)
        return outer
    inner = np.flatnonzero((data == 44) & (depth == 2))
    inner = inner[state.member + np.searchsorted(outer, inner) == within]
    state.member += len(outer)
    state.inner += len(inner)
    return inner


def _counts(known: dict, within: int):
    """Of each range: the commas that part what the member holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for _, state, data, depth in _walk(batches, known):
            found[state.order] = found.get(state.order, 0) + len(_cuts(state, data, depth, within))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(found), list(found.values()))], names=["order", "n"])

    return run


def _pieces(known: dict, within: int | None, head: int | None, batch: int):
    """(pos, n, part, whole, raw) of ``n`` members side by side from ``pos`` on, as many as have ``batch`` bytes but one at least, or of
    one in pieces; of each no more than ``head`` characters, if given."""
    names = ["pos", "n", "part", "whole", "raw"]

    def rows(out: list) -> pa.RecordBatch:
        raws = [r[4] if head is None else r[4][: 4 * head] for r in out]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        raw = pa.array([x.decode("utf-8", "ignore" if head is not None else "strict") for x in raws], pa.string())
        return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)), raw], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opened, last = [], False, None  # bytes of the member that is open, and whether it began in this range
        for first, state, data, depth in _walk(batches, known):
            if first and last is not None:
                yield rows([(last[1], 1, last[0], False, b"".join(held))])
                held, opened = [], False
            number = state.member if within is None else state.inner
            low, high = 0, len(data)
            if within is not None:  # bytes of the member alone
                outer = np.flatnonzero((data == 44) & (depth == 1))
                low = 0 if state.member == within else int(outer[within - state.member - 1]) if state.member < within <= state.member + len(outer) else len(data)
                high = max(low, int(outer[within - state.member]) if state.member <= within < state.member + len(outer) else len(data))
            cuts, raw, out = _cuts(state, data, depth, within), data.tobytes(), []
            if len(cuts):
                out.append((number, 1, state.order, opened, b"".join([*held, raw[low : cuts[0]]])))
                held, opened, k = [], True, 0
                while k < len(cuts) - 1:
                    end = max(k + 1, int(np.searchsorted(cuts, cuts[k] + batch, "right")) - 1)
                    out.append((number + 1 + k, end - k, state.order, True, raw[cuts[k] + 1 : cuts[end]]))
                    k = end
                    if len(out) >= 4096:
                        yield rows(out)
                        out = []
                low = cuts[-1] + 1
            held.append(raw[low:high])
            last = (state.order, number + len(cuts))
            if out:
                yield rows(out)
        if last is not None:
            yield rows([(last[1], 1, last[0], False, b"".join(held))])

    return run


class JsonObject:
    """An object in a file, or in a folder of files that are one object in the order of their names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.texts = spark, _texts(spark, path)
        schema = "file bigint, block bigint, turned boolean, head binary, outside array<bigint>, inside array<bigint>"
        found, names = self.texts.mapInArrow(_summaries, schema).collect(), _names(spark, path)  # a row for each range, and for each file
        rows = sorted(found, key=lambda r: (names[r.file], r.block))
        self.known: dict[tuple[int, int], Range] = {}
        quoted, depth, member, outside = False, 0, 0, 0
        for order, r in enumerate(rows):
            self.known[(r.file, r.block)] = Range(order, quoted, depth, member)
            deeper, *low = r.inside if quoted else r.outside
            if low and depth + low[0] < 0:
                raise ValueError(f"{path}: not a whole JSON object")
            if low and depth + low[0] < 2:
                member += low[1] if depth + low[0] else low[2]
                outside += 0 if depth + low[0] else low[3]
            depth += deeper
            quoted ^= r.turned
        if quoted or depth:
            raise ValueError(f"{path}: not a whole JSON object")
        heads = [bytes(r.head) for r in rows if r.head]
        if heads[:1] != [b"{"]:
            raise ValueError(f"{path}: not a JSON object")
        if outside != 1:  # the last bracket
            raise ValueError("something follows the JSON object")
        self.last = member

    def _number(self, within: int) -> int:
        """Number what a member holds, of each range, from the commas of all before; the last one's number."""
        counts, total = {r.order: r.n for r in self.texts.mapInArrow(_counts(self.known, within), "order bigint, n bigint").collect()}, 0
        for r in sorted(self.known.values(), key=lambda r: r.order):
            r.inner = total
            total += counts.get(r.order, 0)
        return total

    def _cut(self, within: int | None, head: int | None = None, batch: int = 0) -> DataFrame:
        return self.texts.mapInArrow(_pieces(self.known, within, head, batch), "pos bigint, n bigint, part bigint, whole boolean, raw string")

    def members(self) -> DataFrame:
        """(pos, key, raw) of the object's members; a key that is there twice raises, at any depth, and so does what is no JSON. They
        are cut and parsed once and written, so that what is asked of them later, the check of their keys first, scans no text."""
        return self._members(None, self.last, r"^\s*\{", r"\}\s*$")

    def keys(self) -> dict[str, int]:
        """The members' numbers by key, of an object of few members of any size: only their heads are collected."""
        rows = _single(self._cut(None, HEAD)).select("pos", F.regexp_extract(F.regexp_replace("raw", r"^\s*\{", ""), r'^\s*("(?:[^"\\]|\\.)*")\s*:', 1).alias("key")).collect()
        return {json.loads(r.key): r.pos for r in rows if r.key}

    def value(self, key: str) -> object:
        """The value of a member that is small; the others are passed over."""
        number = self.keys()[key]
        raw = _stripped(_single(self._cut(None)), self.last, r"^\s*\{", r"\}\s*$").where(F.col("pos") == number).first().raw
        return json.loads(f"{{{raw}}}")[key]

    def within(self, key: str, kind: str = "object") -> DataFrame:
        """(pos, key, raw) of the members of the object that a member is, or (pos, raw) of the elements of a list."""
        number = self.keys()[key]
        last = self._number(number)
        bracket = ("\\{", "\\}") if kind == "object" else ("\\[", "\\]")
        opens = rf'^[\s,{{]*"(?:[^"\\]|\\.)*"\s*:\s*{bracket[0]}'
        closes = bracket[1] + (r"\s*\}\s*$" if number == self.last else r"\s*$")
        return self._members(number, last, opens, closes) if kind == "object" else self._parts(number, last, opens, closes, _list)

    def _members(self, within: int | None, last: int, opens: str, closes: str) -> DataFrame:
        found = self._parts(within, last, opens, closes, _object)
        twice = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").agg(F.min("key").alias("key")).first()
        if twice.key is not None:
            raise ValueError(f"repeated key {twice.key!r}")
        return found

    def _parts(self, within: int | None, last: int, opens: str, closes: str, kind) -> DataFrame:
        """The parts that ``kind`` parses, written; pieces of one across ranges, few, are written as they are and parsed from there."""
        path, across = scratch(self.spark, "members"), scratch(self.spark, "across")
        cut = self._cut(within, batch=BATCH)
        whole = kind(_stripped(cut, last, opens, closes), F.col("whole"))
        whole.write.parquet(path)
        held = self.spark.read.schema(whole.schema).parquet(path)
        pieces = _across(held.where("part is not null")).withColumns({"n": F.lit(1), "part": F.lit(None).cast("bigint")})
        kind(_stripped(pieces, last, opens, closes), F.lit(True)).write.parquet(across)
        return held.where("part is null").unionByName(self.spark.read.schema(whole.schema).parquet(across)).drop("part")


def _across(rows: DataFrame) -> DataFrame:
    """(pos, raw) of members from their pieces; those of one are held together."""
    return rows.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("part", "raw"))).alias("p")).select("pos", F.array_join(F.col("p.raw"), "").alias("raw"))


def _single(rows: DataFrame) -> DataFrame:
    """(pos, n, raw) of members that are cut one by one."""
    return rows.where("whole").select("pos", "n", "raw").unionByName(_across(rows.where(~F.col("whole"))).withColumn("n", F.lit(1).cast("bigint")))


def _stripped(rows: DataFrame, last: int, opens: str, closes: str) -> DataFrame:
    """The rows' texts without what opens the first member of all and closes the last; an object of none has no row."""
    whole = F.col("whole") if "whole" in rows.columns else F.lit(True)
    raw = F.when(whole & (F.col("pos") == 0), F.regexp_replace("raw", opens, "")).otherwise(F.col("raw"))
    raw = F.when(whole & (F.col("pos") + F.col("n") - 1 == last), F.regexp_replace(raw, closes, "")).otherwise(raw)
    return rows.withColumn("raw", raw).where(~(whole & (F.trim("raw", F.lit(" \t\r\n")) == "") & F.lit(last == 0)))


def _parsed(rows: DataFrame, text: Column, kind: str, whole: Column, piece: Column) -> DataFrame:
    """(pos, part, parts) of the rows: the ``n`` parts of a text, of which the parser of variants refuses repeated keys; or a piece as it
    is, whose part is told. A text is parsed in a step of its own and then exploded with ``outer``, which, though no row has no parts,
    keeps Spark from putting a filter on the parts before: so it is parsed only once."""
    checked = F.when(~F.is_variant_null(F.parse_json(text)), F.from_json(text, kind))  # ``isNotNull`` would parse nothing where no text is null
    rows = rows.select("pos", "n", F.when(~whole, F.col("part")).alias("part"), F.when(whole, checked).otherwise(piece).alias("parts"))
    good = F.when(F.size("parts") == F.col("n"), F.col("parts")).otherwise(F.raise_error(F.lit("a member that is none")).cast(kind))
    return rows.select("pos", "part", good.alias("parts"))


def _object(rows: DataFrame, whole: Column) -> DataFrame:
    """(pos, part, key, raw) of the members in each row."""
    x = _parsed(rows, F.concat(F.lit("{"), "raw", F.lit("}")), "map<string,string>", whole, F.create_map(F.lit(""), F.col("raw")))
    return x.select("pos", "part", F.posexplode_outer("parts").alias("turn", "key", "raw")).select((F.col("pos") + F.col("turn")).alias("pos"), "part", "key", "raw")


def _list(rows: DataFrame, whole: Column) -> DataFrame:
    """(pos, part, raw) of the elements in each row."""
    x = _parsed(rows, F.concat(F.lit("["), "raw", F.lit("]")), "array<string>", whole, F.array("raw"))
    return x.select("pos", "part", F.posexplode_outer("parts").alias("turn", "raw")).select((F.col("pos") + F.col("turn")).alias("pos"), "part", "raw")
