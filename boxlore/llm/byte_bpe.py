"""Byte-level BPE over whole texts: overlapping chunks are pre-tokenised in parallel, stitched where their boundaries
resynchronise, and the pieces between the seams encoded; decoding joins the ids' raw bytes.

A cut into pre-tokens depends only on where it starts and on the text to its right. So as soon as the chunk to the left
and the chunk to the right, which starts anywhere, have one boundary in common, all their boundaries after it agree, and
the right chunk may take over there. Where two chunks have none in common, the left piece goes on over the right chunk;
from then on that document's seams are only taken where every cut of the text has a boundary (before white space that
follows something else), as nothing vouches any more for the chunk's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, WHITE, Vocabulary, compiled, read_vocabulary
from .textops import blocks, thrifty

#: Characters of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Characters before a chunk's end whose boundaries may still move when more text follows: a contraction looks at three.
_OPEN = 4
_RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def default_vocabulary() -> str:
    """The path of the many-language vocabulary among the installed public ones."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def chunks_of(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, text) of overlapping chunks; the last ends with the text, and none begins within the overlap of the last."""
    starts = list(range(0, max(len(text) - overlap, 1), chunk))
    return [(a, text[a : a + chunk + overlap]) for a in starts[:-1]] + [(starts[-1], text[starts[-1] :])]


def ends_of(pattern, text: str, last: bool) -> list[int]:
    """0 and the ends of the pre-tokens of a chunk, but for those that more text could move."""
    ends = [0, *(m.end() for m in pattern.finditer(text))]
    return ends if last else [e for e in ends if e <= len(text) - _OPEN]


def _certain(text: str, at: list[int]) -> list[int]:
    """Those places where white space follows something else."""
    return [e for e in at if 0 < e < len(text) and text[e] in WHITE_CHARACTERS and text[e - 1] not in WHITE_CHARACTERS]


WHITE_CHARACTERS = frozenset(c for c in map(chr, range(0x3001)) if compiled(rf"[{WHITE}]").match(c))


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digest(vocabulary: Vocabulary, ids: list[int]) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the decimal ids joined by commas, and of the bytes that they decode to."""
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(vocabulary.decode(ids)).hexdigest()


def _short(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(sent.value)
        for block in blocks(batches):
            yield _result([(i, *digest(vocabulary, vocabulary.encode(t))) for i, t in zip(block["doc_id"].to_pylist(), block["text"].to_pylist())])

    return thrifty(run)


def _chunked(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for key, doc_id, text in zip(block["key"].to_pylist(), block["doc_id"].to_pylist(), block["text"].to_pylist()):
                found = chunks_of(text, chunk, overlap)
                for at in range(0, len(found), 16):
                    part = found[at : at + 16]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([key] * len(part), pa.int64()), pa.array([doc_id] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int32()),
                        pa.array([a for a, _ in part], pa.int64()), pa.array([a == found[-1][0] for a, _ in part], pa.bool_()), pa.array([t for _, t in part], pa.string()),
                    ], names=["key", "doc_id", "no", "start", "last", "text"])

    return run


def _scanned(chunk: int, overlap: int):
    """Boundaries, as places in the document, where a chunk meets the one before (``head``) and the one behind (``tail``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = compiled(PATTERN)
        for block in blocks(batches):
            rows = []
            for key, no, start, last, text in zip(*(block[c].to_pylist() for c in ("key", "no", "start", "last", "text"))):
                ends = ends_of(pattern, text, last)
                head, tail = [e for e in ends if e <= overlap], [] if last else [e for e in ends if e >= chunk]
                rows.append((key, no, *([start + e for e in x] for x in (head, _certain(text, head), tail, _certain(text, tail)))))
            places = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int32(), places, places, places, places)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["key", "no", "head", "head_certain", "tail", "tail_certain"])

    return thrifty(run)


def _encoded(sent):
    """Ids of each piece, whose text is put together from its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(sent.value)
        for batch in batches:
            for key, doc_id, piece, begin, end, parts in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "piece", "begin", "end", "parts"))):
                text, reach = [], begin
                for k, part in enumerate(parts):
                    to = end if k == len(parts) - 1 else parts[k + 1]["start"]
                    to = part["start"] + len(part["text"]) if to is None else to
                    if to > reach:
                        text.append(part["text"][reach - part["start"] : to - part["start"]])
                        reach = to
                ids = np.array(vocabulary.encode("".join(text)), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([piece], pa.int32()), pa.array([ids.tobytes()], pa.binary())], names=["key", "doc_id", "piece", "ids"])

    return thrifty(run)


def _joined(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(sent.value)
        for batch in batches:
            for k in range(batch.num_rows):
                pieces = batch["pieces"][k].as_py()
                yield _result([(batch["doc_id"][k].as_py(), *digest(vocabulary, np.frombuffer(b"".join(p["ids"] for p in pieces), np.int32).tolist()))])

    return thrifty(run)


def encoded_digests(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes they decode to).

    A null text is empty and has no ids; a null doc_id keeps its row; rows of one id are encoded each on its own; an empty
    table gives an empty one; extra columns are ignored. Strings of special tokens are ordinary text. A text of one chunk is
    encoded where it is read; the chunks of longer ones are dealt out, and their pieces' ids (4 bytes a token) meet again
    by document. A single pre-token that is longer than the overlap makes the pieces that it touches one.
    """
    if chunk <= overlap or overlap <= _OPEN:
        raise ValueError("a chunk is longer than its overlap, and that longer than a contraction")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_vocabulary(spark, vocabulary or default_vocabulary()))  # under a megabyte
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fits = F.length("text") <= chunk + overlap
    short = source.where(fits).mapInArrow(_short(sent), _RESULT)
    long = source.where(~fits).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    dealt = long.mapInArrow(_chunked(chunk, overlap), "key bigint, doc_id bigint, no int, start bigint, last boolean, text string").repartition(F.col("key"), F.col("no"))
    places = "array<bigint>"
    scanned = dealt.mapInArrow(_scanned(chunk, overlap), f"key bigint, no int, head {places}, head_certain {places}, tail {places}, tail_certain {places}")
    row = Window.partitionBy("key").orderBy("no")
    first = lambda a, b: F.array_min(F.array_intersect(F.lag(a).over(row), b))
    seams = scanned.select("key", "no", first("tail", "head").alias("seam"), first("tail_certain", "head_certain").alias("certain"))
    before = Window.partitionBy("key").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lost = F.coalesce(F.max((F.col("seam").isNull() & (F.col("no") > 0)).cast("int")).over(before), F.lit(0)) == 1
    begins = seams.select("key", "no", F.when(F.col("no") == 0, F.lit(0)).when(lost, F.col("certain")).otherwise(F.col("seam")).cast("long").alias("begin"))
    pieces = begins.select("key", "no", "begin", F.max(F.when(F.col("begin").isNotNull(), F.col("no"))).over(before).alias("piece"))
    after = Window.partitionBy("key").orderBy("no").rowsBetween(1, Window.unboundedFollowing)
    pieces = pieces.select("key", "no", "piece", "begin", F.first("begin", ignorenulls=True).over(after).alias("end"))
    together = (
        dealt.join(pieces, ["key", "no"])
        .groupBy("key", "piece").agg(F.first("doc_id").alias("doc_id"), F.max("begin").alias("begin"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"))
        .select("key", "doc_id", "piece", "begin", "end", "parts")
    )
    ids = together.mapInArrow(_encoded(sent), "key bigint, doc_id bigint, piece int, ids binary")
    whole = ids.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("pieces"))
    return short.unionByName(whole.mapInArrow(_joined(sent), _RESULT))
