"""Language of web pages by Bayesian fusion of four kinds of evidence.

1. The text: a naive Bayes model over hashed byte trigrams, counted over all documents with a language label; its
   log-likelihood is tempered, as trigrams are far from independent.
2. The language that the markup declares, and 3. the address's suffix: how often each goes with each language, counted
   over all pages (weighted by what the text alone says) and smoothed.
4. A prior of the page's host, smoothed hierarchically: the host's counts are added to its domain's prior, those to its
   suffix's, those to the whole table's. A page's own share is taken out of its host's counts, so that its text is not
   counted twice. All counts are grouped aggregations with map-side sums.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textops import BLOCK_BYTES, LOWER, blocks, mix, text_of, thrifty

BUCKETS = 1 << 12
#: Languages that labels may name; more are an error, as the model is sent to every task.
MOST_LANGUAGES = 200
#: Bytes of a very long page that are read at once.
PART = 1 << 19
#: Trigrams' weight as independent evidence: a text counts as at most so many.
EFFECTIVE = 40.0
#: Strength of the parent's prior at each level, and smoothing of the declared and suffix tables.
KAPPA, ALPHA = 5.0, 1.0

_DROPPED = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")
_OPENED = re.compile(r"(?i)<(script|style)\b|<!--")
_TAG = re.compile(r"<[A-Za-z/!?][^>]*(?:>|\Z)")
#: Characters that are looked at together, at a piece's end, for a character reference or the beginning of an element.
_TAIL = 1000


def visible_text(source: str | None) -> str:
    """The text of a page: scripts, styles, comments and tags are dropped, character references resolved.

    Each match is found at once, so the time is in proportion to the page. What is opened and never closed goes to the
    page's end; a ``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text.
    """
    return html.unescape(_TAG.sub(" ", _DROPPED.sub(" ", source or "")))


def _without_elements(parts: Iterable[str]) -> Iterator[str]:
    """Scripts, styles and comments dropped from a text that comes in parts."""
    held, end = "", None  # the pattern that ends the element we are in
    for part, last in _with_last(parts):
        held += part
        while True:
            if end is not None:
                found = end.search(held)
                if not found:
                    tail = held.rfind("<" if end is not _COMMENT_END else "-", max(0, len(held) - _TAIL))
                    if tail < 0:
                        held = ""
                    elif end is _COMMENT_END:
                        held = held[-2:]
                    else:
                        held = held[tail:]
                    break
                held, end = held[found.end() :], None
                continue
            found = _OPENED.search(held)
            if not found or (found.end() == len(held) and not last):
                cut = len(held) if last else max(held.rfind("<", max(0, len(held) - 8)), 0) if "<" in held[-8:] else len(held)
                yield held[:cut]
                held = held[cut:]
                break
            yield held[: found.start()] + " "
            held, end = held[found.end() :], _ELEMENT_ENDS[found[1].lower()] if found[1] else _COMMENT_END


_ELEMENT_ENDS = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
_COMMENT_END = re.compile("-->")


def _with_last(parts: Iterable[str]) -> Iterator[tuple[str, bool]]:
    before = None
    for part in parts:
        if before is not None:
            yield before, False
        before = part
    yield before or "", True


def _without_tags(parts: Iterable[str]) -> Iterator[str]:
    held, inside = "", False
    for part, last in _with_last(parts):
        held += part
        if inside:
            at = held.find(">")
            if at < 0:
                held = ""
                continue
            held, inside = held[at + 1 :], False
        at = held.rfind("<")
        if at >= 0 and held.find(">", at) < 0:
            first = _unclosed(held)
            if first is not None:  # the last tag is still open: what it holds is dropped until its end
                yield _TAG.sub(" ", held[:first]) + " "
                held, inside = "", True
                continue
        keep = len(held) if last or not held.endswith("<") else len(held) - 1
        yield _TAG.sub(" ", held[:keep])
        held = held[keep:]


def _unclosed(text: str) -> int | None:
    """Where the tag begins that is not closed in the text."""
    closed = text.rfind(">") + 1
    for found in re.finditer(r"<[A-Za-z/!?]", text[closed:]):
        return closed + found.start()
    return None


def visible_parts(parts: Iterable[str]) -> Iterator[str]:
    """``visible_text`` of a text that comes in parts, in parts."""
    held = ""
    for part, last in _with_last(_without_tags(_without_elements(parts))):
        held += part
        cut = len(held)
        if not last:
            at = held.rfind("&", max(0, len(held) - _TAIL))
            cut = at if at >= 0 else cut
        yield html.unescape(held[:cut])
        held = held[cut:]


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every byte trigram, A-Z lowered; trigrams with an ASCII byte other than a letter or space are left out."""
    low = LOWER[data].astype(np.uint64)
    plain = (low >= 97) & (low <= 122) | (low >= 128) | (low == 32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(offsets, np.arange(len(low) - 2), "right") - 1
    inside = plain[:-2] & plain[1:-1] & plain[2:] & (np.arange(len(low) - 2) + 3 <= offsets[row + 1])
    code = (low[:-2] << np.uint64(16)) | (low[1:-1] << np.uint64(8)) | low[2:]
    return row[inside], (mix(code[inside]) % np.uint64(BUCKETS)).astype(np.int64)


def _spans(n: int, limit: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of parts of n bytes that hold every trigram once: each goes on for two bytes into the next."""
    for a in range(0, max(0, n - 2), limit):
        yield a, min(n, a + limit + 2)


def _decoded(data: np.ndarray, limit: int) -> Iterator[str]:
    """A text's UTF-8 bytes as strings of about ``limit`` bytes."""
    a = 0
    while a < len(data):
        b = min(a + limit, len(data))
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        yield data[a:b].tobytes().decode()
        a = b


def likelihoods(logp: np.ndarray, texts: list[np.ndarray], limit: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihoods by language, trigrams) of pages given as UTF-8 bytes; a long one is read in parts."""
    k = len(logp)
    if len(texts) == 1 and len(texts[0]) > limit:
        ll, n, before = np.zeros((1, k)), np.zeros(1, np.int64), b""
        for part in visible_parts(_decoded(texts[0], limit)):
            before += part.encode("utf-8", "surrogatepass")
            data = np.frombuffer(before, np.uint8)
            for a, b in _spans(len(data), limit):
                _, bucket = trigrams(data[a:b], np.array([0, b - a]))
                ll += logp[:, bucket].sum(1)
                n += len(bucket)
            before = before[-2:]
        return ll, n
    row, bucket = trigrams(*text_of(pa.array([visible_text(x.tobytes().decode()) for x in texts], pa.large_string())))
    return np.stack([np.bincount(row, logp[j][bucket], len(texts)) for j in range(k)], 1), np.bincount(row, minlength=len(texts))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of buckets by language) over all documents with a language and a text."""
    source = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = [r.lang for r in source.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        number = {x: k for k, x in enumerate(languages)}
        for block in blocks(batches):
            own = np.array([number[x] for x in block.column("lang").to_pylist()], np.int64)
            data, offsets = text_of(block.column("text"))
            for a, b in _spans(len(data), BLOCK_BYTES) if block.num_rows == 1 else [(0, len(data))]:
                row, bucket = trigrams(data[a:b], offsets if block.num_rows > 1 else np.array([0, b - a]))
                total += np.bincount(own[row] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])], names=["lang", "bucket", "n"])

    counts = np.ones((len(languages), BUCKETS))
    for r in source.mapInArrow(thrifty(count), "lang bigint, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():  # at most languages x BUCKETS rows
        counts[r.lang, r.bucket] += r.n
    return languages, np.log(counts / counts.sum(1, keepdims=True))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def declared_language(page: Column) -> Column:
    """The primary subtag of the html element's lang attribute, lower-cased; empty where there is none, or a ``<`` stands before it."""
    return F.lower(F.regexp_extract(F.coalesce(page, F.lit("")), r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))


def _vector_sum(column: str, k: int) -> list[Column]:
    return [F.sum(F.get(F.col(column), j)).alias(f"s{j}") for j in range(k)]


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Per page: page_id, host, declared, text_lang, lang, probability.

    text_lang is what the text alone says, lang the fused answer and probability its posterior. A null or empty page has
    no text and no declaration, a null url the empty host; such evidence is neutral. Ties go to the first language in code-point
    order. Without labelled documents lang is null; more than MOST_LANGUAGES of them raise, as the model goes to every task.
    A very long page is read in parts, whole. Rows of one id each give a row; an empty table gives an empty one. Extra
    columns are ignored.
    """
    spark = pages.sparkSession
    languages, logp = train(docs)
    k = len(languages)
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if not k:
        return source.select("page_id", host_of(F.col("url")).alias("host"), declared_language(F.col("html")).alias("declared"), *(F.lit(None).cast(t).alias(n) for n, t in (("text_lang", "string"), ("lang", "string"), ("probability", "double"))))
    sent = spark.sparkContext.broadcast(logp)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "html"):
            data, offsets = text_of(block.column("html"))
            ll, n = likelihoods(sent.value, [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            ll *= np.minimum(1, EFFECTIVE / np.maximum(n, 1))[:, None]
            p = np.exp(ll - ll.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([block.column(c) for c in ("page_id", "host", "declared")] + [pa.array(list(ll), pa.list_(pa.float64())), pa.array(list(p), pa.list_(pa.float64()))], names=["page_id", "host", "declared", "ll", "p"])

    kind = source.schema["page_id"].dataType.simpleString()
    scored = source.select("page_id", host_of(F.col("url")).alias("host"), declared_language(F.col("html")).alias("declared"), "html")
    scored = materialise(scored.mapInArrow(thrifty(likelihood), f"page_id {kind}, host string, declared string, ll array<double>, p array<double>"), "likelihoods")

    names = [f"s{j}" for j in range(k)]
    hosts = materialise(scored.groupBy("host").agg(*_vector_sum("p", k)), "hosts")
    whole = hosts.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names)).first()
    total = np.array([whole[c] for c in names])
    top = (total + 1) / (total.sum() + k)
    # declared languages are joined as a table: there may be as many as pages invent
    declared = scored.groupBy("declared").agg(*_vector_sum("p", k)).select(F.col("declared").alias("d"), F.array(*((F.log((F.col(c) + ALPHA) / F.lit(float(total[j] + ALPHA * (k + 1))))) for j, c in enumerate(names))).alias("dl"))
    suffixes = hosts.groupBy(_suffix(F.col("host")).alias("suffix")).agg(*(F.sum(c).alias(c) for c in names))
    n = lambda: sum((F.col(c) for c in names[1:]), F.col(names[0]))
    suffixes = suffixes.select(
        "suffix", F.array(*(F.log((F.col(c) + ALPHA) / F.lit(float(total[j] + ALPHA * (k + 1)))) for j, c in enumerate(names))).alias("sl"),
        F.array(*((F.col(c) + KAPPA * float(top[j])) / (n() + KAPPA) for j, c in enumerate(names))).alias("sp"),
    )
    domains = hosts.groupBy(_domain(F.col("host")).alias("domain")).agg(*(F.sum(c).alias(c) for c in names)).withColumn("suffix", _suffix(F.col("domain"))).join(suffixes, "suffix")
    domains = domains.select("domain", "sl", F.array(*((F.col(c) + KAPPA * F.get("sp", j)) / (n() + KAPPA) for j, c in enumerate(names))).alias("dp"))
    priors = hosts.withColumn("domain", _domain(F.col("host"))).join(domains, "domain").select("host", F.array(*names).alias("own"), "sl", "dp")
    x = scored.join(priors, "host").join(declared, F.col("declared") == F.col("d"))
    rest = F.aggregate("own", F.lit(0.0), lambda a, b: a + b) - 1  # a page's own share is one
    prior = [F.log(F.greatest(F.lit(1e-6), (F.get("own", j) - F.get("p", j) + KAPPA * F.get("dp", j)) / (rest + KAPPA))) for j in range(k)]
    fused = F.array(*(F.get("ll", j) + prior[j] + F.when(F.col("host") != "", F.get("sl", j)).otherwise(0.0) + F.when(F.col("declared") != "", F.get("dl", j)).otherwise(0.0) for j in range(k)))
    x = x.withColumn("fused", fused)
    best = lambda c: F.element_at(F.array(*map(F.lit, languages)), F.array_position(F.col(c), F.array_max(c)).cast("int"))
    probability = 1 / F.aggregate("fused", F.lit(0.0), lambda a, b: a + F.exp(b - F.array_max("fused")))
    return x.select("page_id", "host", "declared", best("ll").alias("text_lang"), best("fused").alias("lang"), probability.alias("probability"))
