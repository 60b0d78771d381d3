"""Personal data: high-recall generators propose overlapping spans, boosted trees choose among them.

Four base patterns (email, ip, card, phone) are always taken. Looser generators propose more: spelled-out addresses,
national telephone numbers, card-like numbers that fail the checksum, hexadecimal IPv6, secrets behind a key word.
Gradient-boosted trees judge each proposal by its format and context; a threshold per kind, set for precision on
examples that were not trained on, selects the spans. The trees are trained on a seeded set of synthetic examples, in
which formats and contexts only move the odds, so the model is the same on every table and its scores are uncertain
where format and context disagree.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, threshold_for_precision
from .textops import blocks, thrifty

#: Kinds in the order in which spans of one start are listed; the last two come from the method only.
KINDS = ("email", "ip", "card", "phone", "ipv6", "secret")
BASE = KINDS[:4]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is tried from its start only: from further inside it fails or ends in the same way
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost without overlap per kind, in code points."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end, "email"))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- proposals ----------------------------------------------------------------------------------------------------

GENERATORS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[(]at[\])]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[(]dot[\])])\s?[A-Za-z0-9-]{2,24}){1,4}")),
    ("phone", re.compile(r"(?<![0-9.+-])\(?0?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,6}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{2,7}(?![0-9])")),
    ("ipv6", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{1,4}){0,5}(?![0-9A-Fa-f:])")),
    ("secret", re.compile(r"(?i:(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key))[\x20]?[:=][\x20]?[\"']?([A-Za-z0-9_./+-]{6,})")),
)
#: Each generator's first look; a text without a match of it cannot have a proposal.
_LOOK = (re.compile(r"(?:\[|\()at(?:\]|\))"), re.compile(r"[0-9]{3}"), re.compile(r"[0-9]{4}"), re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f:]"), re.compile(r"[:=][\x20]?[\"']?[A-Za-z0-9_./+-]{6}"))

#: Fixed words whose presence near a proposal is a feature.
CONTEXT = (
    ("mail", "contact", "write", "correo", "courriel"),
    ("tel", "phone", "call", "fax", "mobile", "ruf", "llam", "appel"),
    ("card", "visa", "pay", "karte", "carte", "tarjeta", "credit"),
    ("ip", "host", "server", "addr", "ping"),
    ("password", "passwd", "pwd", "token", "secret", "key"),
    ("version", "isbn", "order", "invoice", "ref", "page", "date", "serial", "id"),
)
WINDOW = 32
#: Proposals whose features are held at once.
JUDGED = 4096


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(generator, start, end) of every generator's matches; they may overlap."""
    out = []
    for k, ((_, pattern), look) in enumerate(zip(GENERATORS, _LOOK)):
        if look.search(text):
            out.extend((k, *m.span(m.lastindex or 0)) for m in pattern.finditer(text))
    return out


def features(text: str, k: int, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - WINDOW) : start].lower(), text[end : end + WINDOW].lower()
    digits = _digits(span)
    n = len(span)
    groups = re.findall(r"[0-9]+", span)
    counts = [span.count(c) for c in set(span)]
    entropy = -sum(c / n * np.log2(c / n) for c in counts)
    return [
        k, n, len(digits), len(digits) / n, sum(c.isalpha() for c in span) / n, sum(c.isupper() for c in span) / n, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.count(" "), span.count("-"), span.count("."), span.count("("), span.count(":"), float(luhn(digits)) if digits else 0.0, entropy,
        float(bool(re.fullmatch(r"(19|20)[0-9]{2}[ ./-][0-9]{1,4}[ ./-]?[0-9]{1,4}", span))), float(len(set(digits)) <= 2), ord(before[-1]) if before else 0, ord(after[0]) if after else 0,
        *(float(any(w in before for w in words)) for words in CONTEXT), *(float(any(w in after for w in words)) for words in CONTEXT[:3]),
    ]


# ---- training -----------------------------------------------------------------------------------------------------


def _formats(rng: random.Random) -> tuple[tuple[tuple[str, float], ...], ...]:
    """Per generator: spans made from formats, each with the log-odds that such a span is personal data.

    Formats of either sign overlap in every single feature, and no format is certain: that is left to context and chance.
    """
    num = lambda n: "".join(rng.choices("0123456789", k=n))
    hexa = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    word = lambda a=2, b=9: "".join(rng.choices("abcdefghilmnoprstuvy", k=rng.randint(a, b)))
    mixed = lambda n: "".join(rng.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=n))
    sep, join, (o, c) = rng.choice("- ./"), rng.choice(("", "", " ", "-")), rng.choice(("[]", "()"))
    year = str(rng.randint(1900, 2099))
    digits = num(15)
    good = digits + next(d for d in "0123456789" if luhn(digits + d))
    wrong = good[:7] + rng.choice([d for d in "0123456789" if d != good[7]]) + good[8:]
    card = lambda d: join.join(d[k : k + 4] for k in range(0, 16, 4))
    return (
        ((f"{word()}.{num(2)}{o}at{c}{word()}{o}dot{c}{word(2, 3)}", 4), (f"{word()} {o}at{c} {word()}.{word(2, 3)}", 1.5), (f"{word()} (at) {word()} . {word(5, 10)}", -3.5), (f"{word(1, 3)} (at) {word()} . {word(2, 4)}", -1)),
        ((f"({num(3)}) {num(3)}-{num(4)}", 3.5), (f"0{num(2)}{sep}{num(4)}{sep}{num(4)}", 1), (f"{num(3)}{sep}{num(3)}{sep}{num(4)}", 1.5), (f"0{num(3)} {num(6)}", 0.5), (f"{year}-{num(4)}-{num(3)}", -3), (f"{num(3)}.{num(3)}.{num(3)}", -3), (f"{num(2)} {num(3)} {num(3)}", -2), (f"{year}/{num(4)}", -4), (f"{num(4)}.{num(4)}", -4)),
        ((card(good), 5), (good, 4.5), (card(wrong), -1.5), (wrong, -3.5), (num(14), -4), ("0" * 12 + num(4), -5), (num(19), -4)),
        ((":".join(hexa(rng.randint(1, 4)) for _ in range(8)), 4), (f"fe80::{hexa(4)}:{hexa(4)}", 3), (":".join(hexa(2) for _ in range(8)), -0.5), (":".join(hexa(2) for _ in range(6)), -3), (f"{num(2)}:{num(2)}:{num(2)}", -5), (":".join(hexa(2) for _ in range(3)), -4)),
        ((hexa(rng.choice((16, 18, 32, 40))), 6), (mixed(rng.randint(10, 40)), 5), (f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", 0.5), (word(6, 12), -4), (rng.choice(("required", "disabled", "changeme")), -4), (f"{word(3, 8)}_{word(3, 8)}", -3), (f"/{word(3, 5)}/{word()}/{word()}", -3), (f"{num(1)}.{num(2)}.{num(1)}-{word(4, 5)}", -3), (word(3, 6) + word(3, 8).title() + word(3, 8).title(), -2)),
    )


def _example(rng: random.Random) -> tuple[str, str, str, int]:
    """(before, span, after, label): a proposal in its context. Words that speak for its kind, or for a mere number, move the odds."""
    kind = rng.randrange(len(GENERATORS))
    span, odds = rng.choice(_formats(rng)[kind])
    word = lambda: "".join(rng.choices("abcdefghilmnoprstuvy", k=rng.randint(2, 9)))
    near, moved = rng.choice(((rng.choice(CONTEXT[kind]), 2.5), (word(), 0), (word(), 0), (rng.choice(CONTEXT[5]), -2.5)))
    if kind == 4:  # its key word is part of the pattern
        near, moved, before = near if moved < 0 else word(), min(moved, 0), rng.choice(CONTEXT[4]) + rng.choice(("=", ": ", ' = "'))
    else:
        before = ""
    label = rng.random() < 1 / (1 + np.exp(-odds - moved))
    return f"{word()} {near} {before}", span, rng.choice((" ", ". ", ", ", '"', "\n")) + f"{word()} {word()}", int(label)


@functools.lru_cache(1)
def model(examples: int = 12000, seed: int = 11, precision: float = 0.9) -> tuple[BoostedTrees, tuple[float, ...]]:
    """The trees and a threshold per generator; two thirds of the examples train, the others calibrate."""
    x, y = training_rows(examples, seed)
    train = np.arange(len(x)) % 3 > 0
    trees = BoostedTrees().fit(x[train], y[train])
    p = trees.predict(x[~train])
    held = x[~train][:, 0]
    return trees, tuple(threshold_for_precision(p[held == k], y[~train][held == k], precision) for k in range(len(GENERATORS)))


def training_rows(examples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the generators' proposals in seeded examples."""
    rng = random.Random(seed)
    rows, labels = [], []
    while len(rows) < examples:
        before, span, after, label = _example(rng)
        text = before + span + after
        for k, a, b in proposals(text):
            if a < len(before) + len(span) and b > len(before):
                rows.append(features(text, k, a, b))
                labels.append(label)
    return np.array(rows[:examples], float), np.array(labels[:examples], float)


# ---- selection ----------------------------------------------------------------------------------------------------


class _Disjoint:
    """Spans that do not overlap, in order."""

    def __init__(self, spans: list[tuple[int, int, str]] = ()):
        self.starts, self.ends = [], []
        for a, b, _ in spans:  # sorted; those that overlap become one
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        """Whether [a, b) overlaps none."""
        k = bisect.bisect_left(self.starts, b)
        return k == 0 or self.ends[k - 1] <= a

    def add(self, a: int, b: int) -> None:
        k = bisect.bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def find(text: str, trees: BoostedTrees, thresholds: tuple[float, ...]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans): the likeliest proposals that overlap neither a base span nor a likelier one are added."""
    base = base_spans(text)
    taken = _Disjoint(base)
    offered = [(k, a, b) for k, a, b in proposals(text) if taken.free(a, b)]
    if not offered:
        return base, base
    p = np.concatenate([trees.predict(np.array([features(text, *o) for o in offered[i : i + JUDGED]], float)) for i in range(0, len(offered), JUDGED)])
    chosen, added = list(base), _Disjoint()
    for q, (k, a, b) in sorted(zip(p.tolist(), offered), key=lambda x: (-x[0], x[1])):
        if q >= thresholds[k] and added.free(a, b):
            added.add(a, b)
            chosen.append((a, b, GENERATORS[k][0]))
    return base, sorted(chosen, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, id_column: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Per document: n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, and with ``with_text`` the redacted text.

    Offsets are code points of the whole text, ends exclusive. Null texts are empty (a null stays null when redacted);
    rows of one id each give a row; an empty table gives an empty one. Other columns are carried through ``with_text``
    unless they clash with those named here, and dropped otherwise. The model is a few kilobytes in the task's closure.
    """
    trees, thresholds = model()
    names = [f"n_{k}" for k in BASE] + ["base_sha256", "spans"]
    own = [c for c in docs.columns if c not in (*names, "redacted", "__text")] if with_text else [id_column]
    source = docs.select(*own, F.col("text").cast("string").alias("__text"))
    schema = docs.select(*own).schema.add("n_email", "long").add("n_ip", "long").add("n_card", "long").add("n_phone", "long").add("base_sha256", "string").add("spans", "string")
    if with_text:
        schema = schema.add("redacted", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "__text"):
            rows, clean = [], []
            for text in batch.column("__text").to_pylist():
                base, spans = find(text or "", trees, thresholds)
                kinds = [s[2] for s in base]
                rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
                clean.append(None if text is None else redact(text, spans))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [batch.column(c) for c in own] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(clean, pa.string())] if with_text else []), names=own + names + (["redacted"] if with_text else []))

    return source.mapInArrow(thrifty(run), schema)
