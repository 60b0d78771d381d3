"""Boxes written in and read from model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .geometry import at, quantize, valid_box

# ---- fixed values: number and box notations ----
NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
OPEN, CLOSE = r"<\|box_start\|>", r"<\|box_end\|>"
GLM_OPEN, GLM_CLOSE = r"<\|begin_of_box\|>", r"<\|end_of_box\|>"

_FOUR = rf"\s*({NUMBER})\s*,\s*({NUMBER})\s*,\s*({NUMBER})\s*,\s*({NUMBER})\s*"
_PAIRS = rf"\(\s*({NUMBER})\s*,\s*({NUMBER})\s*\)\s*,\s*\(\s*({NUMBER})\s*,\s*({NUMBER})\s*\)"
_TAGGED = rf"{OPEN}\s*{_PAIRS}\s*{CLOSE}"
_BARE = rf"({NUMBER})\s*,\s*({NUMBER})\s*,\s*({NUMBER})\s*,\s*({NUMBER})"
_JSON_NUMBER = r'(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|"\s*' + NUMBER + r'\s*")'
_JSON = r'\{\s*"bbox_2d"\s*:\s*\[\s*' + r"\s*,\s*".join([_JSON_NUMBER] * 4) + r"\s*\]\s*\}"
_INT = r"([+-]?\d+)"
_GLM_TAGGED = GLM_OPEN + r"\s*" + r"\s*,\s*".join([_INT] * 4) + r"\s*" + GLM_CLOSE
_GLM_BARE = r"(?<![\w.+-])" + r"\s*,\s*".join([_INT] * 4) + r"(?!\w|\.\d)"


def _groups(text: Column, pattern: str) -> Column:
    return F.array(*(F.trim(F.replace(F.regexp_extract(text, pattern, k), F.lit('"'), F.lit(""))).try_cast("double") for k in range(1, 5)))


def _scaled(values: Column, scale: str) -> Column:
    if scale == "normalized":
        return let(values, valid_box)

    def per_mille(b: Column) -> Column:
        ok = ~F.exists(b, lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1000))
        return F.when(ok & (at(b, 0) < at(b, 2)) & (at(b, 1) < at(b, 3)), F.transform(b, lambda v: v / 1000.0))

    return let(values, per_mille)


def parse_box(text: Column, scale: str = "qwen_1000") -> Column:
    """The one box that a text states: tagged, as pairs, in brackets, bare or as JSON when nothing else is there; else the only
    tagged box within it. Null if there is none, several, or an invalid one."""
    if scale not in ("qwen_1000", "normalized"):
        raise ValueError(f"unknown coordinate scale: {scale}")
    t = text
    for characters in (r"[\s\x1c-\x1f]", "`", r"[\s\x1c-\x1f]"):
        t = F.regexp_replace(t, rf"(?U)\A{characters}+|{characters}+\z", "")

    def stated(t: Column) -> Column:
        picked = F.when(F.regexp_count(t, F.lit(_TAGGED)) == 1, _groups(t, _TAGGED))
        for pattern in (_JSON, _BARE, rf"\[{_FOUR}\]", _PAIRS, _TAGGED):
            whole = rf"\A{pattern}\z"
            picked = F.when(t.rlike(whole), _groups(t, whole)).otherwise(picked)
        return picked

    return _scaled(let(t, stated), scale)


def parse_glm_box(text: Column) -> Column:
    """The one box in the other notation: a single tagged list of integers, or without any tag a single bare one that is no
    part of a longer list. Null otherwise."""
    tagged, bare = F.regexp_count(text, F.lit(_GLM_TAGGED)), F.regexp_count(text, F.lit(_GLM_BARE))
    around = F.split(text, _GLM_BARE, 2)
    longer = F.get(around, 0).rlike(r"[\d.]\s*,\s*\z") | F.get(around, 1).rlike(r"\A\s*,\s*[+-]?\d")
    values = F.when(tagged == 1, _groups(text, _GLM_TAGGED)).when((tagged == 0) & (bare == 1) & ~longer, _groups(text, _GLM_BARE))
    return _scaled(values, "qwen_1000")


def write_box(b: Column, tagged: bool = True) -> Column:
    """The box as pairs of integers of 0 to 1000, between tags if ``tagged``."""
    return let(quantize(b), lambda q: _pairs(q, tagged))


def _pairs(q: Column, tagged: bool) -> Column:
    body = F.concat(F.lit("("), at(q, 0).cast("string"), F.lit(","), at(q, 1).cast("string"), F.lit("),("), at(q, 2).cast("string"), F.lit(","), at(q, 3).cast("string"), F.lit(")"))
    return F.concat(F.lit("<|box_start|>"), body, F.lit("<|box_end|>")) if tagged else body


def write_glm_box(b: Column) -> Column:
    q = quantize(b)
    return F.concat(F.lit("<|begin_of_box|>"), F.array_join(F.transform(q, lambda v: v.cast("string")), ","), F.lit("<|end_of_box|>"))
