"""Submissions: every item of a template gets its predicted box; nothing may be missing, extra or invalid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import valid_box
from ..functions.text import stem

#: What an item without a valid prediction gets where that is allowed.
FALLBACK = (0.0, 0.0, 0.001, 0.001)


def gaps(template: DataFrame, predictions: DataFrame, key: str = "key") -> DataFrame:
    """One row: missing (items without a prediction row), extra (predictions of no item), invalid (items with a bad box)."""
    x = template.select(key, F.lit(True).alias("wanted")).join(predictions.select(key, "bbox", F.lit(True).alias("given")), key, "full_outer")
    return x.agg(
        F.count_if(F.col("given").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("extra"),
        F.count_if(F.col("wanted") & F.col("given") & valid_box(F.col("bbox")).isNull()).alias("invalid"),
    )


def build_submission(template: DataFrame, predictions: DataFrame, key: str = "key", allow_fallback: bool = False) -> DataFrame:
    """The template's columns and bbox. Without ``allow_fallback`` anything missing, extra or invalid raises."""
    found = gaps(template, predictions, key).first()
    if not allow_fallback and any(found):
        raise ValueError(f"missing {found.missing}, extra {found.extra}, invalid {found.invalid}")
    x = template.join(predictions.select(key, F.col("bbox").alias("__bbox")), key, "left")
    return x.select(*(c for c in template.columns if c != "bbox"), F.coalesce(valid_box(F.col("__bbox")), F.array(*map(F.lit, FALLBACK))).alias("bbox"))


def template_faults(template: DataFrame, key: str = "key") -> DataFrame:
    """(key, fault) of template rows that break a rule: id, query, three-part paths of the three modalities, equal stems."""
    path = lambda c: rf"\AImages/{c}/[^/]+\z"
    fault = (
        F.when(~F.coalesce(F.col(key).rlike(r"\A\d{6}_\d{3}\z"), F.lit(False)), "id")
        .when(F.coalesce(F.trim("query"), F.lit("")) == "", "query")
        .when(~F.coalesce(F.col("visible").rlike(path("visible")) & F.col("infrared").rlike(path("infrared")) & F.col("depth").rlike(path("depth")), F.lit(False)), "path")
        .when((stem(F.col("visible")) != stem(F.col("infrared"))) | (stem(F.col("visible")) != stem(F.col("depth"))), "stems")
    )
    return template.select(key, fault.alias("fault")).where("fault is not null")


#: The official template's size and the hash of its canonical JSON.
OFFICIAL_COUNT = 5690
OFFICIAL_SHA256 = "9d0f805728859fb51f47be4d2892f7c8f12f16ab17a9b5a79e49a433b4247ed2"


def official_fault(template: DataFrame, key: str = "key", raw: str = "raw", count: int = OFFICIAL_COUNT, sha: str = OFFICIAL_SHA256) -> str | None:
    """The first rule that a template breaks as a whole: its number of rows, a row's rule, or its content."""
    from ..functions.hashing import dataset_fingerprint

    if template.count() != count:
        return "count"
    first = template_faults(template, key).orderBy(key).first()
    if first:
        return f"{first[key]}: {first.fault}"
    return None if dataset_fingerprint(template, key, raw) == sha else "content"
