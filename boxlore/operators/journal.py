"""Replay of an append-only annotation journal, in closed form: what each id's records leave behind.

A record may carry a box, a null box (with an ``:absent`` annotator a statement that there is nothing, else a plain
delete), a query, or both. Order is the position in the file; times have whole seconds only and do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import scene_of

#: A record's members, each as whatever it is; of a name that is there twice the last counts.
RECORD = "id variant, bbox variant, query variant, annotator variant, ts variant"
#: What a journal record becomes: ``has_bbox`` tells a null box from a missing one.
RECORDS = "pos long, id string, has_bbox boolean, bbox array<double>, query string, annotator string, ts string"
#: Queries, as JSON, that set none.
_NOTHING = ("0", "-0", "0.0", "-0.0", "false", "[]", "{}")


def parse_records(lines: DataFrame, line: str = "line", pos: str = "pos") -> DataFrame:
    """Records from JSON lines. Blank, torn and non-object lines and those whose id is no text or empty go.

    A box is four values that make numbers (numbers, texts of numbers, and true and false as 1 and 0). A bad one stays as
    ``has_bbox`` null, as such a record changes neither box nor annotator. A query of another kind than text is its JSON.
    """
    keys = F.json_object_keys(line)
    x = lines.where(F.trim(line) != "").select(F.col(pos).alias("pos"), F.from_json(F.col(line), RECORD).alias("r"), keys.alias("keys"))
    text = lambda c: F.try_variant_get(f"r.{c}", "$", "string")
    kind = lambda c: F.schema_of_variant(f"r.{c}")
    x = x.where(F.col("keys").isNotNull() & (kind("id") == "STRING") & (text("id") != ""))
    numbers = F.transform(F.try_variant_get("r.bbox", "$", "array<variant>"), lambda v: F.try_variant_get(v, "$", "double"))
    good = F.coalesce((F.size(numbers) == 4) & ~F.exists(numbers, lambda v: v.isNull()), F.lit(False))
    null = F.is_variant_null("r.bbox")
    has = F.when(~F.array_contains("keys", "bbox"), F.lit(False)).when(null | good, F.lit(True))
    json = F.to_json("r.query")
    query = F.when(kind("query") == "STRING", F.nullif(text("query"), F.lit(""))).when(~F.is_variant_null("r.query") & ~json.isin(*_NOTHING), json)
    query = F.when(json == "true", "True").otherwise(query)
    return x.select("pos", text("id").alias("id"), has.alias("has_bbox"), F.when(good, numbers).alias("bbox"), query.alias("query"), text("annotator").alias("annotator"), text("ts").alias("ts"))


def replay(records: DataFrame) -> DataFrame:
    """(id, bbox, query, absent, annotator, ts) of each id that a record names.

    annotator and ts are those of the last box event if it left a box or an absence; after a plain delete, or without
    any, those of the first query-only record since. One shuffle by id: a window finds the last box event, the rest is
    aggregation. An id's records are one item's edits.
    """
    last = F.max(F.when(F.col("has_bbox"), F.col("pos"))).over(Window.partitionBy("id"))
    x = records.withColumn("last", last)
    event = F.struct("pos", "bbox", "annotator", "ts")
    out = x.groupBy("id").agg(
        F.max(F.when(F.col("has_bbox"), event)).alias("e"),
        F.max_by("query", F.when(F.col("query").isNotNull(), F.col("pos"))).alias("query"),
        F.min(F.when(~F.col("has_bbox") & (F.col("last").isNull() | (F.col("pos") > F.col("last"))), F.struct("pos", "annotator", "ts"))).alias("after"),
    )
    absent = F.coalesce(F.col("e.pos").isNotNull() & F.col("e.bbox").isNull() & F.col("e.annotator").endswith(":absent"), F.lit(False))
    own = F.col("e.bbox").isNotNull() | absent
    pick = lambda c: F.when(own, F.col(f"e.{c}")).otherwise(F.col(f"after.{c}")).alias(c)
    return out.select("id", F.col("e.bbox").alias("bbox"), "query", absent.alias("absent"), pick("annotator"), pick("ts"))


def merge(active: DataFrame, state: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The active dataset after the journal: ids with box and query are updated or inserted, absent ids are deleted, ids that
    were plainly deleted or not touched stay.

    active: id, visible, infrared, depth, bbox, width, height, query. An annotator still to do leaves the query empty. An
    inserted row's paths come from its id, its size from ``sizes`` (visible, width, height); without a size it raises.
    """
    s = state.select("id", F.col("bbox").alias("s_bbox"), F.col("query").alias("s_query"), "absent", "annotator", F.lit(True).alias("touched"))
    x = active.withColumn("there", F.lit(True)).join(s, "id", "full_outer")
    full = F.coalesce((F.size("s_bbox") == 4) & (F.col("s_query") != ""), F.lit(False))
    query = F.when(F.col("annotator").endswith(":todo"), "").otherwise(F.col("s_query"))
    parts = F.split(F.split_part("id", F.lit("#"), F.lit(1)), "_")
    path = F.concat(F.lit("Raw/"), F.get(parts, 0), F.lit("/color/"), F.get(parts, 1), F.lit(".png"))
    new = F.col("there").isNull()
    x = x.where(F.coalesce(~F.col("absent") | full, F.lit(True)) & (F.col("there") | (full & (F.size(parts) >= 2))))
    x = x.withColumn("visible", F.when(new, path).otherwise(F.col("visible")))
    if sizes is not None:
        z = sizes.select(F.col("visible").alias("z_visible"), F.col("width").alias("z_width"), F.col("height").alias("z_height"))
        x = x.join(z, new & (F.col("visible") == F.col("z_visible")), "left")
    size = lambda c: F.when(new, F.coalesce(F.col(f"z_{c}") if sizes is not None else F.lit(None), F.raise_error(F.concat(F.lit("no image size for "), F.col("id"))).cast("int"))).otherwise(F.col(c)).alias(c)
    other = lambda c: F.when(new, F.replace("visible", F.lit("/color/"), F.lit(f"/{c}/"))).otherwise(F.col(c)).alias(c)
    return x.select(
        "id", "visible", other("infrared"), other("depth"), F.when(full, F.col("s_bbox")).otherwise(F.col("bbox")).alias("bbox"), size("width"), size("height"),
        F.when(full, query).otherwise(F.col("query")).alias("query"),
    )


def counts(dataset: DataFrame) -> DataFrame:
    """One row: sample_count and sequence_count."""
    return dataset.agg(F.count("*").alias("sample_count"), F.count_distinct(scene_of(F.col("id"), F.col("visible"))).alias("sequence_count"))


def to_seed(items: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes (id, bbox, annotator) and queries (id, query) of the items that the store does not have yet."""
    annotator = F.coalesce(F.nullif("annotator", F.lit("")), F.when(F.col("status") == "annotated", "human").otherwise("seed"))
    boxes = items.where("gt_bbox is not null").join(state.where("bbox is not null").select("id"), "id", "left_anti").select("id", F.col("gt_bbox").alias("bbox"), annotator.alias("annotator"))
    queries = items.where("query <> ''").join(state.where("query is not null").select("id"), "id", "left_anti").select("id", "query")
    return boxes, queries


def edit_faults(edits: DataFrame, known: DataFrame, locked: bool = False) -> DataFrame:
    """(id, status, fault) of edit requests that are refused: 403 locked, 404 unknown id, 400 annotator, query or box."""
    from ..functions.geometry import annotator_box

    blank = lambda c, most: (F.trim(F.coalesce(c, F.lit(""))) == "") | (F.length(c) > most)
    x = edits.join(known.select("id", F.lit(True).alias("known")), "id", "left")
    refused = lambda status, fault: F.struct(F.lit(status).alias("status"), F.lit(fault).alias("fault"))
    fault = (
        F.when(F.lit(locked), refused(403, "locked"))
        .when(F.col("known").isNull(), refused(404, "unknown id"))
        .when(blank(F.col("annotator"), 64), refused(400, "annotator"))
        .when(F.col("query").isNotNull() & blank(F.col("query"), 200), refused(400, "query"))
        .when(F.col("bbox").isNotNull() & annotator_box(F.col("bbox"))["reason"].isNotNull(), refused(400, "bbox"))
    )
    return x.select("id", fault.alias("f")).where("f is not null").select("id", "f.status", "f.fault")


def as_lines(edits: DataFrame) -> DataFrame:
    """Edits (id, has_bbox, bbox, query, annotator, ts) as JSON lines in which a null box is written and a missing one is not."""
    options = {"ignoreNullFields": "false"}
    keep = lambda *c: F.to_json(F.struct(*c), options)
    both, box, query = keep("id", "bbox", "query", "annotator", "ts"), keep("id", "bbox", "annotator", "ts"), keep("id", "query", "annotator", "ts")
    return edits.select(F.when(F.col("has_bbox") & F.col("query").isNotNull(), both).when(F.col("has_bbox"), box).otherwise(query).alias("value"))


def latest(records: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """The last record of each key."""
    every = F.struct(pos, *(c for c in records.columns if c != pos))
    return records.groupBy(key.alias("__key")).agg(F.max(every).alias("r")).select("r.*")
