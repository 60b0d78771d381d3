"""Contracts of annotation artifacts: each rule as a predicate, the first broken rule of all is the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import valid_box
from ..functions.hashing import APPROVED_FIELDS
from ..functions.text import annotation_fault, collision_key, is_canonical_path, scene_of

#: The metadata that must and may be there, and the protocol that artifacts are approved under.
REQUIRED_METADATA = ("status", "protocol_version", "split", "sample_count", "sequence_count", "provenance")
OPTIONAL_METADATA = ("run_id", "source_fingerprint", "preparation_fingerprint", "image_fingerprint", "dataset_fingerprint", "prompt_hash", "qc", "run_tag")
PROTOCOL_VERSION = 13
FINGERPRINTS = ("source_fingerprint", "preparation_fingerprint", "image_fingerprint", "dataset_fingerprint", "prompt_hash")


def query_failures(data: DataFrame, key: str = "id", allow_pending: bool = False) -> DataFrame:
    """(key, pos, reason) of rows whose query breaks a rule; an empty query does unless pending rows are allowed."""
    empty = F.coalesce(F.col("query"), F.lit("")) == ""
    reason = F.when(empty, F.lit(None if allow_pending else "empty query").cast("string")).otherwise(annotation_fault(F.col("query")))
    return data.select(key, "pos", reason.alias("reason")).where("reason is not null")


def failure_summary(failures: DataFrame, key: str = "id") -> DataFrame:
    """One row: how many failures there are, and the first by position with its reason."""
    first = F.min(F.struct("pos", key, "reason"))
    return failures.agg(F.count("*").alias("failures"), first[key].alias("first_id"), first["reason"].alias("first_reason"))


def structural_fault(fields: Column, allow_pending: bool = False) -> Column:
    """A row's structural fault, null if none; ``fields`` is the array of its field names. A box is looked at only where a query is."""
    complete = F.size(F.array_except(F.array(*map(F.lit, APPROVED_FIELDS)), fields)) == 0
    asked = F.trim(F.coalesce("query", F.lit(""))) != ""
    return F.when(~complete, "missing_field").when(~asked, F.lit(None if allow_pending else "empty_query").cast("string")).when(asked & valid_box(F.col("bbox")).isNull(), "bad_bbox")


def preflight(data: DataFrame, fields: Column, key: str = "id", allow_pending: bool = False, most: int = 5) -> DataFrame:
    """(fault, n, first_ids): each structural fault that occurs, how often, and its first ids by position.

    The first ids are cut per task before they meet, so a fault of most rows costs no more than one of few.
    """
    x = data.select("pos", F.col(key).alias("key"), structural_fault(fields, allow_pending).alias("fault")).where("fault is not null")
    first = x.withColumn("rank", F.row_number().over(Window.partitionBy("fault").orderBy("pos"))).where(F.col("rank") <= most)
    ids = first.groupBy("fault").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda s: s["key"]).alias("first_ids"))
    return x.groupBy("fault").agg(F.count("*").alias("n")).join(ids, "fault")


def annotated_count(data: DataFrame) -> DataFrame:
    """One row: samples, and those with a query."""
    return data.agg(F.count("*").alias("samples"), F.count_if(F.trim(F.coalesce("query", F.lit(""))) != "").alias("annotated"))


def metadata_fault(m: dict, split: str, run_id: str | None = None) -> str | None:
    """The first rule that an artifact's metadata breaks, or None."""
    if not isinstance(m, dict):
        return "metadata schema"
    rules = (
        ("metadata schema", set(REQUIRED_METADATA) <= set(m) <= set(REQUIRED_METADATA) | set(OPTIONAL_METADATA)),
        ("status or protocol", m.get("status") == "approved" and m.get("protocol_version") == PROTOCOL_VERSION),
        ("split", m.get("split") == split),
        ("run id", not (run_id and m.get("run_id")) or m["run_id"] == run_id),
        ("fingerprint", all(isinstance(m[f], str) and m[f] for f in FINGERPRINTS if f in m)),
        ("provenance schema", isinstance(m.get("provenance"), dict) and set(m["provenance"]) == {"source_type"}),
        ("provenance", (m.get("provenance") or {}) == {"source_type": "human_annotated"}),
        ("qc", "qc" not in m or isinstance(m["qc"], dict) and m["qc"].get("complete") is True),
        ("counts", all(isinstance(m.get(c), int) and not isinstance(m.get(c), bool) and m[c] > 0 for c in ("sample_count", "sequence_count"))),
    )
    return next((name for name, kept in rules if not kept), None)


def artifact_fault(metadata: dict, data: DataFrame, split: str, run_id: str | None = None, strict: bool = True, allow_pending: bool = False, prints: dict[str, str] | None = None) -> str | None:
    """The first broken rule of an artifact, in the contract's order, or None.

    data: id, pos, raw (a row's JSON text), and its fields parsed. Rules about rows are counted on the cluster; the
    driver sees one row of each count. ``prints`` are the fingerprints of these same rows where the caller has made them
    (``hashing.fingerprints``); else they are made here.
    """
    from ..functions.hashing import fingerprints

    schema = metadata_fault(metadata, split, run_id)
    if schema in ("metadata schema", "status or protocol", "split", "run id", "fingerprint", "provenance schema", "provenance", "qc"):
        return schema
    keys = F.coalesce(F.json_object_keys("raw"), F.array())
    exact = (F.size(keys) == len(APPROVED_FIELDS)) & (F.size(F.array_except(F.array(*map(F.lit, APPROVED_FIELDS)), keys)) == 0)
    x = data.withColumn("__keys", keys)
    n, scenes, odd = x.agg(F.count("*"), F.count_distinct(scene_of(F.col("id"), F.col("visible"))), F.count_if(~exact)).first()
    if not n:
        return "empty data"
    if schema:
        return schema
    if n != metadata["sample_count"]:
        return "sample count"
    if scenes != metadata["sequence_count"]:
        return "sequence count"
    named = [f for f in ("source_fingerprint", "dataset_fingerprint") if f in metadata]
    made = (prints or fingerprints(data)) if named else {}
    wrong = next((f for f in named if made[f] != metadata[f]), None)
    if wrong:
        return wrong.replace("_", " ")
    if odd:
        return "field schema"
    found = failure_summary(query_failures(data, allow_pending=allow_pending)).first()
    if strict and found.failures:
        return f"query: {found.first_id}: {found.first_reason} ({found.failures} in all)"
    if allow_pending and not annotated_count(data).first().annotated:
        return "no annotated sample"
    faults = {r.fault: r.n for r in preflight(x, F.col("__keys"), allow_pending=allow_pending).collect()}  # three rows at most
    return next((f"{name}: {faults[name]}" for name in ("empty_query", "bad_bbox", "missing_field") if name in faults), None)


def training_fault(train: tuple[dict, DataFrame], val: tuple[dict, DataFrame], run_id: str | None = None, strict: bool = True, allow_pending: bool = False) -> str | None:
    """The first broken rule of two artifacts (metadata, data) that are trained and validated on: each one's own, then what both
    must share, then ids and scenes that both have."""
    for split, (metadata, data) in (("train", train), ("val", val)):
        fault = artifact_fault(metadata, data, split, run_id, strict, allow_pending)
        if fault:
            return f"{split}: {fault}"
    return shared_fault(train, val)


def shared_fault(train: tuple[dict, DataFrame], val: tuple[dict, DataFrame]) -> str | None:
    """The first rule between two artifacts that is broken: a field of the metadata that both must share, ids and scenes that both
    have."""
    from .package import disagreement
    from .splits import overlaps

    field = disagreement(train[0], val[0])
    if field:
        return f"both: {field}"
    sides = [d.select("id", scene_of(F.col("id"), F.col("visible")).alias("scene")) for _, d in (train, val)]
    for column in ("id", "scene"):
        shared = [r[0] for r in overlaps(*sides, column).collect()]  # five at most
        if shared:
            return f"both: {column} {shared}"
    return None


def check_training(train: tuple[dict, DataFrame], val: tuple[dict, DataFrame], **options) -> None:
    """Raises the first rule that ``training_fault`` finds broken."""
    fault = training_fault(train, val, **options)
    if fault:
        raise ValueError(fault)


def collisions(data: DataFrame, frame: str = "visible") -> DataFrame:
    """(frame, query_key, n) of queries that a frame has more than once."""
    return data.groupBy(frame, collision_key(F.col("query")).alias("query_key")).agg(F.count("*").alias("n")).where("n > 1")


def path_faults(data: DataFrame, key: str = "id") -> DataFrame:
    """(key, fault): paths that are not canonical or not distinct, sizes that are not positive."""
    paths = ("visible", "infrared", "depth")
    bad = ~is_canonical_path(F.col(paths[0])) | ~is_canonical_path(F.col(paths[1])) | ~is_canonical_path(F.col(paths[2]))
    fault = F.when(bad, "path").when(F.size(F.array_distinct(F.array(*paths))) < 3, "distinct").when(F.coalesce((F.col("width") <= 0) | (F.col("height") <= 0), F.lit(True)), "size")
    return data.select(key, fault.alias("fault")).where("fault is not null")


def compare_fields(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(field, fault) from two tables (field, value): missing, extra, or mismatch; null values are equal to each other."""
    a = actual.select("field", F.col("value").alias("a"), F.lit(True).alias("has_a"))
    e = expected.select("field", F.col("value").alias("e"), F.lit(True).alias("has_e"))
    fault = F.when(F.col("has_a").isNull(), "missing").when(F.col("has_e").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("e")), "mismatch")
    return a.join(e, "field", "full_outer").select("field", fault.alias("fault")).where("fault is not null")


def unmatched(records: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Records that an index does not know, by key; empty where a lookup join is safe."""
    return records.join(index.select(key), key, "left_anti").select(key).distinct()


def lookup(records: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Records with their index rows; their own box goes before the index's. A record without an index row raises."""
    i = index.select(F.col(key), F.col("bbox").alias("__bbox"), F.lit(True).alias("__known"), *(F.col(c) for c in index.columns if c not in (key, "bbox") and c not in records.columns))
    x = records.join(i, key, "left")
    checked = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unknown: "), F.col(key).cast("string"))).cast("array<double>")).otherwise(F.coalesce("bbox", "__bbox"))
    return x.withColumn("bbox", checked).drop("__bbox", "__known")


def has_repeats(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, and whether any repeats."""
    return rows.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys")).withColumn("repeats", F.col("rows") != F.col("keys"))


def select_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the given ids; an id that repeats or has no row raises."""
    asked = ids.groupBy(key).agg(F.count("*").alias("__n"))
    x = asked.join(rows.withColumn("__there", F.lit(True)), key, "left")
    fault = F.when(F.col("__n") > 1, "repeated id: ").when(F.col("__there").isNull(), "unknown id: ")
    good = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return x.where(good).select(rows.columns)
