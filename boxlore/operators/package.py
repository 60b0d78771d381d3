"""Packaging: generated queries and a split index to an approved artifact, or a dataset checked as it is."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import APPROVED_FIELDS, fingerprints
from ..functions.text import clean_query, collision_key, item_key
from ..sinks import commit, writers
from . import contract

#: Faults of a record that no option lets pass.
HARD = ("unknown sample", "repeated key", "query collision")


@dataclass
class Artifact:
    """An approved artifact: its metadata, its rows (pos, id, raw and the fields), and what is wrong with their queries' style (pos,
    id, query, reason), which only a lenient packaging lets pass."""

    metadata: dict
    data: DataFrame
    failures: DataFrame


def from_generation(records: DataFrame, index: DataFrame, key_format: str = "auto") -> DataFrame:
    """(pos, id, visible, infrared, depth, bbox, width, height, query, fault) of each record.

    records: pos, sample_id, object_index, bbox, query, collision. index: id and its fields. The query is stored clean.
    fault, in this order: an unknown sample, a repeated key, a query that its frame has already or that was marked as a
    collision, else a broken query rule. Keys carry the object's number where samples repeat (``auto``) or always
    (``item_id``); ``sample_id`` with repeats raises.
    """
    repeats = contract.has_repeats(records, "sample_id").first().repeats
    if key_format == "sample_id" and repeats:
        raise ValueError("samples repeat, so keys need the object's number")
    numbered = key_format == "item_id" or (key_format == "auto" and repeats)
    i = index.select(F.col("id").alias("sample_id"), "visible", "infrared", "depth", F.col("bbox").alias("i_bbox"), "width", "height", F.lit(True).alias("known"))
    x = records.join(i, "sample_id", "left").withColumn("query", clean_query(F.col("query")))
    x = x.withColumn("id", item_key(F.col("sample_id"), F.coalesce("object_index", F.lit(0))) if numbered else F.col("sample_id"))
    turn = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy("pos"))
    x = x.withColumn("key_turn", turn("id")).withColumn("folded", collision_key(F.col("query"), exact=True)).withColumn("query_turn", turn("visible", "folded"))
    fault = (
        F.when(F.col("known").isNull(), "unknown sample").when(F.col("key_turn") > 1, "repeated key")
        .when(F.coalesce("collision", F.lit(False)) | (F.col("query_turn") > 1), "query collision").otherwise(contract.annotation_fault(F.col("query")))
    )
    return x.select("pos", "id", "visible", "infrared", "depth", F.coalesce("bbox", "i_bbox").alias("bbox"), "width", "height", "query", fault.alias("fault"))


def refuse(items: DataFrame, lenient: bool = False) -> DataFrame:
    """The items without ``fault``; the first hard fault raises, and so does a query's style unless ``lenient``."""
    hard = F.col("fault").isin(*HARD)
    bad = items.where("fault is not null" if not lenient else hard)
    first = bad.agg(F.count("*").alias("n"), F.min(F.struct(~hard, "pos", "id", "fault")).alias("first")).first()
    if first.n:
        raise ValueError(f"{first.first.id}: {first.first.fault} ({first.n} in all)")
    return items.drop("fault")


def with_raw(items: DataFrame) -> DataFrame:
    """The items with ``raw``, each one's fields as the artifact has them."""
    fields = F.struct(*(F.col(c) for c in APPROVED_FIELDS))
    return items.withColumn("raw", F.to_json(fields, {"ignoreNullFields": "false"}))


def metadata(items: DataFrame, split: str, run_id: str, prompt_hash: str, prints: dict[str, str]) -> dict:
    """An approved artifact's metadata with the counts of its items."""
    from .journal import counts

    n = counts(items).first()
    return {
        "status": "approved", "protocol_version": contract.PROTOCOL_VERSION, "run_id": run_id, "split": split, "sample_count": n.sample_count, "sequence_count": n.sequence_count,
        "provenance": {"source_type": "human_annotated"}, "prompt_hash": prompt_hash, **prints,
    }


def disagreement(train: dict, val: dict) -> str | None:
    """A field that both splits' metadata must share and do not."""
    return next((f for f in ("prompt_hash", "provenance") if f in train and f in val and train[f] != val[f]), None)


def approve(records: DataFrame, index: DataFrame, split: str, run_id: str, prompt_hash: str, key_format: str = "auto", lenient: bool = False, preparation: str | None = None) -> Artifact:
    """The artifact of a split's generated records and its index (id and fields). A broken rule of the records or of the contract
    raises; ``preparation`` is the fingerprint of the split's manifest."""
    found = from_generation(records, index, key_format).persist()
    items = with_raw(refuse(found, lenient))
    made = fingerprints(items)
    prints = {**made, "preparation_fingerprint": preparation} if preparation else made
    failures = found.where(F.col("fault").isNotNull() & ~F.col("fault").isin(*HARD)).select("pos", "id", "query", F.col("fault").alias("reason"))
    described = metadata(items, split, run_id, prompt_hash, prints)
    described["qc"] = {"complete": True, "failed_sequences": 0, "failed_frames": 0, "invalid_queries": failures.count(), "generated_samples": described["sample_count"]}
    fault = contract.artifact_fault(described, items, split, run_id, strict=not lenient, prints=made)
    if fault:
        raise ValueError(f"{split}: {fault}")
    return Artifact(described, items, failures)


def write_artifacts(artifacts: list[Artifact], folder: str) -> None:
    """Below a folder, for each split: ``approved``, one JSON object in files that all tasks write, and, where queries of a broken
    style were let pass, ``qc_report`` with a line for each, and ``qc_report_summary``."""
    for a in artifacts:
        m, place = a.metadata, f"{folder}/{a.metadata['split']}"
        writers.write_object(a.data, f"{place}/approved", "pos", "id", "raw", f'{{"metadata": {json.dumps(m)}, "data": {{', "}}")
        if m["qc"]["invalid_queries"]:
            report = {"run_id": m["run_id"], "split": m["split"], "lenient_qc": True, "qc_failures_count": m["qc"]["invalid_queries"]}
            spark = a.data.sparkSession
            spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.text(f"{place}/qc_report_summary")
            a.failures.orderBy("pos").select(F.col("id").alias("item_key"), "query", "reason").write.json(f"{place}/qc_report")


def publish(artifacts: list[Artifact], root: str, copies: tuple[str, ...] = (), force: bool = False) -> list[str]:
    """Publish the artifacts of one run under ``root``, all or none, and as copies under other roots: the paths. Artifacts of both
    splits must be fit to train and validate on together, else nothing is written. Without ``force`` nothing may be there yet."""
    by_split = {a.metadata["split"]: (a.metadata, a.data) for a in artifacts}
    if len(by_split) != len(artifacts):
        raise ValueError("two artifacts of one split")
    if len(by_split) == 2:
        between = contract.shared_fault(by_split["train"], by_split["val"])
        if between:
            raise ValueError(between)
    return commit.publish(artifacts[0].data.sparkSession, [root, *copies], lambda folder: write_artifacts(artifacts, folder), force)
