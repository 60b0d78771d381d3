"""A training corpus in five stages, each one operator applied to all that the stage before has kept.

Toxic documents go; of each group of near-duplicates one document stays; documents that hold benchmark passages go;
personal data is redacted; what is left is mixed to the sources' target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlore.llm import decontaminate, mixture, pii, simhash, toxicity
from boxlore.llm.common import drop, materialise, table
from boxlore.llm.components import connected_components


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores at 0.7 or more go. Null texts stay."""
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).where("__score < 0.7").select(docs.columns)


#: Keys of documents that are sent to every task instead of dealing the documents out; 16 bytes each.
SENT = 1 << 19


def _sent(keys: DataFrame) -> DataFrame:
    """The keys, marked to be sent to every task if they are few; beyond SENT the join is Spark's to plan, by a shuffle of both sides."""
    return F.broadcast(keys) if keys.count() <= SENT else keys


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints one document stays, once: that of smallest id.

    A document is an id and a text, so rows of one id with different texts are different documents. One without an id
    stays only where its component holds no id, and of several such one. Rows equal in both are one document.
    """
    key = ["__key1", "__key2"]  # 128 bits that stand for the id and the text
    keyed = docs.select("*", *(F.xxhash64(F.lit(k), F.col("doc_id").isNull(), "doc_id", "text").alias(c) for k, c in enumerate(key)))
    documents = materialise(simhash.fingerprints(keyed, carried=tuple(key)).groupBy("fp", "doc_id", *key).count(), "documents")
    nodes = materialise(documents.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *key)).alias("first")), "nodes")
    found = connected_components(simhash.links(nodes.select("fp", F.col("fp").alias("rep"))))
    roots = nodes.join(found, nodes["fp"] == found["id"], "left").groupBy(F.coalesce("component", "fp").alias("root")).agg(F.min("first").alias("first"))
    stay = roots.select("first.*").select(*key)
    go = materialise(documents.select(*key).join(stay, key, "left_anti"), "go")
    repeated = materialise(documents.where("count > 1").select(*key).join(go, key, "left_anti"), "repeated")
    kept = keyed.join(_sent(go), key, "left_anti")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(_sent(repeated), key, "left_anti")
    return once.unionByName(keyed.join(_sent(repeated), key, "left_semi").dropDuplicates(key)).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten words of a benchmark item follow each other (or all of a shorter item) go, with an id or without.

    Null and empty texts stay.
    """
    return decontaminate.flagged(docs, table(spark, sf_dir, "benchmark")).where("not __contaminated").select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets; n_chars is the new length. No document goes."""
    found = pii.personal_data(docs, with_text=True)
    new = {"text": F.col("redacted"), "n_chars": F.coalesce(F.length("redacted").cast("long"), F.col("n_chars"))}
    return found.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes words, with their size, their source's size and target, and the words taken."""
    return mixture.mix(docs, columns=tuple(docs.columns)).where("taken > 0")


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("benchmark_decontamination", drop_contaminated), ("personal_data", redact), ("source_mixing", mix)]

#: The first stage's network and the second's hashes have no SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage has read is deleted once its own rows are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        read, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        drop(read)
    return STAGES[-1][1](spark, docs, sf_dir)
