"""Plans are what was meant: no join of all pairs, pruned scans, no Python where none is needed, one shuffle where one will do."""

import os
import re

import pytest

from boxlore.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")

#: Queries whose results need Python: canonical JSON, its casefold, a hash fed in order, or the structural scan of a JSON object.
PYTHON = {"hash_canonical_json", "hash_dataset", "hash_fields", "inference_of_pictures", "package_published", "text_collisions_exact", "source_generation", "source_hash_table", "source_items", "source_predictions"}


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairs_and_no_needless_python(spark, name):
    text = plan(spark, name)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert name in PYTHON or not re.search("EvalPython|MapInPandas|MapInArrow|FlatMapGroups", text)


@pytest.mark.parametrize(
    ("name", "columns"),
    [("evaluate_accuracy", {"o_orderkey", "o_custkey", "o_totalprice"}), ("valid_predictions", {"o_orderkey", "o_totalprice"}), ("text_collisions", {"p_brand", "p_name"}), ("hash_contents", {"doc_id", "text"}), ("training_image_bytes", {"p_size", "p_partkey"}), ("contract_lookup", {"l_orderkey", "l_linenumber", "l_partkey", "p_partkey", "p_size"})],
)
def test_scans_are_pruned(spark, name, columns):
    read = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name)))))
    assert read <= columns


@pytest.mark.parametrize(("name", "most"), [("fuse_predictions", 1), ("journal_replay", 1), ("training_best_epoch", 2), ("evaluate_items", 2), ("training_augment", 0), ("box_validate", 0), ("parse_boxes", 0)])
def test_shuffles_are_few(spark, name, most):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(re.findall("Exchange hashpartitioning|Exchange SinglePartition|Exchange range", plan(spark, name))) <= most
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
