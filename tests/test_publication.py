"""Publishing on shared storage: what is published is there as a whole or not at all, whoever writes and wherever it stops."""

import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from boxlore import __main__ as command
from boxlore.operators import contract, journal, package
from boxlore.sinks import commit, writers
from boxlore.sources import readers


def seen(root):
    return sorted(f for f in os.listdir(root) if not f.startswith(("_", "."))) if os.path.isdir(root) else []


def test_one_of_two_writers_and_the_last_one_counts(spark, tmp_path):
    root, copy = str(tmp_path / "out"), str(tmp_path / "copy")
    write = lambda v: lambda folder: [spark.createDataFrame([(f"{v}{n}",)], "value string").write.text(f"{folder}/{n}") for n in "ab"]

    def attempt(v):
        try:
            return commit.publish(spark, [root], write(v))
        except FileExistsError:
            return None

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(attempt, range(4)))
    assert sum(x is not None for x in got) == 1 and seen(root) == ["000000000001"]
    winner = next(n for n, x in enumerate(got) if x)
    texts = lambda: sorted(r.value for n in "ab" for r in spark.read.text(f"{commit.published(spark, root)}/{n}").collect())
    assert texts() == [f"{winner}a", f"{winner}b"]
    with pytest.raises(FileExistsError):
        commit.publish(spark, [copy, root], write(7))
    assert seen(copy) == []  # looked at before anything is written
    with ThreadPoolExecutor(3) as pool:
        again = list(pool.map(lambda v: commit.publish(spark, [root], write(v), again=True)[0], (5, 6, 8)))
    assert sorted(again) == [commit.entry(root, n) for n in (2, 3, 4)]
    assert texts() == [f"{(5, 6, 8)[again.index(commit.entry(root, 4))]}{n}" for n in "ab"]
    with pytest.raises(ValueError, match="one destination"):
        commit.publish(spark, [copy, copy + "/"], write(1))
    with pytest.raises(FileNotFoundError):
        commit.published(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("stop", range(5))
def test_a_failure_between_any_two_steps(spark, tmp_path, monkeypatch, stop):
    """Steps: two outputs written for each of two roots, then the roots claimed."""
    roots, steps = [str(tmp_path / "out"), str(tmp_path / "copy")], []

    def step():
        if len(steps) == stop:
            raise OSError("stopped")
        steps.append(1)

    def write(folder):
        for n in "ab":
            step()
            spark.createDataFrame([(n,)], "value string").write.text(f"{folder}/{n}")

    claim = commit.claim
    monkeypatch.setattr(commit, "claim", lambda *a: (step(), claim(*a))[1])
    with pytest.raises(OSError, match="stopped"):
        commit.publish(spark, roots, write)
    for root in roots:
        assert seen(root) == [] and not [f for f in (os.listdir(root) if os.path.isdir(root) else []) if f.startswith("_staged")]


def test_a_copy_that_fails_leaves_the_first_root_whole(spark, tmp_path, monkeypatch):
    roots, claim = [str(tmp_path / "out"), str(tmp_path / "copy")], commit.claim

    def failing(session, staged, target):
        if target.startswith(roots[1]):
            raise OSError("stopped")
        return claim(session, staged, target)

    write = lambda folder: spark.createDataFrame([("x",)], "value string").write.text(f"{folder}/a")
    monkeypatch.setattr(commit, "claim", failing)
    with pytest.raises(OSError, match="stopped"):
        commit.publish(spark, roots, write)
    assert seen(roots[0]) == ["000000000001"] and os.listdir(roots[1]) == []
    monkeypatch.setattr(commit, "claim", claim)
    assert commit.publish(spark, roots, write, again=True) == [commit.entry(roots[0], 2), commit.entry(roots[1], 1)]


def test_single_records_on_shared_storage(spark, tmp_path):
    folder = str(tmp_path / "journal")
    for n in range(3):
        writers.append_records(spark, [writers.record_line("a", "ann", "t", query=f"{n}{k}") for k in range(5)], folder)
    held = journal.replay(journal.parse_records(readers.json_lines(spark, folder))).collect()
    assert [(r.id, r.query) for r in held] == [("a", "24")]


def put(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def sides(spark, tmp_path, val_scene=2, style=False):
    """An index as split writes it, and a generation for each side."""
    boxes = spark.createDataFrame([(s, split, f"{s:03d}_{split[0]}{n}", f"Raw/{s:03d}/color/{n}.png") for s, split in ((1, "train"), (val_scene, "val")) for n in range(4)], "scene int, split string, id string, visible string")
    index = boxes.withColumns({"bbox": F.array(*map(F.lit, (0.1, 0.2, 0.5, 0.75))), "width": F.lit(64), "height": F.lit(48), "infrared": F.replace("visible", F.lit("color"), F.lit("infrared")), "depth": F.replace("visible", F.lit("color"), F.lit("depth"))})
    index.write.partitionBy("split").parquet(f"{tmp_path}/index")
    words = ("big", "old", "wet", "red")
    query = lambda n, w: "The target by the fence." if style and n == 2 else f"The {w} dog by the fence."
    made = {s: put(tmp_path / f"{s}.json", {"records": [{"sample_id": f"{c:03d}_{s[0]}{n}", "object_index": 1, "query": query(n, w)} for n, w in enumerate(words)]}) for s, c in (("train", 1), ("val", val_scene))}
    return [made["train"], made["val"], f"{tmp_path}/index", "--run-id", "r", "--prompt-hash", "p"]


def test_approve_and_check(spark, tmp_path, capsys):
    args, root, copy = sides(spark, tmp_path), str(tmp_path / "out"), str(tmp_path / "copy")
    assert command.main(["approve", *args, "--export", copy, "--out", root]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["val"]["invalid_queries"] == 0
    assert command.main(["check", copy, "--run-id", "r"]) == 0
    for place in (root, copy):
        assert sorted(os.listdir(f"{place}/000000000001/train")) == ["approved"]
    text = "".join(open(f"{root}/000000000001/train/approved/{f}").read() for f in sorted(os.listdir(f"{root}/000000000001/train/approved")) if f.startswith("part"))
    held = json.loads(text)
    assert list(held) == ["metadata", "data"] and set(held["data"]) == {f"001_t{n}" for n in range(4)} and set(held["data"]["001_t0"]) == set(contract.APPROVED_FIELDS)
    metadata, data = readers.approved(spark, f"{root}/000000000001/val/approved")
    assert metadata["split"] == "val" and metadata["sample_count"] == 4 and contract.artifact_fault(metadata, data, "val", "r") is None
    assert readers.inference_items(spark, f"{root}/000000000001/val/approved").count() == 4
    with pytest.raises(FileExistsError):
        commit.publish(spark, [root], lambda folder: None)


def test_sides_that_share_a_scene_are_not_published(spark, tmp_path):
    args, root = sides(spark, tmp_path, val_scene=1), str(tmp_path / "out")
    with pytest.raises(SystemExit, match="both: scene"):
        command.main(["approve", *args, "--dry-run", "--out", root])
    data = spark.createDataFrame([("001_1", "Raw/001/color/1.png")], "id string, visible string")
    pair = [package.Artifact({"split": s, "prompt_hash": "p"}, data.withColumn("id", F.concat("id", F.lit(s))), data) for s in ("train", "val")]
    with pytest.raises(ValueError, match="both: scene"):
        package.publish(pair, root)
    assert seen(root) == []


def test_style_is_an_error_or_a_report(spark, tmp_path, capsys):
    args, root = sides(spark, tmp_path, style=True), str(tmp_path / "out")
    with pytest.raises(ValueError):
        command.main(["approve", *args, "--out", root])
    assert seen(root) == []
    assert command.main(["approve", *args, "--lenient", "--out", root]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["train"] == {"complete": True, "failed_sequences": 0, "failed_frames": 0, "invalid_queries": 1, "generated_samples": 4}
    report = spark.read.json(f"{root}/000000000001/train/qc_report").collect()
    assert [(r.item_key, r.query) for r in report] == [("001_t2", "The target by the fence")] and report[0].reason
    assert json.loads(spark.read.text(f"{root}/000000000001/train/qc_report_summary").first().value)["qc_failures_count"] == 1
    metadata, data = readers.approved(spark, f"{root}/000000000001/train/approved")
    assert contract.artifact_fault(metadata, data, "train").startswith("query: 001_t2: ") and contract.artifact_fault(metadata, data, "train", strict=False) is None


def test_artifacts_of_one_split_are_no_pair(spark, tmp_path):
    a = package.Artifact({"split": "train"}, spark.range(1), spark.range(1))
    with pytest.raises(ValueError, match="one split"):
        package.publish([a, a], str(tmp_path / "out"))
