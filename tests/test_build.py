import json
import struct

import pytest
from pyspark.sql import functions as F

from boxlore import __main__ as cli
from boxlore.functions import hashing
from boxlore.functions.text import item_of_route
from boxlore.operators import build, contract, inference, package, submission
from boxlore.sources import readers, state


def png(w, h, tail=b""):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0" + tail


@pytest.fixture
def folders(tmp_path):
    root = tmp_path / "raw"
    lines = {"001": ["a.png,10,20,30,40", "b.png,1,1,5,5", "gone.png,1,1,5,5"], "002": ["c.png,0,0,50,50", "d.png,90,0,20,5"], "notes": ["e.png,1,1,2,2"]}
    for seq, rows in lines.items():
        for row in rows:
            name = row.split(",")[0]
            for kind in ("color", "infrared", "depth"):
                if name == "gone.png" and kind == "depth":
                    continue
                p = root / seq / kind / name
                p.parent.mkdir(parents=True, exist_ok=True)
                p.write_bytes(png(100, 200, name.encode()))
        (root / seq / "groundtruth.txt").write_text("\n".join(rows))
    import hashlib

    hashes = tmp_path / "hashes.json"
    hashes.write_text(json.dumps({hashlib.sha256(png(100, 200, b"b.png")).hexdigest(): ["t"]}))
    return str(root), str(hashes)


def test_split_from_folders(spark, folders):
    root, hashes = folders
    frames = build.candidates(spark, root)
    index, stats = build.build_index(frames, readers.hash_table(spark, hashes))
    row = stats.first()
    assert (row.sequences, row.samples, row.excluded_hash, row.excluded_invalid_bbox, row.train + row.val) == (2, 2, 1, 1, 2)
    got = {r.id: r for r in index.collect()}
    assert set(got) == {"001_a", "002_c"} and got["001_a"].bbox == [0.1, 0.1, 0.4, 0.3] and got["001_a"].visible == "Raw/001/color/a.png"
    m = build.manifest(index, stats)
    side = got["001_a"].split
    want = {i: {"visible": r.visible, "infrared": r.infrared, "depth": r.depth, "bbox": r.bbox, "width": r.width, "height": r.height} for i, r in got.items() if r.split == side}
    assert m["index_fingerprints"][side] == hashing.stable_hash(want, style="spaced") and m["index_sample_counts"] == {"train": row.train, "val": row.val}
    with pytest.raises(ValueError):
        build.build_index(frames, readers.hash_table(spark, hashes).limit(0))


def test_commands(spark, folders, tmp_path, capsys):
    root, hashes = folders
    assert cli.main(["split", root, "--test-hashes", hashes, "--out", str(tmp_path / "o")]) == 0
    assert json.loads((tmp_path / "o" / "split_manifest.json").read_text())["status"] == "complete"
    row = {"visible": "Images/visible/1.png", "infrared": "i", "depth": "d", "query": "q"}
    for name, value in (("t.json", {"a": row, "b": row}), ("i.json", {"a": {"bbox": [0, 0, 1, 1]}, "b": {"bbox": [0, 0, 1, 1]}}), ("p.json", {"a": [0, 0, 1, 1], "b": [0, 0, 0.5, 1]}), ("q.json", {"a": [0, 0, 1, 1]})):
        (tmp_path / name).write_text(json.dumps(value))
    cli.main(["evaluate", f"{tmp_path}/i.json", f"{tmp_path}/p.json"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["acc_at_threshold"] == 1.0
    cli.main(["fuse", f"{tmp_path}/p.json", f"{tmp_path}/q.json", "--out", f"{tmp_path}/f"])
    assert spark.read.parquet(f"{tmp_path}/f").count() == 2
    cli.main(["submit", f"{tmp_path}/t.json", f"{tmp_path}/p.json", "--out", f"{tmp_path}/s.zip"])
    with pytest.raises(ValueError):
        cli.main(["submit", f"{tmp_path}/t.json", f"{tmp_path}/q.json", "--out", f"{tmp_path}/s2.zip"])


RECORDS = "pos int, sample_id string, object_index int, bbox array<double>, query string, collision boolean"


def test_packaging(spark):
    index = spark.createDataFrame([("001_1", "v1", "i", "d", [0.1, 0.1, 0.2, 0.2], 5, 4), ("001_2", "v2", "i", "d", None, 5, 4)], "id string, visible string, infrared string, depth string, bbox array<double>, width int, height int")
    box = [0.3, 0.3, 0.4, 0.4]
    make = lambda *rows: package.from_generation(spark.createDataFrame(list(rows), RECORDS), index)
    good = make((0, "001_1", 1, None, '"the red cup."', None), (1, "001_1", 2, box, "the blue cup", False), (2, "001_2", 1, box, "the red cup", None))
    got = {r.id: (r.query, r.bbox) for r in package.refuse(good).collect()}
    assert got == {"001_1#01": ("the red cup", [0.1, 0.1, 0.2, 0.2]), "001_1#02": ("the blue cup", box), "001_2#01": ("the red cup", box)}
    meta = package.metadata(package.refuse(good), "val", "annot_r", "h", {})
    assert (meta["sample_count"], meta["sequence_count"]) == (3, 1) and contract.metadata_fault(meta, "val", "annot_r") is None
    one = make((0, "001_1", 0, None, "a cup", None))
    assert [r.id for r in one.collect()] == ["001_1"]
    cases = [
        (((0, "001_9", 1, None, "a cup", None),), "unknown sample"), (((0, "001_1", 1, None, "a cup", None), (1, "001_1", 1, None, "a pan", None)), "repeated key"),
        (((0, "001_1", 1, None, "a  Cup", None), (1, "001_1", 2, None, "A cup.", None)), "query collision"), (((0, "001_1", 1, None, "a cup", True),), "query collision"), (((0, "001_1", 1, None, "a thing", None),), "generic"),
    ]
    for rows, want in cases:
        with pytest.raises(ValueError, match=want):
            package.refuse(make(*rows))
    assert package.refuse(make((0, "001_1", 1, None, "a thing", None)), lenient=True).count() == 1
    with pytest.raises(ValueError):
        package.from_generation(spark.createDataFrame([(0, "a", 1, None, "x", None), (1, "a", 2, None, "y", None)], RECORDS), index, "sample_id")
    assert package.disagreement({"prompt_hash": "a"}, {"prompt_hash": "b"}) == "prompt_hash" and package.disagreement({}, {"prompt_hash": "b"}) is None


META = {f: "x" for f in state.TRAINING_FIELDS} | {"protocol_version": 2, "training_run_id": "train_" + "0" * 16, "hyperparameters": {"lr": 1}, "seed": 42, "train_samples": 33, "val_samples": 4}
METRICS = {"hits": 1, "total": 2, "acc_at_0_5": 0.5, "mean_iou": 0.4, "failures": 0}


def adapter(path, manifest):
    path.mkdir(parents=True)
    (path / "adapter_config.json").write_text("{}")
    (path / "adapter_model.bin").write_bytes(b"w")
    (path / "adapter_manifest.json").write_text(json.dumps(manifest))
    return path


def test_training_states(tmp_path):
    best = adapter(tmp_path / "best" / "epoch_02", {"metadata": META, "epoch": 2, "val_loss": 0.5})
    last = adapter(tmp_path / "last", {"metadata": META, "completed_epochs": 3})
    assert state.manifest_fault(json.loads((best / "adapter_manifest.json").read_text())) is None
    assert state.manifest_fault({"metadata": META | {"seed": True}, "epoch": 1, "val_loss": 1.0}) == "seed" and state.manifest_fault({"epoch": 1}) == "schema"
    assert state.metrics_fault(METRICS) is None and state.metrics_fault(METRICS | {"failures": 3}) == "counts" and state.metrics_fault(METRICS | {"mean_iou": float("nan")}) == "mean_iou"
    done = {"metadata": META, "status": "completed", "global_step": 3 * 5, "best_val_loss": 0.5, "best_path": str(best), "last_path": str(last), "best_metric": "acc", "best_metric_value": 0.5}
    check = lambda s: state.completed_fault(s, META, tmp_path, 2, 4, 3)
    assert check(done) is None and check(done | {"global_step": 14}) == "global_step" and check(done | {"best_val_loss": 0.4}) == "best val_loss"
    assert check(done | {"best_path": "/tmp"}) == "best: outside the run" and check(done | {"last_path": str(best)}) == "last: path"
    cp = adapter(tmp_path / "checkpoints" / "epoch_02", {"metadata": META, "epoch": 2, "val_loss": 0.5})
    (cp / "training_state.pt").write_bytes(b"x")
    s = {"metadata": META, "completed_epoch": 2, "global_step": 10, "best_val_loss": 0.5, "best_path": str(best), "train_loss": 1.0, "val_loss": 0.5, "best_metric": "acc", "best_metric_value": 0.5, "epoch_metrics": METRICS}
    resume = lambda path: state.checkpoint_fault(path, tmp_path, META, 2, 4, 3)
    for value, want in ((s, None), (s | {"global_step": 9}, "global_step"), (s | {"val_loss": 0.6}, "val_loss of the adapter"), (s | {"best_val_loss": 0.1}, "best adapter"), ({"metadata": META}, "schema"), ({}, "metadata")):
        (cp / "state.json").write_text(json.dumps(value))
        assert resume(cp) == want
    step = adapter(tmp_path / "checkpoints" / "step_7", {})
    (step / "training_state.pt").write_bytes(b"x")
    for value, want in (({"global_step": 7, "completed_epoch": 1, "batch_index": 4}, None), ({"global_step": 8, "completed_epoch": 1}, "global_step"), ({"global_step": 7, "completed_epoch": 0}, "step of the epoch"), ({"global_step": 7, "completed_epoch": 1, "batch_index": -1}, "batch_index")):
        (step / "state.json").write_text(json.dumps({"metadata": META, **value}))
        assert resume(step) == want
    assert resume(tmp_path / "else") == "outside the run" and resume(tmp_path / "checkpoints" / "x") == "path"
    binary = {k: {} for k in state.BINARY} | {"completed_epoch": 2, "global_step": 10, "training_run_id": META["training_run_id"]}
    assert state.binary_fault(binary, s, META) is None and state.binary_fault(binary | {"global_step": 9}, s, META) == "global_step"
    assert state.is_offloaded({"a": 0, "b": "cpu"}) and not state.is_offloaded({"a": 0})


def test_run_records():
    identity = {f: None for f in state.RUN_FIELDS if f not in ("version", "python_version", "run_id", "mode", "split", "annotation_run_id")}
    a = state.run_metadata(identity, "full", "val", "annot_1", "3.13")
    b = state.run_metadata(identity | {"lora_path": "/x"}, "full", "val", "annot_1", "3.13")
    assert tuple(a) == state.RUN_FIELDS and a["run_id"] == b["run_id"] and a["run_id"].startswith("infer_")
    assert state.run_metadata(identity, "retry", "test", None, "3.13")["run_id"].endswith("_retry")
    for split, run in (("val", None), ("val", "a b"), ("test", "x")):
        with pytest.raises(ValueError):
            state.run_metadata(identity, "full", split, run, "3.13")
    assert state.same_identity(a, b) is None and state.same_identity(a, a | {"limit": 5}) == "mismatched limit" and state.same_identity({}, {"a": 1}) == "missing a" and state.same_identity({"a": 1}, {}) == "extra a"
    assert state.shard_metadata(a, 1, ["b", "a"])["assigned_key_hash"] == hashing.key_hash(["a", "b"])
    t = state.training_metadata({k: v for k, v in META.items() if k not in ("protocol_version", "training_run_id")})
    assert tuple(t) == state.TRAINING_FIELDS and t["training_run_id"].startswith("train_")
    assert state.common_run_id(["r_train", "r_val"]) == "annot_r" and state.common_run_id(["a", "b"]) == "annot_a"
    assert state.runtime_packages(["numpy==0", "no-such-thing==1", "x"])[1:] == ["no-such-thing==1", "x"]


def test_run_in_steps(spark, tmp_path):
    items = spark.createDataFrame([(k, f"k{k}", "v", f"q{k}") for k in range(7)], "pos int, key string, visible string, query string")
    commits = []
    out = inference.run_in_steps(items, "stand-in", str(tmp_path / "run"), 3, commits.append)
    assert commits == [1, 2, 3] and {r.key: r.bbox for r in out.collect()} == {r.key: r.bbox for r in inference.stand_in(items).collect()}
    assert inference.run_in_steps(items, "no such adapter", str(tmp_path / "run"), 3).count() == 7


def test_small_checks(spark):
    df = spark.createDataFrame([(0, "/api/item/a%20b+c/bbox"), (1, "/api/item//bbox"), (2, "/api/item/a/b/bbox"), (3, "/api/x/bbox")], "k int, p string")
    assert [r[0] for r in df.orderBy("k").select(item_of_route(F.col("p"), "/bbox")).collect()] == ["a b+c", None, None, None]
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert [r.v for r in contract.select_ids(rows, ids("b")).collect()] == [2]
    for bad in (("b", "b"), ("z",)):
        with pytest.raises(Exception, match="id: "):
            contract.select_ids(rows, ids(*bad)).collect()
    t = spark.createDataFrame([("000001_001", "Images/visible/1.png", "Images/infrared/1.png", "Images/depth/1.png", "q", '{"query": "q"}')], "key string, visible string, infrared string, depth string, query string, raw string")
    assert submission.official_fault(t) == "count" and submission.official_fault(t, count=1) == "content"
    assert submission.official_fault(t, count=1, sha=hashing.stable_hash({"000001_001": {"query": "q"}})) is None
    assert submission.official_fault(t.withColumn("query", F.lit(" ")), count=1) == "000001_001: query"
