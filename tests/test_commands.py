"""The commands over files, one after the other as they are used, and what they rest on."""

import json
import re
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boxlore import __main__ as command
from boxlore.operators import contract, inference, sharding
from boxlore.sources import readers


def put(path, value):
    path.write_text(json.dumps(value))
    return str(path)


@pytest.fixture
def template(tmp_path):
    row = lambda n: {**{m: f"Images/{m}/{n:06d}.png" for m in ("visible", "infrared", "depth")}, "query": f"the box {n} é"}
    return put(tmp_path / "template.json", {f"{n:06d}_001": row(n) for n in range(12)})


def test_infer_fuse_submit_evaluate(spark, tmp_path, template, capsys):
    out = lambda name: str(tmp_path / name)
    assert command.main(["infer", template, "--folder", out("run1"), "--step", "5", "--out", out("one.json")]) == 0
    assert command.main(["infer", template, "--folder", out("run2"), "--shards", "3", "--step", "2", "--out", out("two")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"predictions": 12, "valid": 12}
    for fused in (out("fused.json"), out("fused")):
        assert command.main(["fuse", out("one.json"), out("two"), "--out", fused]) == 0
        assert command.main(["submit", template, fused, "--out", out("s.zip")]) == 0
        with zipfile.ZipFile(out("s.zip")) as z:
            got = json.loads(z.read("result.json"))
        assert set(got) == {f"{n:06d}_001" for n in range(12)} and all(len(r["bbox"]) == 4 for r in got.values())
    one = json.loads((tmp_path / "one.json").read_text())
    assert {r.key: r.bbox for r in readers.predictions(spark, out("two")).collect()} == one
    truth = put(tmp_path / "truth.json", {k: {"visible": "Raw/1.png", "query": "q", "bbox": b, "width": 4, "height": 4} for k, b in one.items()})
    capsys.readouterr()
    assert command.main(["evaluate", truth, out("fused")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["hits"] == 12


def test_shards_go_on_and_must_be_whole(spark, tmp_path, monkeypatch):
    items = spark.createDataFrame([(n, f"k{n:02d}", f"v{n}", f"the box {n}") for n in range(20)], "pos long, key string, visible string, query string")
    want = {r.key: r.bbox for r in inference.stand_in(items).collect()}
    folder = str(tmp_path / "run")

    def stop(step):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        inference.run_in_shards(items, "stand-in", folder, 3, 4, stop)
    assert len(readers.shard_folders(spark, folder)) == 1
    commits = []
    got = inference.run_in_shards(items, "stand-in", folder, 2, 4, commits.append)
    assert {r.key: r.bbox for r in got.collect()} == want and got.count() == 20
    assert sum(s.count() for s in readers.saved_progress(spark, folder)) == 20
    before = len(commits)
    assert inference.run_in_shards(items, "no such adapter", folder, 5, 4, commits.append).count() == 20 and len(commits) == before
    monkeypatch.setattr(inference, "_run", lambda *a, **k: None)
    with pytest.raises(ValueError, match="shard 0 has done 0 of"):
        inference.run_in_shards(items, "stand-in", str(tmp_path / "other"), 2, 4)


def test_pictures_are_decoded_once_while_32_are_kept(spark, tmp_path, monkeypatch):
    class Echo:
        def load(self):
            pass

        def predict(self, rows):
            return [[0.0, 0.0, 1.0, 1.0 if r["image"] == r["visible"] else 0.5] for r in rows]

    log = tmp_path / "log"

    def decode(path):
        with open(log, "a") as f:
            f.write(path + "\n")
        return path

    monkeypatch.setitem(inference._REGISTRY, "echo", Echo)
    rows = [(f"k{n:03d}", f"v{n % 20}", "q") for n in range(100)]
    items = spark.createDataFrame(rows, "key string, visible string, query string").coalesce(1)
    assert all(r.bbox == [0.0, 0.0, 1.0, 1.0] for r in inference.predict(items, "echo", decode=decode).collect())
    assert sorted(log.read_text().split()) == sorted({v for _, v, _ in rows})
    log.write_text("")  # one picture has a third of the rows
    rows = [(f"k{n:04d}", "hot" if n % 3 == 0 else f"v{n % 40}", "q") for n in range(1200)]
    items = spark.createDataFrame(rows, "key string, visible string, query string").repartition(7)
    parted = sharding.by_picture(items, most=100)
    assert sorted(map(tuple, parted.collect())) == sorted(rows)
    monkeypatch.setattr(inference, "by_picture", lambda x: sharding.by_picture(x, most=100))
    assert inference.predict(items, "echo", decode=decode).where("bbox[3] = 1").count() == 1200
    decoded = Counter(log.read_text().split())
    assert decoded.pop("hot") <= 4 and set(decoded.values()) == {1} and len(decoded) == len({v for _, v, _ in rows}) - 1


def test_a_step_costs_what_it_holds_and_is_saved_whole(spark, tmp_path, monkeypatch):
    items = spark.createDataFrame([(n, f"k{n:02d}", f"v{n}", f"the box {n}") for n in range(23)], "pos long, key string, visible string, query string")
    want = {r.key: r.bbox for r in inference.stand_in(items).collect()}
    folder, asked = str(tmp_path / "run"), []
    monkeypatch.setattr(inference, "predict", lambda todo, name, **k: (asked.append(todo.count()), inference.stand_in(todo))[1])

    def stop(step):
        if step == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        inference.run_in_steps(items, "stand-in", folder, 5, stop)
    assert asked == [5, 5] and sorted(p.name for p in (tmp_path / "run" / "predictions").iterdir()) == ["000000000001", "000000000002"]
    assert {r.key for r in readers.predictions(spark, f"{folder}/predictions").collect()} == {f"k{n:02d}" for n in range(10)}
    got = inference.run_in_steps(items, "stand-in", folder, 6)
    assert asked == [5, 5, 6, 6, 1] and {r.key: r.bbox for r in got.collect()} == want and got.count() == 23


def test_split_package_and_a_module_of_adapters(spark, tmp_path, monkeypatch, template):
    boxes = spark.createDataFrame([(s, f"{s:03d}_{n}", f"Raw/{s:03d}/color/{n}.png", [0.1, 0.2, 0.5, 0.25 + n / 10], 64, 48) for s in (1, 2) for n in range(3)], "scene int, id string, visible string, bbox array<double>, width int, height int")
    index = boxes.withColumns({"infrared": F.replace("visible", F.lit("color"), F.lit("infrared")), "depth": F.replace("visible", F.lit("color"), F.lit("depth")), "split": F.when(F.col("scene") == 1, "train").otherwise("val")})
    index.write.partitionBy("split").parquet(f"{tmp_path}/index")  # as the command writes it
    for split, scene in (("train", 1), ("val", 2)):
        records = [{"sample_id": f"{scene:03d}_{n}", "object_index": 1, "query": f"The {w} dog by the fence."} for n, w in enumerate(("big", "old", "wet"))]
        generation = put(tmp_path / f"{split}.json", {"metadata": {}, "records": records})
        for place in (f"{tmp_path}/index", f"{tmp_path}/index/split={split}"):
            assert command.main(["package", generation, place, "--split", split, "--run-id", "r", "--prompt-hash", "p", "--out", f"{tmp_path}/{split}_out.json"]) == 0
        held = json.loads((tmp_path / f"{split}_out.json").read_text())
        assert set(held["data"]) == {f"{scene:03d}_{n}" for n in range(3)} and held["data"][f"{scene:03d}_1"]["bbox"] == [0.1, 0.2, 0.5, 0.35]
    (tmp_path / "own_adapters.py").write_text("from boxlore.operators import inference\nfrom boxlore.plans.files import Measure\ninference.register('own', Measure)\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setattr(inference, "_REGISTRY", dict(inference._REGISTRY))
    assert command.main(["infer", template, "--adapter", "own", "--module", "own_adapters", "--folder", str(tmp_path / "run"), "--out", str(tmp_path / "p.json")]) == 0
    got = json.loads((tmp_path / "p.json").read_text())
    assert got["000001_001"] == [0.0, 0.125, (11 % 5 + 1) / 8, (11 % 4 + 2) / 8] and len(got) == 12


def test_package_and_both_sides(spark, tmp_path):
    out = {}
    for split, first in (("train", 1), ("val", 3)):
        frames = {f"{s:03d}_{n}": {"visible": f"Raw/{s:03d}/color/{n}.png", "infrared": f"Raw/{s:03d}/infrared/{n}.png", "depth": f"Raw/{s:03d}/depth/{n}.png", "bbox": [0.1, 0.2, 0.5, 0.25 + n / 10], "width": 64, "height": 48} for s in (first, first + 1) for n in range(3)}
        records = [{"sample_id": k, "object_index": 1, "query": f"The {w} dog by the {k.split('_')[0]} fence."} for k, w in zip(frames, ("big", "old", "wet") * 2)]
        generation = put(tmp_path / f"{split}_g.json", {"metadata": {}, "records": records})
        index = put(tmp_path / f"{split}_i.json", frames)
        out[split] = str(tmp_path / f"{split}.json")
        command.main(["package", generation, index, "--split", split, "--run-id", "r1", "--prompt-hash", "p1", "--out", out[split]])
        bad = put(tmp_path / "bad.json", {"metadata": {}, "records": [*records, records[0]]})
        with pytest.raises(ValueError, match="repeated key"):
            command.main(["package", bad, index, "--split", split, "--run-id", "r1", "--prompt-hash", "p1", "--key-format", "item_id", "--out", str(tmp_path / "no.json")])

    def side(split, change=None):
        held = json.loads(open(out[split]).read())
        raw = {k: json.dumps(v) for k, v in held["data"].items()}
        rows = [(n, k, r) for n, (k, r) in enumerate(raw.items())]
        data = spark.createDataFrame(rows, "pos long, id string, raw string").select("*", F.from_json("raw", "visible string, infrared string, depth string, query string, bbox array<double>, width int, height int").alias("r")).select("pos", "id", "raw", "r.*")
        return {**held["metadata"], **(change or {})}, data

    train, val = side("train"), side("val")
    assert contract.training_fault(train, val, "r1") is None
    contract.check_training(train, val)
    assert contract.training_fault(train, side("val", {"prompt_hash": "other"})) == "both: prompt_hash"
    assert contract.training_fault(train, train) == "val: split"
    again = (dict(train[0], split="val"), train[1])
    assert contract.training_fault(train, again).startswith("both: id ['001_0'")
    renamed = (dict(train[0], split="val"), train[1].withColumn("id", F.concat("id", F.lit("x"))))
    renamed[0].pop("dataset_fingerprint")
    renamed[0].pop("source_fingerprint")
    assert contract.training_fault(train, renamed) == "both: scene ['001', '002']"
    with pytest.raises(ValueError, match="val: run id"):
        contract.check_training(train, side("val", {"run_id": "r2"}), run_id="r1")


def test_no_task_gets_all_rows_of_a_picture(spark):
    """Rows are never dealt by picture alone, as one task would then get all rows of the most frequent one."""
    items = spark.range(50_000).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 3 == 0, "0.png").otherwise(F.concat(F.col("id").cast("string"), F.lit(".png"))).alias("visible"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # less than the rows, more than the pictures with many
    try:
        parted = sharding.by_picture(items)
        assert not re.search(r"hashpartitioning\(__picture#\d+, \d+\)|SortMergeJoin", parted._jdf.queryExecution().executedPlan().toString())
        sizes = parted.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 50_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
