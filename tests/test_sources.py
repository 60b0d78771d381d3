import hashlib
import json
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from boxlore.operators import journal, submission
from boxlore.sinks import writers
from boxlore.sources import readers, settings
from boxlore.streaming import journal as stream


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0rest"


def test_json_objects(spark, tmp_path):
    path = put(tmp_path / "a.json", '{"b": {"x": 1.50}, "a": null, "c": [1]}')
    assert [(r.pos, r.key) for r in readers.json_object(spark, path).orderBy("pos").collect()] == [(0, "b"), (1, "a"), (2, "c")]
    for bad in ('{"a": 1, "a": 2}', '{"a": {"b": 1, "b": 2}}', "[1]", "{"):
        with pytest.raises(Exception):
            readers.json_object(spark, put(tmp_path / "bad.json", bad)).collect()


def test_groundtruth(spark, tmp_path):
    put(tmp_path / "007" / "groundtruth.txt", "# x\n\na.png, 1.9, -2.9, 3, 4\nb.png,1,2,3\na.png,5,6,7,8\nc.png,1,2,3,4,5\n")
    assert [tuple(r) for r in readers.groundtruth(spark, f"{tmp_path}/*/groundtruth.txt").collect()] == [("007", "a.png", 5, 6, 7, 8)]
    put(tmp_path / "008" / "groundtruth.txt", "a.png,x,2,3,4")
    with pytest.raises(Exception):
        readers.groundtruth(spark, f"{tmp_path}/*/groundtruth.txt").collect()


def test_pictures(spark, tmp_path):
    for name, content in (("001/color/1.png", png(640, 480)), ("002/color/2.png", png(1920, 1080)), ("notes/color/3.png", b"no picture")):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.sha, r.width, r.height) for r in readers.images(spark, str(tmp_path)).collect()}
    assert got["1.png"] == (hashlib.sha256(png(640, 480)).hexdigest(), 640, 480) and got["2.png"][1:] == (1920, 1080) and got["3.png"][1:] == (None, None)
    assert {r.sequence for r in readers.sequences(spark, str(tmp_path)).collect()} == {"001", "002"}
    assert readers.listing(spark, str(tmp_path), "*.png").count() == 3
    frames = spark.createDataFrame([(1, "a", "b", "c"), (2, "a", "b", "d")], "k int, visible string, infrared string, depth string")
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert [r.k for r in readers.complete_samples(frames, files).collect()] == [1]
    scanned = readers.scanned_hashes(spark, [str(tmp_path / "none"), str(tmp_path / "001" / "color")]).collect()
    assert [(r.sha, r.stem) for r in scanned] == [(got["1.png"][0], "1")] and readers.scanned_hashes(spark, []).count() == 0


def test_hash_layouts(spark, tmp_path):
    a, b = "a" * 64, "b" * 64
    for value, want in (({a: ["x", "y"], b: []}, {(a, "x"), (a, "y"), (b, None)}), ({"x": a, "y": b}, {(a, "x"), (b, "y")}), ({a: "x"}, {(a, "x")}), ([a, b], {(a, None), (b, None)}), ({}, set())):
        got = readers.hash_table(spark, put(tmp_path / "h.json", value)).collect()
        assert {(r.sha, r.stem) for r in got} == want


def test_inference_items(spark, tmp_path):
    row = {"visible": "Images/visible/000001.png", "infrared": "Images/infrared/000001.png", "depth": "Images/depth/000001.png", "query": "q"}
    path = put(tmp_path / "t.json", {"000001_001": row, "000001_002": row, "000001_003": row})
    got = readers.inference_items(spark, path, 2).collect()
    assert [r.key for r in got] == ["000001_001", "000001_002"] and got[0].visible == "Test/Images/visible/000001.png"
    boxed = {"k": {"visible": "Raw/1.png", "bbox": [0, 0, 1, 1], "width": 5, "height": 4}}
    for value in (boxed, {"metadata": {}, "data": boxed}):
        r = readers.inference_items(spark, put(tmp_path / "i.json", value)).first()
        assert (r.key, r.visible, r.bbox, r.width) == ("k", "Raw/1.png", [0.0, 0.0, 1.0, 1.0], 5)
    with pytest.raises(Exception, match="not an object"):
        readers.inference_items(spark, put(tmp_path / "b.json", {"k": 1})).collect()
    p = {r.key: r.bbox for r in readers.predictions(spark, put(tmp_path / "p.json", {"a": [0, 0, 1, 1], "b": None})).collect()}
    assert p == {"a": [0.0, 0.0, 1.0, 1.0], "b": None}


def test_generation_and_progress(spark, tmp_path):
    g = put(tmp_path / "g.json", {"metadata": {}, "records": [{"sample_id": "s", "object_index": 1, "query": "q"}]})
    assert readers.generation(spark, g).first().sample_id == "s"
    with pytest.raises(ValueError):
        readers.generation(spark, put(tmp_path / "e.json", {"metadata": {}, "records": []}))
    run = tmp_path / "run"
    put(run / "shard_1.checkpoint.json", {"metadata": {}, "predictions": {"b": None}})
    put(run / "checkpoint.json", {"metadata": {}, "predictions": {"a": [0, 0, 1, 1]}})
    sources = readers.saved_progress(spark, str(run))
    assert [[r.key for r in s.collect()] for s in sources] == [["a"], ["b"]]


def test_settings(tmp_path):
    path = put(tmp_path / "c.yaml", "# c\nrun:\n  name: x\n  batch: 2\nhyperparameters:\n  rate: 1.0e-4\n  amp: true\n")
    assert settings.load_config(path) == {"run": {"name": "x", "batch": 2}, "hyperparameters": {"rate": 1e-4, "amp": True}}
    with pytest.raises(ValueError):
        settings.load_config(put(tmp_path / "d.yaml", "other:\n  a: 1\n"))
    assert settings.merge_options({"a": 1, "b": 2, "c": 3}, {"a": 4, "b": 5}, {"a": 6, "c": None}) == {"a": 6, "b": 5, "c": 3}
    with pytest.raises(ValueError):
        settings.merge_options({}, {"x": 1}, {})
    rules = {"rate": (float, 0, 1, None), "kind": (str, None, None, ("a", "b")), "n": (int, 1, None, None)}
    settings.check_options({"rate": 0.5, "kind": "a", "n": 3}, rules)
    for bad in ({"rate": 2.0}, {"kind": "c"}, {"n": True}, {"n": 0}, {"min_pixels": 5, "max_pixels": 5}):
        with pytest.raises(ValueError):
            settings.check_options(bad, rules)
    assert settings.load_prompt(put(tmp_path / "p.md", "[system] be good [user] find {query}")) == ("be good", "find {query}")
    with pytest.raises(ValueError):
        settings.load_prompt(put(tmp_path / "q.md", "[system] x [user] "))
    put(tmp_path / "outputs" / "val.json", "{}")
    assert settings.active_dataset(str(tmp_path), "val").endswith("outputs/val.json")
    with pytest.raises(FileNotFoundError):
        settings.active_dataset(str(tmp_path), "train")
    with pytest.raises(ValueError):
        settings.distinct_paths(path, f"{tmp_path}/./c.yaml")
    assert settings.from_root("/r", "a") == "/r/a" and settings.from_root("/r", "/a") == "/a" and "q_proj" in settings.adapter_targets("q_proj")


def test_writers(spark, tmp_path):
    writers.write_json(f"{tmp_path}/o/a.json", {"é": 1})
    assert (tmp_path / "o" / "a.json").read_text() == '{\n  "é": 1\n}\n'
    one = lambda p: writers.write_json(p, 1)

    def fail(p):
        raise OSError("full")

    with pytest.raises(OSError, match="full"):
        writers.publish({f"{tmp_path}/x.json": one, f"{tmp_path}/y.json": fail})
    assert not list(tmp_path.glob("x.json*"))
    writers.publish({f"{tmp_path}/x.json": one})
    with pytest.raises(FileExistsError):
        writers.publish({f"{tmp_path}/z.json": one, f"{tmp_path}/x.json": one})
    assert not (tmp_path / "z.json").exists()
    writers.publish({f"{tmp_path}/x.json": one}, force=True)
    def half(p):
        (tmp_path / p.rsplit("/", 1)[1]).write_text("half")
        raise OSError("full")

    with pytest.raises(OSError, match="full"):
        writers.publish({f"{tmp_path}/b.json": half})
    assert not list(tmp_path.glob("b.json*"))
    two = {f"{tmp_path}/{n}": (lambda p, n=n: writers.write_json(p, f"new {n}")) for n in ("p.json", "q.json", "r.json")}
    for stop in range(3):  # stopped between any two of the renames
        for n in ("p.json", "q.json", "r.json"):
            (tmp_path / n).write_text("old")
        real, calls = writers.os.replace, []

        def breaks(a, b):
            if str(b).rsplit("/", 1)[1] in ("p.json", "q.json", "r.json"):
                calls.append(b)
                if len(calls) > stop:
                    raise OSError("gone")
            real(a, b)

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(writers.os, "replace", breaks)
            with pytest.raises(OSError, match="gone"):
                writers.publish(two, force=True)
        assert writers.finish_publication(two) and not writers.finish_publication(two)
        assert [json.loads((tmp_path / n).read_text()) for n in ("p.json", "q.json", "r.json")] == ["new p.json", "new q.json", "new r.json"]
        assert not list(tmp_path.glob("*.staged")) and not list(tmp_path.glob(".*publishing"))
    (tmp_path / "j").write_bytes(b'{"a": 1}\n{"torn')
    writers.append_lines(f"{tmp_path}/j", ['{"b": 2}'])
    assert (tmp_path / "j").read_bytes() == b'{"a": 1}\n{"torn\n{"b": 2}\n'
    t = spark.createDataFrame([("b", "q"), ("a", "é")], "key string, query string")
    p = spark.createDataFrame([("a", [0.0, 0.0, 1.0, 1.0]), ("b", [0.0, 0.0, 0.5, 0.5])], "key string, bbox array<double>")
    assert writers.write_archive(submission.build_submission(t, p), f"{tmp_path}/s.zip") == 2
    with zipfile.ZipFile(f"{tmp_path}/s.zip") as z:
        assert json.loads(z.read("result.json"))["a"] == {"query": "é", "bbox": [0.0, 0.0, 1.0, 1.0]}
    writers.write_run(p, f"{tmp_path}/run", {"run_id": "r"})
    assert spark.read.parquet(f"{tmp_path}/run/predictions").count() == 2


def test_archive_is_pythons_json_in_parts(spark, tmp_path):
    rows = [(f"k{n}", f'é "{n}"\nline', [0.1 * n, 0.0, 1.0, 1e-7], None) for n in range(300)]
    df = spark.createDataFrame(rows, "key string, query string, bbox array<double>, more string").repartition(5)
    assert writers.write_archive(df, f"{tmp_path}/a.zip") == 300
    want = {k: {"query": q, "bbox": b, "more": m} for k, q, b, m in sorted(rows)}
    with zipfile.ZipFile(f"{tmp_path}/a.zip") as z:
        assert z.read("result.json").decode() == json.dumps(want, ensure_ascii=False, indent=2)
    assert writers.write_archive(df.limit(0), f"{tmp_path}/e.zip") == 0
    with pytest.raises(ValueError, match="repeated"):
        writers.write_archive(df.unionAll(df.limit(1)), f"{tmp_path}/r.zip")
    assert not list(tmp_path.glob("r.zip*"))
    writers.write_predictions(df, f"{tmp_path}/p.json")
    assert json.loads((tmp_path / "p.json").read_text()) == {k: b for k, _, b, _ in rows}
    for place in ("p.json", "table"):
        writers.save_predictions(df.select("key", "bbox"), f"{tmp_path}/{place}")
        assert {r.key: r.bbox for r in readers.predictions(spark, f"{tmp_path}/{place}").collect()} == {k: b for k, _, b, _ in rows}


def test_store_writes_are_journal_records(spark, tmp_path):
    path = str(tmp_path / "journal.jsonl")
    writers.set_box(path, "001_1", [0, 0, 1, 1], "ann")
    writers.set_query(path, "001_1", "the é box", "ann")
    writers.set_box(path, "001_2", [0, 0, 1, 1], "ann")
    writers.delete_box(path, "001_2", "ann:absent")
    writers.set_box(path, "001_3", [0, 0, 1, 1], "ann")
    writers.delete_box(path, "001_3", "ann")
    state = journal.replay(journal.parse_records(readers.json_lines(spark, path)))
    got = {r.id: (r.bbox, r.query, r.absent, r.annotator) for r in state.collect()}
    assert got == {"001_1": ([0.0, 0.0, 1.0, 1.0], "the é box", False, "ann"), "001_2": (None, None, True, "ann:absent"), "001_3": (None, None, False, None)}
    assert all(r["ts"].endswith("Z") and len(r["ts"]) == 20 for r in map(json.loads, open(path)))


def test_whole_yaml_and_its_flat_part(tmp_path, monkeypatch):
    text = 'run:\n  tag: "a # b"  # c\n  batch: 2\n  none: ~\nhyperparameters:\n  rate: 2.5e-4\n  name: it\n'
    want = {"run": {"tag": "a # b", "batch": 2, "none": None}, "hyperparameters": {"rate": 2.5e-4, "name": "it"}}
    assert settings.load_config(put(tmp_path / "a.yaml", text)) == want == settings._plain(str(tmp_path / "a.yaml"))
    pytest.importorskip("yaml")
    nested = "run:\n  parts: [q, k]\n  more:\n    deep: 1\n  text: |\n    one\n    two\nhyperparameters:\n"
    assert settings.load_config(put(tmp_path / "b.yaml", nested)) == {"run": {"parts": ["q", "k"], "more": {"deep": 1}, "text": "one\ntwo\n"}, "hyperparameters": {}}
    with pytest.raises(ValueError, match="without a YAML parser"):
        settings._plain(str(tmp_path / "b.yaml"))
    for bad in ("run: 5\n", "- run\n", "run:\n  a: 1\nother: {}\n"):
        with pytest.raises(ValueError):
            settings.load_config(put(tmp_path / "c.yaml", bad))


def test_stream_replays_as_the_batch_does(spark, tmp_path):
    import os

    rng = random.Random(3)
    folder, n = tmp_path / "journal", 0
    folder.mkdir()
    lines = []
    for part in range(3):
        own = []
        for _ in range(80):
            r = {"id": f"001_{rng.randrange(25)}", "annotator": rng.choice(["a", "a:absent", "b:todo"]), "ts": str(n)}
            if rng.random() < 0.7:
                r["bbox"] = rng.choice([[0.1, 0.2, 0.3, 0.4], None, [1]])
            if rng.random() < 0.5:
                r["query"] = f"q{n}"
            own.append(json.dumps(r))
            n += 1
        own.append('{"id": "torn')
        path = folder / f"p{part}.jsonl"
        path.write_text("\n".join(own) + "\n")
        os.utime(path, (1_700_000_000 + part, 1_700_000_000 + part))
        lines += own
    seen: dict = {}

    def keep(batch, number):
        seen.update({r.id: tuple(r)[1:] for r in batch.collect()})

    q = stream.live_state(stream.tail(spark, str(folder))).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    df = spark.createDataFrame(list(enumerate(lines)), "pos long, line string")
    assert seen == {r.id: tuple(r)[1:] for r in journal.replay(journal.parse_records(df)).collect()}



def test_stream_reads_on_in_a_file_that_grows(spark, tmp_path):
    rng = random.Random(5)
    folder = tmp_path / "journal"
    folder.mkdir()
    schema = "id string, visible string, infrared string, depth string, bbox array<double>, width int, height int, query string"
    start = [(f"001_{k}", f"v{k}", "i", "d", None, 4, 3, "") for k in range(0, 60, 2)]
    begun = spark.createDataFrame(start, schema)
    stream.begin_merged(begun, f"{tmp_path}/data", 12)
    sizes = spark.createDataFrame([(f"Raw/001/color/{k}.png", 8, 6) for k in range(60)], "visible string, width int, height int")
    lines, done, n, held = [], [], 0, start

    def some(count):
        nonlocal n
        out = []
        for _ in range(count):
            r = {"id": f"001_{rng.randrange(60)}", "annotator": rng.choice(["a", "a:absent", "b:todo"]), "ts": str(n)}
            if rng.random() < 0.8:
                r["bbox"] = rng.choice([[0.1, 0.2, 0.3, 0.4 + n / 10_000], None])
            if rng.random() < 0.7:
                r["query"] = f"q{n} é"
            out.append(json.dumps(r, ensure_ascii=False))
            n += 1
        return out

    def run(new):
        nonlocal held
        q = stream.keep_merged(stream.tail(spark, str(folder)), f"{tmp_path}/data", sizes, str(tmp_path / "c"), done.append, 12).trigger(availableNow=True).start()
        q.awaitTermination()
        records = journal.parse_records(spark.createDataFrame(list(enumerate(lines)), "pos long, line string"))
        ids = {json.loads(x)["id"] for x in new}  # what was deleted and comes back later is a new row
        held = journal.merge(spark.createDataFrame(held, schema), journal.replay(records).where(F.col("id").isin(ids)), sizes).collect()
        assert sorted(map(repr, stream.current(spark, f"{tmp_path}/data").select(begun.columns).collect())) == sorted(map(repr, held))

    path = folder / "p.jsonl"
    for k, count in enumerate((50, 3, 40)):
        new = some(count)
        writers.append_lines(str(path), new)  # to the one file, between the runs
        lines += new
        run(new)
        assert len(done) == k + 1
    with open(path, "a") as f:
        f.write('{"id": "001_1", "bbox": [0.5, 0.5')  # not ended yet
    run([])
    writers.append_lines(str(path), some(0))
    new = some(5)
    (folder / "other.jsonl").write_text("\n".join(new) + "\n")
    lines += ['{"id": "001_1", "bbox": [0.5, 0.5', *new]
    run(new)
    leaves = stream.manifest(spark, f"{tmp_path}/data").collect()
    assert sum(r.n for r in leaves) == len(held) and len({r.leaf for r in leaves}) == len(leaves)
    named = {(r.leaf, r.v) for n in stream._manifests(spark, f"{tmp_path}/data") for r in stream.manifest(spark, f"{tmp_path}/data", n).collect() if r.n}
    there = {(p.name[5:], int(p.parent.name[2:])) for p in (tmp_path / "data" / "data").glob("v=*/leaf=*")}
    assert there == named and len(stream._manifests(spark, f"{tmp_path}/data")) == 2  # of the last batch and the one before


def test_spans_of_a_file_hold_each_line_once(tmp_path):
    from boxlore.streaming.source import JournalReader

    rng = random.Random(2)
    path = tmp_path / "j.jsonl"
    lines = ["é" * rng.randint(0, 30) for _ in range(200)]
    path.write_text("\n".join(lines) + "\ntorn", encoding="utf-8")
    for split in (1, 7, 64, 1 << 20):
        reader = JournalReader(str(path), split)
        end = reader.latestOffset()
        got = sorted(r for part in reader.partitions(reader.initialOffset(), end) for r in reader.read(part))
        assert [line for _, line in got] == lines
        assert reader.partitions(end, reader.latestOffset()) == []
    path.write_text("short\n")
    with pytest.raises(ValueError, match="shrunk"):
        JournalReader(str(path)).partitions(end, JournalReader(str(path)).latestOffset())


def test_groundtruth_is_read_by_ranges(spark, tmp_path):
    """A file is dealt to many tasks and the last line of a name wins all the same; later files of a sequence come later."""
    lines = [f"{n % 7}.png,{n},2,3,{n}" for n in range(500)]
    (tmp_path / "001").mkdir()
    (tmp_path / "001" / "a.txt").write_text("\r\n".join(lines))
    (tmp_path / "002").mkdir()
    (tmp_path / "002" / "part-0.txt").write_text("x.png,1,1,1,1\ny.png,1,1,1,1\n" + "#\n" * 900)
    (tmp_path / "002" / "part-1.txt").write_text("x.png,2,2,2,2\n")
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "4"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = readers.groundtruth(spark, f"{tmp_path}/*/*.txt")
        want = {("001", f"{n % 7}.png", n, 2, 3, n) for n in range(493, 500)} | {("002", "x.png", 2, 2, 2, 2), ("002", "y.png", 1, 1, 1, 1)}
        assert {tuple(r) for r in found.collect()} == want
        scan = readers.groundtruth(spark, f"{tmp_path}/001/*.txt")._jdf.queryExecution().sparkPlan().collectLeaves().head()
        assert scan.execute().getNumPartitions() > 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
