import random

import pytest
from pyspark.sql import functions as F

from boxlore.functions import geometry as g
from boxlore.operators import contract, evaluate, fusion, inference, journal, resume, session, sharding, splits, submission, training

UNIT = [0.0, 0.0, 1.0, 1.0]


def predictions(spark, rows):
    return spark.createDataFrame(rows, "key string, bbox array<double>")


def test_evaluation(spark):
    truth = predictions(spark, [("a", UNIT), ("b", UNIT), ("c", UNIT)])
    p = predictions(spark, [("a", UNIT), ("b", [0.0, 0.0, 0.5, 0.5]), ("c", None), ("x", UNIT)])
    r = evaluate.evaluate(truth, p).first()
    assert (r.hits, r.total, r.failures) == (1, 3, 1) and r.acc_at_threshold == pytest.approx(1 / 3) and r.mean_iou == pytest.approx(1.25 / 3)
    assert tuple(evaluate.evaluate(truth.limit(0), p).first()) == (None,) * 5
    with pytest.raises(Exception, match="invalid truth"):
        evaluate.evaluate(predictions(spark, [("a", [0.5, 0.0, 0.1, 1.0])]), p).collect()


def fused(spark, boxes, weights, threshold=0.55):
    sets = [(predictions(spark, [("k", b)]), w) for b, w in zip(boxes, weights)]
    return fusion.fuse(sets, threshold).first().bbox


def test_fusion_cases(spark):
    a, b = [0.0, 0.0, 0.4, 0.4], [0.2, 0.2, 0.6, 0.6]
    assert fused(spark, [a, b], [1, 1], 0.1) == [0.1, 0.1, 0.5, 0.5]
    assert fused(spark, [a, b], [3, 1], 0.1)[0] == pytest.approx(0.05) and fused(spark, [a, b], [3, 1], 0.1)[2] == pytest.approx(0.45)
    near = [0.1, 0.1, 0.5, 0.5], [0.15, 0.15, 0.55, 0.55]
    assert fused(spark, near, [1, 1]) == [0.125, 0.125, 0.525, 0.525]
    heavy = [0.7, 0.7, 0.9, 0.9]
    assert fused(spark, [heavy, *near], [1.5, 1, 1]) == [0.125, 0.125, 0.525, 0.525]
    assert fused(spark, [None, [0.5, 0.1, 0.2, 0.3], [0.1]], [1, 1, 1]) is None and fused(spark, [a], [0]) is None
    got = {r.key: r.bbox for r in fusion.fuse([(predictions(spark, [("q1", a), ("q2", b)]), 1), (predictions(spark, [("q1", None), ("q3", a)]), 1)]).collect()}
    assert got == {"q1": a, "q2": b, "q3": a}
    with pytest.raises(ValueError):
        fusion.fuse([(predictions(spark, []), 1)], 0)


def plain_iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def test_fusion_against_a_plain_fold(spark):
    rng = random.Random(5)
    weights, threshold = [1.0, 2.0, 2.0, 0.0, 1.5], 0.4
    keys = [f"k{n}" for n in range(150)]
    sets = []
    for _ in weights:
        rows = []
        for n, k in enumerate(keys):
            if rng.random() < 0.8:
                x, y = n % 5 * 0.1 + rng.choice([0, 0.02, 0.1, 0.3]), rng.choice([0.1, 0.12, 0.4])
                rows.append((k, rng.choice([[x, y, x + 0.3, y + 0.3]] * 6 + [None, [x, y], [0.5, 0.5, 0.4, 0.6], [float("nan"), 0.1, 0.2, 0.3]])))
        sets.append(rows)
    got = {r.key: r.bbox for r in fusion.fuse([(predictions(spark, r), w) for r, w in zip(sets, weights)], threshold, rounded=g.round6_exact).collect()}
    for k in keys:
        held = [(w, dict(s)[k]) for w, s in zip(weights, sets) if k in dict(s)]
        if not held:
            assert k not in got
            continue
        ok = [(w, b) for w, b in held if w > 0 and b is not None and len(b) == 4 and all(0 <= v <= 1 for v in b) and b[0] < b[2] and b[1] < b[3]]
        clusters = []
        for w, b in sorted(ok, key=lambda m: -m[0]):
            scores = [max(plain_iou(o, b) for _, o in c) for c in clusters]
            if scores and max(scores) > threshold:
                clusters[scores.index(max(scores))].append((w, b))
            else:
                clusters.append([(w, b)])
        if not clusters:
            assert got[k] is None
            continue
        c = max(clusters, key=lambda c: sum(w for w, _ in c))
        total = sum(w for w, _ in c)
        assert got[k] == [round(sum(w * b[n] for w, b in c) / total, 6) for n in range(4)]


def test_submission(spark):
    template = spark.createDataFrame([("a", "q1"), ("b", "q2")], "key string, query string")
    good = predictions(spark, [("a", UNIT), ("b", UNIT)])
    assert submission.build_submission(template, good).columns == ["key", "query", "bbox"]
    for bad in ([("a", UNIT)], [("a", UNIT), ("b", [0.5, 0.5, 0.4, 0.6])], [("a", UNIT), ("b", UNIT), ("c", UNIT)]):
        with pytest.raises(ValueError):
            submission.build_submission(template, predictions(spark, bad))
    filled = {r.key: r.bbox for r in submission.build_submission(template, predictions(spark, [("a", UNIT)]), allow_fallback=True).collect()}
    assert filled == {"a": UNIT, "b": [0.0, 0.0, 0.001, 0.001]}


def test_scene_shards(spark):
    rows = [(f"{s}_{k}", s) for s, n in (("001", 5), ("002", 3), ("003", 2)) for k in range(n)]
    df = spark.createDataFrame(rows, "key string, scene string")
    got = sharding.shard_scenes(df, 2).collect()
    assert sorted(r.key for r in got) == sorted(k for k, _ in rows)
    assert {r.scene: r.shard for r in got} == {"001": 0, "002": 1, "003": 1}
    assert {r.shard for r in sharding.shard_scenes(df, 10).collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        sharding.shard_scenes(df, 2, only=["009"])
    assert {r.scene for r in sharding.shard_scenes(df, 2, only=["002"]).collect()} == {"002"}


def test_seeded_splits(spark):
    df = spark.createDataFrame([(k, f"{k % 10:03d}") for k in range(100)], "key long, scene string")
    ids = sorted({f"{k:03d}" for k in range(10)})
    random.Random(42).shuffle(ids)
    got = {r.scene: r.split for r in splits.split_groups(df, "scene").collect()}
    assert got == {s: "train" if k < 8 else "val" for k, s in enumerate(ids)}
    assert {r.scene for r in splits.sample_groups(df, "scene", 3).collect()} == set(ids[:3]) and splits.sample_groups(df, "scene", None).count() == 100
    with pytest.raises(ValueError):
        splits.sample_groups(df, "scene", 0)
    with pytest.raises(ValueError):
        splits.split_groups(df.where("scene = '001'"), "scene")


def test_replay_against_a_plain_loop(spark):
    import json

    rng = random.Random(7)
    lines = []
    for n in range(1500):
        r = {"id": f"i{rng.randrange(120)}", "annotator": rng.choice(["a", "b", "seed", "a:absent", "b:todo"]), "ts": str(n)}
        kind = rng.random()
        if kind < 0.6:
            r["bbox"] = rng.choice([[0.1, 0.2, 0.3, n / 2000], None, [0.1, 0.2], [0.1, 0.2, 0.3, "x"], "no"])
        if kind > 0.4:
            r["query"] = rng.choice(["", f"q{n}", None])
        text = json.dumps(r)
        lines.append(rng.choice([text] * 12 + [text[:-9], "", "[1]", '{"bbox": null}', '{"id": ""}']))
    boxes, queries, meta, touched = {}, {}, {}, set()
    absent = set()
    for line in lines:
        try:
            r = json.loads(line)
        except ValueError:
            continue
        if not isinstance(r, dict) or not r.get("id"):
            continue
        i = r["id"]
        touched.add(i)
        if r.get("query"):
            queries[i] = r["query"]
        who = (r.get("annotator"), r.get("ts"))
        if "bbox" not in r:
            meta.setdefault(i, who)
        elif r["bbox"] is None:
            boxes.pop(i, None)
            if who[0].endswith(":absent"):
                meta[i] = who
                absent.add(i)
            else:
                meta.pop(i, None)
                absent.discard(i)
        elif isinstance(r["bbox"], list) and len(r["bbox"]) == 4 and all(isinstance(v, float) for v in r["bbox"]):
            boxes[i] = r["bbox"]
            meta[i] = who
            absent.discard(i)
    want = {i: (boxes.get(i), queries.get(i), i in absent, *meta.get(i, (None, None))) for i in touched}
    df = spark.createDataFrame(list(enumerate(lines)), "pos long, line string")
    got = {r.id: tuple(r)[1:] for r in journal.replay(journal.parse_records(df)).collect()}
    assert got == want and len(want) > 100


def test_merge_needs_a_size_for_new_rows(spark):
    active = spark.createDataFrame([("001_1", "v", "i", "d", UNIT, 4, 3, "q")], "id string, visible string, infrared string, depth string, bbox array<double>, width int, height int, query string")
    state = spark.createDataFrame([("002_7", UNIT, "new", False, "ann:todo", "1")], "id string, bbox array<double>, query string, absent boolean, annotator string, ts string")
    with pytest.raises(Exception, match="no image size"):
        journal.merge(active, state).collect()
    sizes = spark.createDataFrame([("Raw/002/color/7.png", 8, 6)], "visible string, width int, height int")
    new = {r.id: r for r in journal.merge(active, state, sizes).collect()}["002_7"]
    assert (new.infrared, new.width, new.query) == ("Raw/002/infrared/7.png", 8, "")


def test_written_lines_read_back(spark):
    edits = spark.createDataFrame([("a", True, UNIT, None, "x", "1"), ("b", True, None, None, "x:absent", "2"), ("c", False, None, "q", "x", "3")], "id string, has_bbox boolean, bbox array<double>, query string, annotator string, ts string")
    lines = journal.as_lines(edits).select(F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
    back = {r.id: (r.has_bbox, r.bbox, r.query) for r in journal.parse_records(lines).collect()}
    assert back == {"a": (True, UNIT, None), "b": (True, None, None), "c": (False, None, "q")}


def test_session_ordinals(spark):
    df = spark.createDataFrame([("001_a#02", "x/1.png"), ("001_a#z", "x/1.png"), ("001_b", "x/1.png"), ("001_c", "x/1.png"), ("solo", None)], "id string, visible string").selectExpr("*", "'q' AS query", "CAST(NULL AS ARRAY<DOUBLE>) AS bbox", "CAST(NULL AS STRING) AS category", "CAST(NULL AS STRING) AS annotator")
    got = {r.id: (r.ordinal, r.frame_id) for r in session.items(df, "val").collect()}
    assert got == {"001_a#02": (2, "001_1"), "001_a#z": (1, "001_1"), "001_b": (1, "001_1"), "001_c": (2, "001_1"), "solo": (1, "solo")}


META = {"status": "approved", "protocol_version": 13, "split": "val", "sample_count": 2, "sequence_count": 1, "provenance": {"source_type": "human_annotated"}}


def artifact(spark, **change):
    import json

    rows = []
    for n in range(2):
        item = {"visible": f"Raw/001/color/{n}.png", "infrared": "i", "depth": "d", "query": "the small red chair", "bbox": [0.1, 0.2, 0.3, 0.4], "width": 640, "height": 480} | change
        item = {k: v for k, v in item.items() if v != "drop"}
        rows.append((n, f"001_{n}", json.dumps(item), item.get("visible"), item.get("query"), item.get("bbox")))
    return spark.createDataFrame(rows, "pos int, id string, raw string, visible string, query string, bbox array<double>")


def test_artifact_contract(spark):
    good = artifact(spark)
    assert contract.artifact_fault(META, good, "val") is None
    from boxlore.functions import hashing

    assert contract.artifact_fault(META | {"dataset_fingerprint": hashing.dataset_fingerprint(good), "source_fingerprint": hashing.source_fingerprint(good)}, good, "val") is None
    for change, want in (
        ({"status": "draft"}, "status or protocol"), ({"split": "train"}, "split"), ({"more": 1}, "metadata schema"), ({"provenance": {"source_type": "seed"}}, "provenance"),
        ({"qc": {"complete": False}}, "qc"), ({"sample_count": True}, "counts"), ({"sample_count": 3}, "sample count"), ({"sequence_count": 2}, "sequence count"), ({"prompt_hash": ""}, "fingerprint"), ({"dataset_fingerprint": "x"}, "dataset fingerprint"),
    ):
        assert contract.artifact_fault(META | change, good, "val") == want
    assert contract.artifact_fault(META | {"run_id": "a"}, good, "val", run_id="b") == "run id"
    assert contract.artifact_fault(META, artifact(spark, depth="drop"), "val") == "field schema"
    assert contract.artifact_fault(META, artifact(spark, query="the thing"), "val").startswith("query: 001_0: query uses generic category")
    assert contract.artifact_fault(META, artifact(spark, query=""), "val").startswith("query: 001_0: empty query (2")
    assert contract.artifact_fault(META, artifact(spark, query=""), "val", allow_pending=True) == "no annotated sample"
    assert contract.artifact_fault(META, artifact(spark, bbox=[0.5, 0.2, 0.3, 0.4]), "val") == "bad_bbox: 2"


def test_resume(spark):
    a = predictions(spark, [("k", None), ("m", UNIT)])
    b = predictions(spark, [("k", UNIT), ("m", UNIT), ("n", None)])
    got = {r.key: r.conflict for r in resume.unite([a, b]).collect()}
    assert got == {"k": True, "m": False, "n": False} and {r.key: r.conflict for r in resume.unite([a, b], disjoint=True).collect()} == {"k": True, "m": True, "n": False}
    with pytest.raises(Exception, match="conflicting"):
        resume.checked(resume.unite([a, b])).collect()


def test_adapters(spark):
    class Halves:
        """Answers with the left half, and nothing for the word ``none``."""

        def load(self):
            self.seen = 0

        def predict(self, rows):
            return [None if r["query"] == "none" else [0.0, 0.0, 0.5 if r["query"] != "odd" else -1.0, 1.0] for r in rows]

    inference.register("halves", Halves)
    items = spark.createDataFrame([("a", "v1", "x"), ("b", "v1", "none"), ("c", "v2", "odd"), ("d", "v2", "y")], "key string, visible string, query string")
    got = {r.key: r.bbox for r in inference.predict(items, "halves", decode=str.upper).collect()}
    assert got == {"a": [0.0, 0.0, 0.5, 1.0], "b": None, "c": None, "d": [0.0, 0.0, 0.5, 1.0]}
    saved = predictions(spark, [("a", None)])
    assert {r.key: r.bbox for r in inference.continue_run(items, saved, "halves").collect()}["a"] is None
    assert inference.available() == ["halves", "stand-in"]
    with pytest.raises(ValueError, match="stand-in"):
        inference.predict(items, "nothing")


def test_retention(spark):
    df = spark.createDataFrame([(f"step_{n}",) for n in (50, 100, 150, 200, 1000)] + [("epoch_1",), ("step_x",)], "name string")
    names = lambda keep: {r.name for r in training.to_prune(df, "step_", keep).collect()}
    assert names(2) == {"step_50", "step_100", "step_150", "step_x"} and len(names(0)) == 6
    with pytest.raises(ValueError):
        names(-1)


def test_invalid_training_box_raises(spark):
    assert training.require_valid_boxes(predictions(spark, [("a", UNIT)])).count() == 1
    with pytest.raises(Exception, match="invalid box"):
        training.require_valid_boxes(predictions(spark, [("a", [0.5])])).collect()
