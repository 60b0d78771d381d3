"""One JSON object read by ranges, against Python's parser, wherever the ranges are cut."""

import json
import random

import numpy as np
import pytest

from boxlore.sources import jsonparts, readers
from boxlore.sources.jsonparts import JsonObject


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "4")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")

    yield cut
    for key, value in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"), before):
        spark.conf.set(key, value)


def random_value(rng, deep=0):
    kind = rng.randrange(9 if deep < 4 else 6)
    if kind < 3:
        return "".join(rng.choice(['"', "\\", ",", "{", "}", "[", "]", ":", "é", "漢", " ", "a", "\n", "\\\\", '\\"']) for _ in range(rng.choice([0, 1, 3, 12])))
    if kind < 6:
        return rng.choice([None, True, 1, -2.5, 1e-7, 10**12])
    if kind < 8:
        return {f'k{n}"\\,{rng.randrange(5)}': random_value(rng, deep + 1) for n in range(rng.randrange(4))}
    return [random_value(rng, deep + 1) for _ in range(rng.randrange(4))]


def same(raw, value):
    return raw == value if isinstance(value, str) else raw is None if value is None else json.loads(raw) == value


def test_members_wherever_ranges_are_cut(spark, tmp_path, small_splits):
    rng = random.Random(1)
    for trial, size in enumerate((11, 40, 97, 1000)):
        small_splits(size)
        value = {f"é{n},\"{rng.choice('{}[]')}\\": random_value(rng) for n in range(25)}
        path = tmp_path / f"o{trial}.json"
        path.write_text(" \n" + json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) + "\n", encoding="utf-8")
        got = readers.json_object(spark, str(path)).orderBy("pos").collect()
        assert [(r.pos, r.key) for r in got] == list(enumerate(value)) and all(same(r.raw, value[r.key]) for r in got)


def test_ranges_are_many_and_a_member_lies_across_them(spark, tmp_path, small_splits):
    small_splits(50)
    value = {"a": list(range(400)), "b": "x" * 500, "c": {"d": [1, 2, 3]}}
    path = tmp_path / "o.json"
    path.write_text(json.dumps(value))
    found = JsonObject(spark, str(path))
    assert len(found.known) > 20
    assert {r.key: r.raw if r.key == "b" else json.loads(r.raw) for r in found.members().collect()} == value
    assert found.keys() == {"a": 0, "b": 1, "c": 2}


def test_what_a_member_holds(spark, tmp_path, small_splits):
    rng = random.Random(2)
    small_splits(60)
    for place in range(3):
        data = {f"k{n},": random_value(rng) for n in range(20)}
        rows = [{"a": n, "b": [1, {"c": ",}"}]} for n in range(15)]
        members = [("metadata", {"x": [1, 2], "data": {"y": 1}}), ("z", "}, {")]
        members.insert(place, ("data", data))
        members.insert(rng.randrange(4), ("records", rows))
        path = tmp_path / f"w{place}.json"
        path.write_text(json.dumps(dict(members), indent=rng.choice([None, 1])))
        found = JsonObject(spark, str(path))
        got = found.within("data").orderBy("pos").collect()
        assert [(r.pos, r.key) for r in got] == list(enumerate(data)) and all(same(r.raw, data[r.key]) for r in got)
        assert [json.loads(r.raw) for r in found.within("records", "list").orderBy("pos").collect()] == rows
        assert found.within("metadata").count() == 2


def test_empty_and_wrong_objects(spark, tmp_path, small_splits):
    small_splits(30)
    path = tmp_path / "a.json"

    def read(text):
        path.write_text(text)
        return [tuple(r) for r in readers.json_object(spark, str(path)).orderBy("pos").collect()]

    assert read("{}") == read(" {\n} ") == [] and read('{"a": {}}') == [(0, "a", "{}")] and read('{"a":[],"b":""}') == [(0, "a", "[]"), (1, "b", "")]
    bad = ('{"a": 1, "a": 2}', '{"a": {"b": 1, "b": 2}}', "[1]", "{", "", "5", '"{}"', '{"a":1,}', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1]', '{"a" 1}', '{"a":1 "b":2}', '{"a":1}}', '{"a":"x}', "{1:2}", '{"a":1} x')
    for text in bad:
        with pytest.raises(Exception):
            read(text)
    path.write_text(json.dumps({"data": {}, "records": []}))
    found = JsonObject(spark, str(path))
    assert found.within("data").count() == found.within("records", "list").count() == 0


def test_a_folder_of_files_is_one_object(spark, tmp_path):
    rows = [(n, f"k{n}", json.dumps({"n": n, "t": '",{'})) for n in range(50)]
    df = spark.createDataFrame(rows, "pos long, key string, raw string")
    from boxlore.sinks import writers

    writers.write_object(df.repartition(5), f"{tmp_path}/o", "pos")
    got = readers.json_object(spark, f"{tmp_path}/o").orderBy("pos").collect()
    assert [(r.pos, r.key, json.loads(r.raw)) for r in got] == [(n, k, json.loads(raw)) for n, k, raw in rows]
    writers.write_object(df.limit(0), f"{tmp_path}/e", "pos")
    assert readers.json_object(spark, f"{tmp_path}/e").count() == 0


def test_members_are_cut_once(spark, tmp_path, monkeypatch):
    """What is read of the members does not scan the text again: it is passed over three times, to be told, counted and cut."""
    path = tmp_path / "o.json"
    path.write_text(json.dumps({f"k{n}": {"visible": f"Images/visible/{n}.png", "query": f"the {n}"} for n in range(70)}))
    passes = []
    own = jsonparts.JsonObject._cut
    monkeypatch.setattr(jsonparts.JsonObject, "_cut", lambda *a, **k: passes.append(1) or own(*a, **k))
    items = readers.inference_items(spark, str(path))
    assert [(r.pos, r.key, r.visible) for r in items.orderBy("pos").collect()] == [(n, f"k{n}", f"Test/Images/visible/{n}.png") for n in range(70)]
    assert len(passes) == 1 and "MapInArrow" not in items._jdf.queryExecution().executedPlan().toString()


def test_marks():
    data = np.frombuffer(b',"a\\"{" {[ "\\\\" ]},"', np.uint8)
    quoted, deeper = jsonparts._marks(data)
    outside = [chr(c) for c, q in zip(data, quoted) if not q]
    assert "".join(outside).replace('"', "") == ", {[  ]}," and deeper[~quoted].sum() == 0


def test_text_is_read_twice_and_members_are_sent_together(spark, tmp_path, monkeypatch):
    """One pass tells the ranges and counts their members, one cuts them; what lies side by side is one row until it is parsed."""
    value = {f"k{n}": [n + 0.5, 0.5, 1, 2] if n % 7 else None for n in range(5000)}
    path = tmp_path / "o.json"
    path.write_text(json.dumps(value))
    passes, texts = [], jsonparts._texts

    class Counted:
        def __init__(self, df):
            self.df = df

        def mapInArrow(self, *a):
            passes.append(self.df.mapInArrow(*a))
            return passes[-1]

    monkeypatch.setattr(jsonparts, "_texts", lambda *a: Counted(texts(*a)))
    got = readers.predictions(spark, str(path)).collect()
    assert {r.key: r.bbox for r in got} == value and len(got) == 5000
    assert len(passes) == 2 and passes[1].count() < 50


def test_counts_of_a_range_are_those_of_its_parts():
    rng = random.Random(3)
    for _ in range(200):
        data = np.frombuffer("".join(rng.choice('{}[],"a \\') for _ in range(rng.randrange(1, 40))).encode(), np.uint8)
        quoted, depth = np.array([rng.random() < 0.3 for _ in data]), np.cumsum([rng.choice((-1, 0, 1)) for _ in data])
        k = rng.randrange(len(data) + 1)
        parts = [jsonparts._least(data[s], quoted[s], depth[s]) for s in (slice(0, k), slice(k, None))]
        assert jsonparts._least_of(*parts) == jsonparts._least(data, quoted, depth)


def test_repeated_keys_and_blanks_among_members_side_by_side(spark, tmp_path):
    path = tmp_path / "o.json"
    for bad in ('"b": {"x": 1, "x": 2}', '"b": {"y": [{"x": 1, "x": 1}]}', '"k3": 0', "", '"b"', '"b": NaN', "'b': 1", '"b": 1 2'):
        path.write_text("{" + ", ".join([*(f'"k{n}": {n}' for n in range(9)), bad, '"z": 1']) + "}")
        with pytest.raises(Exception):
            readers.json_object(spark, str(path)).collect()
