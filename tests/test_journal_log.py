"""The journal as a log of appends: their order, many writers, splits by bytes, and streams that cut it anywhere."""

import json
import os
import random
import threading

import pytest

from boxlore.operators import journal
from boxlore.sinks import commit, writers
from boxlore.sources import readers
from boxlore.streaming import journal as stream
from boxlore.streaming.source import JournalReader


def lines_of(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def plain(lines):
    """The replay's rules record by record: id to (bbox, query, absent, annotator, ts)."""
    state, queries, meta, absent = {}, {}, {}, set()
    seen = []
    for line in lines:
        try:
            r = json.loads(line)
        except ValueError:
            continue
        if not isinstance(r, dict) or not isinstance(r.get("id"), str) or not r["id"]:
            continue
        i = r["id"]
        seen.append(i)
        if r.get("query"):
            queries[i] = r["query"]
        if "bbox" not in r:
            meta.setdefault(i, (r.get("annotator"), r.get("ts")))
        elif r["bbox"] is None:
            state.pop(i, None)
            if (r.get("annotator") or "").endswith(":absent"):
                meta[i] = (r["annotator"], r.get("ts"))
                absent.add(i)
            else:
                meta.pop(i, None)
                absent.discard(i)
        elif isinstance(r["bbox"], list) and len(r["bbox"]) == 4:
            try:
                state[i] = [float(v) for v in r["bbox"]]
            except (TypeError, ValueError):
                continue
            meta[i] = (r.get("annotator"), r.get("ts"))
            absent.discard(i)
    return {i: (state.get(i), queries.get(i), i in absent, *meta.get(i, (None, None))) for i in seen}


def random_line(rng, n):
    r = {"id": f"00{rng.randrange(3)}_{rng.randrange(12)}"}
    if rng.random() < 0.6:
        r["annotator"] = rng.choice([None, "ann", "b:absent", "c:todo"])
    if rng.random() < 0.6:
        r["ts"] = rng.choice([None, str(n)])
    if rng.random() < 0.6:
        r["bbox"] = rng.choice([[0.1, 0.2, 0.3, n / 1e4], None, None, [1], [1, True, "2.5", 3], [1, None, 2, 3], "abcd", {"a": 1}])
    if rng.random() < 0.5:
        r["query"] = rng.choice([f"q{n} é", "", None])
    return rng.choice([json.dumps(r, ensure_ascii=False)] * 12 + ['{"id": "torn', "", "[1]", '{"id": 5, "bbox": null}', '{"id": {"a": 1}}', '{"id": ""}'])


def replayed(spark, path):
    return {r.id: tuple(r)[1:] for r in journal.replay(journal.parse_records(readers.json_lines(spark, path))).collect()}


def test_the_last_append_counts(spark, tmp_path):
    for trial in range(4):
        path = f"{tmp_path}/j{trial}"
        for k in range(4):
            assert writers.append_journal(lines_of(spark, [json.dumps({"id": "a", "query": f"q{k}", "bbox": [k, 0, 9, 9]})]), path) == k + 1
        assert replayed(spark, path) == {"a": ([3.0, 0.0, 9.0, 9.0], "q3", False, None, None)}


def test_random_appends_in_parts_and_splits(spark, tmp_path):
    rng = random.Random(4)
    path, every = str(tmp_path / "j"), []
    for _ in range(6):
        own = [random_line(rng, len(every) + k) for k in range(rng.choice([0, 1, 40, 200]))]
        writers.append_journal(lines_of(spark, own).coalesce(rng.choice([1, 4])), path)
        every += own
    one = tmp_path / "one.jsonl"
    one.write_text("".join(f"{x}\n" for x in every), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert readers.json_lines(spark, str(one)).rdd.getNumPartitions() > 5
        got = readers.json_lines(spark, path).orderBy("pos").collect()
        assert [r.line for r in got] == every and [r.line for r in readers.json_lines(spark, str(one)).orderBy("pos").collect()] == every
        assert replayed(spark, path) == replayed(spark, str(one)) == plain(every)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_thousand_appends_of_two_writers(spark, tmp_path):
    """The entries as the writers make them, without Spark's job for each; the log is one order that both writers' own keep."""
    path = tmp_path / "j"
    path.mkdir()
    taken = {0: [], 1: []}

    def write(who):
        for k in range(500):
            staged = commit.staging(str(path))
            os.mkdir(staged)
            with open(f"{staged}/part-00000", "w") as f:
                f.write(json.dumps({"id": f"{who}", "query": f"q{k}"}) + "\n" + json.dumps({"id": "both", "query": f"{who}.{k}"}) + "\n")
            taken[who].append(commit.add_entry(spark, str(path), staged))

    writers_ = [threading.Thread(target=write, args=(w,)) for w in (0, 1)]
    for t in writers_:
        t.start()
    for t in writers_:
        t.join()
    assert sorted(taken[0] + taken[1]) == list(range(1, 1001)) and all(x == sorted(x) for x in taken.values())
    last = 0 if taken[0][-1] == 1000 else 1
    assert {i: s[1] for i, s in replayed(spark, str(path)).items()} == {"0": "q499", "1": "q499", "both": f"{last}.499"}


def test_an_append_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "j")
    writers.append_journal(lines_of(spark, ['{"id": "a", "query": "q"}']), path)
    bad = spark.range(100).selectExpr("CAST(if(id = 99, raise_error('no'), 'x') AS STRING) AS value")
    with pytest.raises(Exception, match="no"):
        writers.append_journal(bad, path)
    assert os.listdir(path) == ["000000000001"] and list(replayed(spark, path)) == ["a"]
    os.makedirs(f"{path}/_staged-x")  # what a dead writer leaves
    with open(f"{path}/_staged-x/part-00000", "w") as f:
        f.write('{"id": "z", "query": "q"}\n')
    assert list(replayed(spark, path)) == ["a"]


def test_files_without_an_order_are_refused(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text('{"id": "a", "query": "x"}\n')
    with pytest.raises(ValueError, match="no order"):
        readers.json_lines(spark, str(tmp_path))
    assert readers.json_lines(spark, str(tmp_path / "none")).count() == 0


def test_stream_cut_anywhere_is_the_batch(spark, tmp_path):
    rng = random.Random(9)
    for trial in range(2):
        path, every, seen = str(tmp_path / f"j{trial}"), [], {}
        os.makedirs(path)

        def keep(batch, number):
            seen.update({r.id: tuple(r)[1:] for r in batch.collect()})

        fixed = [json.dumps({"id": "x", "bbox": [1, 2, 3, 4]}), json.dumps({"id": "x", "query": "q", "annotator": "ann"})]
        for k in range(4):
            for _ in range(rng.choice([1, 2])):
                own = [random_line(rng, len(every) + j) for j in range(rng.choice([1, 5, 60]))] + fixed[k : k + 1]
                writers.append_journal(lines_of(spark, own).coalesce(rng.choice([1, 3])), path)
                every += own
            q = stream.live_state(stream.tail(spark, path)).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c{trial}").foreachBatch(keep).trigger(availableNow=True).start()
            q.awaitTermination()
            assert seen == plain(every) == replayed(spark, path)


def test_offsets_do_not_grow_with_the_log(tmp_path):
    for n in range(1, 30):
        os.makedirs(commit.entry(str(tmp_path), n))
        for part in (100000, 2, 10):
            with open(f"{commit.entry(str(tmp_path), n)}/part-{part:05d}-x", "w") as f:
                f.write(f"{n}.{part}\n")
    reader = JournalReader(str(tmp_path), 3)
    assert reader.latestOffset() == {"entry": 29, "files": {}}
    got = sorted(r for p in reader.partitions({"entry": 26, "files": {}}, {"entry": 28, "files": {}}) for r in reader.read(p))
    assert [x for _, x in got] == ["27.2", "27.10", "27.100000", "28.2", "28.10", "28.100000"]
