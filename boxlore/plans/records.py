"""Queries on records: the annotation journal, sessions, splits, shards, contracts, bookkeeping, hashes."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import hashing, schedule
from ..operators import contract, inference, journal, session, sharding, splits, training
from .boxes import TRUTH_SQL, truth
from .registry import query, table

# ---- journal ------------------------------------------------------------------------------------------------------

_V = "CAST(CAST(floor(value) AS BIGINT) % 50 AS DOUBLE) / 100"
_ANN = "CASE WHEN event_type = 'signup' THEN 'ann' || CAST(event_id % 3 AS VARCHAR) || ':absent' WHEN event_id % 4 = 0 THEN 'seed' WHEN event_id % 9 = 5 THEN 'ann:todo' ELSE 'ann' || CAST(event_id % 3 AS VARCHAR) END"
_QUERY = "CASE WHEN event_type = 'click' AND event_id % 5 <> 0 THEN 'q' || CAST(event_id AS VARCHAR) WHEN event_type = 'click' THEN '' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'v' || CAST(event_id AS VARCHAR) END"
#: Users are items here, numbered so that some are in the dataset and some are not.
_ITEM = "lpad(CAST(user_id * 13 % 40 AS VARCHAR), 3, '0') || '_' || lpad(CAST(user_id * 13 AS VARCHAR), 9, '0')"
_TYPED = f"e AS (SELECT event_id AS pos, {_ITEM} AS id, event_type <> 'click' AND NOT (event_type = 'view' AND event_id % 13 = 0) AS has, event_type IN ('purchase', 'view') AS boxed, {_V} AS v, nullif({_QUERY}, '') AS query, {_ANN} AS annotator, CAST(event_id AS VARCHAR) AS ts FROM events)"
#: The state after the records: the last box event, the query, and who is named.
_REPLAY = f"""
{_TYPED},
l AS (SELECT *, max(CASE WHEN has THEN pos END) OVER (PARTITION BY id) AS last FROM e),
s AS (SELECT id, max_by(boxed, pos) FILTER (has) AS boxed, max_by(v, pos) FILTER (has) AS v, max_by(annotator, pos) FILTER (has) AS e_ann, max_by(ts, pos) FILTER (has) AS e_ts,
             max_by(query, pos) FILTER (query IS NOT NULL) AS query,
             min_by(annotator, pos) FILTER (NOT has AND NOT broken AND (last IS NULL OR pos > last)) AS a_ann, min_by(ts, pos) FILTER (NOT has AND NOT broken AND (last IS NULL OR pos > last)) AS a_ts
      FROM (SELECT *, boxed AND NOT has AS broken FROM l) GROUP BY id),
r AS (SELECT id, CASE WHEN boxed THEN v END AS x1, query, coalesce(NOT boxed AND e_ann LIKE '%:absent', FALSE) AS absent,
             CASE WHEN boxed OR (NOT boxed AND e_ann LIKE '%:absent') THEN e_ann ELSE a_ann END AS annotator,
             CASE WHEN boxed OR (NOT boxed AND e_ann LIKE '%:absent') THEN e_ts ELSE a_ts END AS ts FROM s)"""


def _spark(e: str):
    return F.expr(e.replace("AS VARCHAR", "AS STRING"))


def journal_lines(spark, sf_dir):
    """(pos, line): the events as journal lines; some are torn, blank or no objects, some boxes have three numbers."""
    box = f"CASE WHEN event_type IN ('purchase', 'view') THEN CASE WHEN event_type = 'view' AND event_id % 13 = 0 THEN '[0.1, 0.2, 0.3]' ELSE '[' || CAST({_V} AS STRING) || ', 0.1, 0.9, 1]' END ELSE 'null' END"
    part = f"CASE WHEN event_type <> 'click' THEN ', \"bbox\": ' || {box} ELSE '' END || CASE WHEN {_QUERY} IS NOT NULL THEN ', \"query\": \"' || {_QUERY} || '\"' ELSE '' END"
    line = f"'{{\"id\": \"' || {_ITEM} || '\"' || {part} || ', \"annotator\": \"' || {_ANN} || '\", \"ts\": \"' || CAST(event_id AS STRING) || '\"}}'"
    e = table(spark, sf_dir, "events")
    good = e.select(F.col("event_id").alias("pos"), _spark(line).alias("line"))
    bad = e.where("event_id % 10 = 0").select(F.col("event_id").alias("pos"), F.expr("CASE event_id % 4 WHEN 0 THEN '{\"id\": \"000_00' WHEN 1 THEN '  ' WHEN 2 THEN '[1, 2]' ELSE '{\"bbox\": null}' END").alias("line"))
    return good.unionAll(bad)


def _state(spark, sf_dir):
    return journal.replay(journal.parse_records(journal_lines(spark, sf_dir)))


@query(f"WITH {_REPLAY} SELECT * FROM r")
def journal_replay(spark, sf_dir):
    return _state(spark, sf_dir).select("id", F.get("bbox", 0).alias("x1"), "query", "absent", "annotator", "ts")


@query(f"WITH {_TYPED} SELECT id, pos, has, query FROM e WHERE NOT (boxed AND NOT has) UNION ALL SELECT id, pos, NULL, query FROM e WHERE boxed AND NOT has")
def journal_parse(spark, sf_dir):
    return journal.parse_records(journal_lines(spark, sf_dir)).select("id", "pos", F.col("has_bbox").alias("has"), "query")


_DATA_ID = "lpad(CAST(c_custkey % 40 AS VARCHAR), 3, '0') || '_' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')"
_DATA = f"d AS (SELECT {_DATA_ID} AS id, 'Raw/' || lpad(CAST(c_custkey % 40 AS VARCHAR), 3, '0') || '/color/' || CAST(c_custkey // 7 AS VARCHAR) || '.png' AS visible, CASE WHEN c_custkey % 5 <> 0 THEN CAST(0.5 AS DOUBLE) END AS x1, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_name END AS query, CASE WHEN c_custkey % 8 = 0 THEN 'human' WHEN c_custkey % 8 = 1 THEN '' END AS annotator FROM customer)"


def _dataset(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    seq = F.lpad((F.col("c_custkey") % 40).cast("string"), 3, "0")
    box = F.when(F.col("c_custkey") % 5 != 0, F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9), F.lit(1.0)))
    return c.select(
        _spark(_DATA_ID).alias("id"), F.concat(F.lit("Raw/"), seq, F.lit("/color/"), F.floor(F.col("c_custkey") / 7).cast("string"), F.lit(".png")).alias("visible"), box.alias("bbox"),
        F.when(F.col("c_custkey") % 6 == 0, "").otherwise(F.col("c_name")).alias("query"), F.expr("CASE WHEN c_custkey % 8 = 0 THEN 'human' WHEN c_custkey % 8 = 1 THEN '' END").alias("annotator"), F.lit("cat").alias("category"),
    )


@query(
    f"""WITH {_REPLAY}, {_DATA},
m AS (SELECT coalesce(d.id, r.id) AS id, d.id IS NULL AS new, coalesce(r.x1 IS NOT NULL AND r.query <> '', FALSE) AS full_, coalesce(r.absent, FALSE) AS absent, d.visible, d.x1 AS dx, d.query AS dq, r.x1 AS rx, r.query AS rq, r.annotator FROM d FULL OUTER JOIN r ON d.id = r.id)
SELECT id, CASE WHEN new THEN 'Raw/' || split_part(id, '_', 1) || '/color/' || split_part(id, '_', 2) || '.png' ELSE visible END AS visible, CASE WHEN full_ THEN rx ELSE dx END AS x1,
       CASE WHEN full_ THEN CASE WHEN annotator LIKE '%:todo' THEN '' ELSE rq END ELSE dq END AS query FROM m WHERE (NOT absent OR full_) AND (NOT new OR full_)"""
)
def journal_merge(spark, sf_dir):
    d = _dataset(spark, sf_dir).select("id", "visible", F.lit("i").alias("infrared"), F.lit("d").alias("depth"), "bbox", F.lit(4).alias("width"), F.lit(3).alias("height"), "query")
    state = _state(spark, sf_dir)
    path = F.concat(F.lit("Raw/"), F.split_part("id", F.lit("_"), F.lit(1)), F.lit("/color/"), F.split_part("id", F.lit("_"), F.lit(2)), F.lit(".png"))
    sizes = state.select(path.alias("visible"), F.lit(4).alias("width"), F.lit(3).alias("height"))
    return journal.merge(d, state, sizes).select("id", "visible", F.get("bbox", 0).alias("x1"), "query")


@query(f"WITH {_DATA} SELECT count(*) AS sample_count, count(DISTINCT split_part(id, '_', 1)) AS sequence_count FROM d")
def dataset_counts(spark, sf_dir):
    return journal.counts(_dataset(spark, sf_dir))


# ---- sessions -----------------------------------------------------------------------------------------------------

_ITEMS = f"""{_DATA}, i AS (SELECT id, visible AS image, query, split_part(id, '_', 1) || '_' || regexp_extract(visible, '([^/]+)\\.png$', 1) AS frame_id, x1 AS gt,
  CASE WHEN x1 IS NOT NULL AND query <> '' THEN 'annotated' ELSE 'pending' END AS status, nullif(annotator, '') AS ann FROM d),
it AS (SELECT id, image, query, row_number() OVER (PARTITION BY frame_id ORDER BY id) AS ordinal, frame_id, gt, status, coalesce(ann, CASE WHEN status = 'annotated' THEN 'human' END) AS annotator FROM i)"""
_LIVE = f"""{_REPLAY}, {_ITEMS}, v0 AS (SELECT it.*, r.x1 AS rx, r.query AS rq, r.annotator AS ra FROM it LEFT JOIN r ON it.id = r.id),
v1 AS (SELECT *, coalesce(rx, CASE WHEN NOT coalesce(ra LIKE '%:absent', FALSE) THEN gt END) AS x1 FROM v0),
v AS (SELECT id, image, coalesce(rq, query) AS query, rq IS NOT NULL AS query_edited, x1, coalesce(ra, annotator, CASE WHEN status = 'annotated' AND x1 IS NOT NULL THEN 'human' END) AS annotator, ordinal, frame_id, status FROM v1)"""


@query(f"WITH {_ITEMS} SELECT id, ordinal, frame_id, gt, status, annotator FROM it")
def session_items(spark, sf_dir):
    return session.items(_dataset(spark, sf_dir), "val").select("id", "ordinal", "frame_id", F.get("gt_bbox", 0).alias("gt"), "status", "annotator")


def _live(spark, sf_dir):
    return session.live(session.items(_dataset(spark, sf_dir), "val"), _state(spark, sf_dir))


@query(f"WITH {_LIVE} SELECT id, query, query_edited, x1, annotator, ordinal, frame_id, status FROM v")
def session_live(spark, sf_dir):
    return _live(spark, sf_dir).select("id", "query", "query_edited", F.get("bbox", 0).alias("x1"), "annotator", "ordinal", "frame_id", "status")


_HUMAN = "coalesce(annotator <> '' AND annotator NOT LIKE '%:absent' AND annotator NOT LIKE '%:todo' AND annotator <> 'seed', FALSE)"


@query(
    f"WITH {_LIVE}, f AS (SELECT frame_id, count(*) AS n, count(x1) AS boxed, count(*) FILTER ({_HUMAN}) AS human, bool_and(x1 IS NOT NULL AND {_HUMAN}) AS done FROM v GROUP BY frame_id) SELECT CAST(sum(n) AS BIGINT) AS total_items, CAST(sum(boxed) AS BIGINT) AS annotated, CAST(sum(human) AS BIGINT) AS human_annotated, count(*) AS total_frames, count(*) FILTER (done) AS reviewed_frames FROM f"
)
def session_progress(spark, sf_dir):
    return session.progress(_live(spark, sf_dir))


_PENDING = "coalesce(annotator IN ('', 'seed', 'seed:absent') OR annotator LIKE '%:todo', TRUE)"
_DONE = f"(NOT {_PENDING} AND x1 IS NOT NULL AND annotator NOT LIKE '%:absent')"


@query(
    f"WITH {_LIVE}, f AS (SELECT frame_id, count(*) AS n, count(*) FILTER ({_DONE}) AS human, count(*) FILTER (annotator LIKE '%:absent') AS absent, count(*) FILTER ({_PENDING}) AS pending, bool_and({_DONE} OR coalesce(annotator LIKE '%:absent', FALSE)) AS done FROM v GROUP BY frame_id), "
    "t AS (SELECT CAST(sum(human) AS BIGINT) AS human, CAST(sum(absent) AS BIGINT) AS absent, CAST(sum(pending) AS BIGINT) AS pending, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (done) AS done_frames, count(*) AS frames FROM f) SELECT *, CAST(CAST(CAST((human + absent) * 100 / CAST(total AS DOUBLE) AS DECIMAL(20,10)) AS DECIMAL(5,1)) AS DOUBLE) AS percent FROM t"
)
def session_review_progress(spark, sf_dir):
    return session.review_progress(_live(spark, sf_dir))


@query(f"WITH {_LIVE} SELECT id, row_number() OVER (ORDER BY id) AS number FROM v")
def session_positions(spark, sf_dir):
    return session.positions(_live(spark, sf_dir)).select("id", "number")


@query(f"WITH {_LIVE}, n AS (SELECT *, row_number() OVER (ORDER BY id) AS pos FROM v) SELECT coalesce(min(pos) FILTER ({_PENDING} AND pos > 100), min(pos) FILTER ({_PENDING})) AS pos FROM n")
def session_next_pending(spark, sf_dir):
    return session.next_pending(session.positions(_live(spark, sf_dir)).withColumnRenamed("number", "pos"), 100)


@query(f"WITH {_LIVE}, n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM v) SELECT 'id' AS kind, min(pos) FILTER (starts_with(id, '007')) AS pos FROM n UNION ALL SELECT 'path', min(pos) FILTER (contains(image, '/13.png')) FROM n UNION ALL SELECT 'number', min(pos) FILTER (pos = 11) FROM n")
def session_find(spark, sf_dir):
    p = session.positions(_live(spark, sf_dir)).withColumn("pos", F.col("number") - 1)
    one = lambda kind, text: session.find(p, text).select(F.lit(kind).alias("kind"), "pos")
    return one("id", "007").unionAll(one("path", "/13.png")).unionAll(one("number", "#12"))


@query(f"WITH {_LIVE} SELECT it.id, 'box' AS kind, coalesce(it.annotator, CASE WHEN it.status = 'annotated' THEN 'human' ELSE 'seed' END) AS value FROM it LEFT JOIN r ON it.id = r.id WHERE gt IS NOT NULL AND r.x1 IS NULL UNION ALL SELECT it.id, 'query', it.query FROM it LEFT JOIN r ON it.id = r.id WHERE it.query <> '' AND r.query IS NULL")
def session_seeds(spark, sf_dir):
    boxes, queries = journal.to_seed(session.items(_dataset(spark, sf_dir), "val"), _state(spark, sf_dir))
    value = F.col("annotator")
    return boxes.select("id", F.lit("box").alias("kind"), value.alias("value")).unionAll(queries.select("id", F.lit("query"), "query"))


_EDIT = "x AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'nobody' ELSE CAST(c_custkey AS VARCHAR) END AS id, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE 'ann' END AS annotator, CASE WHEN c_custkey % 7 = 0 THEN repeat('q', 201) WHEN c_custkey % 2 = 0 THEN 'q' END AS query, c_custkey % 11 AS b FROM customer)"


@query(f"WITH {_EDIT}, f AS (SELECT id, CASE WHEN id = 'nobody' THEN 404 WHEN annotator = ' ' OR length(query) > 200 OR b = 0 THEN 400 END AS status, CASE WHEN id = 'nobody' THEN 'unknown id' WHEN annotator = ' ' THEN 'annotator' WHEN length(query) > 200 THEN 'query' WHEN b = 0 THEN 'bbox' END AS fault FROM x) SELECT status, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY ALL")
def session_edit_faults(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    box = F.when(k % 11 == 0, F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5), F.lit(0.9))).when(k % 11 == 1, F.array(F.lit(-1.0), F.lit(0.0), F.lit(0.5), F.lit(2.0)))
    edits = c.select(F.when(k % 3 == 0, "nobody").otherwise(k.cast("string")).alias("id"), F.when(k % 5 == 0, " ").otherwise("ann").alias("annotator"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN repeat('q', 201) WHEN c_custkey % 2 = 0 THEN 'q' END").alias("query"), box.alias("bbox"))
    return journal.edit_faults(edits, c.select(k.cast("string").alias("id"))).groupBy("status", "fault").agg(F.count("*").alias("n"))


# ---- splits and shards --------------------------------------------------------------------------------------------

_SPLIT = "CASE WHEN CAST(CAST('0x' || substr(md5('42:' || CAST({g} AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) < 0.8 THEN 'train' ELSE 'val' END"


@query(f"SELECT o_orderkey AS key, {_SPLIT.format(g='o_custkey')} AS split FROM orders")
def split_by_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), splits.hashed_split(F.col("o_custkey")).alias("split"))


@query()
def split_by_shuffle(spark, sf_dir):
    """The seeded shuffle is Python's; no SQL has it."""
    return splits.split_groups(truth(spark, sf_dir).select("key", "scene"), "scene")


@query()
def split_sample_groups(spark, sf_dir):
    return splits.sample_groups(truth(spark, sf_dir).select("key", "scene"), "scene", 100)


_SHA = "CASE WHEN doc_id % 2 = 0 THEN sha256(text) END"


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def split_drop_leaks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return splits.drop_leaks(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")).select("doc_id")


@query(
    f"""WITH d AS (SELECT doc_id, source, sha256(text) AS sha, doc_id % 2 AS odd FROM documents), x AS (SELECT source, doc_id % 9 = 0 AS bad, sha IN (SELECT sha FROM d WHERE odd = 0) AS leak, {_SPLIT.format(g='source')} AS split FROM d WHERE odd = 1),
y AS (SELECT source, split, CASE WHEN bad THEN 'bbox' WHEN leak THEN 'hash' END AS excluded FROM x)
SELECT count(DISTINCT source) AS sequences, count(*) FILTER (excluded IS NULL) AS samples, count(*) FILTER (excluded = 'hash') AS excluded_hash, count(*) FILTER (excluded = 'bbox') AS excluded_invalid_bbox, count(*) FILTER (excluded IS NULL AND split = 'train') AS train, count(*) FILTER (excluded IS NULL AND split = 'val') AS val FROM y"""
)
def split_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    box = F.when(F.col("doc_id") % 9 != 0, F.array(F.lit(0.0)))
    x = splits.flag_exclusions(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), box).withColumn("split", splits.hashed_split(F.col("source")))
    return splits.split_stats(x, "source")


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 2 = 0 AND p_name IN (SELECT p_name FROM part WHERE p_partkey % 2 = 1) ORDER BY name LIMIT 5")
def split_overlaps(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    return splits.overlaps(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "name")


@query(f"SELECT scene, array_to_string(list(key ORDER BY key), ',') AS keys FROM ({TRUTH_SQL}) GROUP BY scene")
def shard_keys_by_scene(spark, sf_dir):
    return sharding.keys_by_scene(truth(spark, sf_dir)).select("scene", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


def _balanced(scenes: str, shards: int) -> str:
    """Least-load placement as recursion over the scenes in order, with the loads so far as a list."""
    return f"""WITH RECURSIVE s AS (SELECT scene, n, row_number() OVER (ORDER BY n DESC, scene) AS r FROM (SELECT scene, count(*) AS n FROM ({TRUTH_SQL}) {scenes} GROUP BY scene)),
g AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS scene, CAST(0 AS BIGINT) AS p, list_transform(range({shards}), lambda x: CAST(0 AS BIGINT)) AS load
      UNION ALL SELECT s.r, s.scene, list_position(g.load, list_min(g.load)), list_transform(g.load, lambda x, i: CASE WHEN i = list_position(g.load, list_min(g.load)) THEN x + s.n ELSE x END) FROM g JOIN s ON s.r = g.r + 1)
SELECT t.key, t.scene, CAST(g.p - 1 AS INTEGER) AS shard FROM ({TRUTH_SQL}) AS t JOIN g ON t.scene = g.scene"""


@query(_balanced("", 8))
def shard_scenes_balanced(spark, sf_dir):
    """Each scene goes where the load is least so far."""
    return sharding.shard_scenes(truth(spark, sf_dir).select("key", "scene"), 8)


@query(_balanced("WHERE scene IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) ", 5))
def shard_named_scenes(spark, sf_dir):
    """The scenes of one nation's customers alone."""
    t = truth(spark, sf_dir).select("key", "scene")
    asked = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("scene"))
    return sharding.shard_scenes(t, 5, only=asked.join(t, "scene", "left_semi"))


@query("WITH p AS (SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 6 <> 0) SELECT key, CAST((row_number() OVER (ORDER BY key) - 1) % 7 AS INTEGER) AS shard FROM p")
def shard_pending_in_turn(spark, sf_dir):
    t = truth(spark, sf_dir).select("key", F.col("key").alias("pos"))
    return sharding.shard_pending(t, t.where("key % 6 = 0"), 7).select("key", "shard")


@query(f"SELECT key, scene FROM ({TRUTH_SQL}) ORDER BY key LIMIT 100")
def first_items(spark, sf_dir):
    return sharding.first_items(truth(spark, sf_dir), 100, "key").select("key", "scene")


@query(f"SELECT key, row_number() OVER (ORDER BY md5('45:' || key) || ':' || key) AS place FROM ({TRUTH_SQL})")
def epoch_order(spark, sf_dir):
    return sharding.epoch_order(truth(spark, sf_dir), 42, 3).select("key", "place")


# ---- contracts ----------------------------------------------------------------------------------------------------

_PRE = "p AS (SELECT p_partkey AS pos, p_partkey % 23 = 0 AS short, CASE WHEN p_partkey % 19 = 0 THEN ' ' ELSE p_name END AS query, p_partkey % 17 = 0 AS bad FROM part), f AS (SELECT pos, CASE WHEN short THEN 'missing_field' WHEN trim(query) = '' THEN 'empty_query' WHEN bad THEN 'bad_bbox' END AS fault FROM p), g AS (SELECT *, row_number() OVER (PARTITION BY fault ORDER BY pos) AS r FROM f WHERE fault IS NOT NULL)"


@query(f"WITH {_PRE} SELECT fault, count(*) AS n, string_agg(CASE WHEN r <= 5 THEN CAST(pos AS VARCHAR) END, ',' ORDER BY pos) AS first_ids FROM g GROUP BY fault")
def contract_preflight(spark, sf_dir):
    k = F.col("p_partkey")
    fields = F.array(*map(F.lit, hashing.APPROVED_FIELDS))
    d = table(spark, sf_dir, "part").select(
        k.alias("pos"), k.cast("string").alias("id"), F.when(k % 19 == 0, " ").otherwise(F.col("p_name")).alias("query"),
        F.when(k % 17 == 0, F.array(F.lit(0.5), F.lit(0.5), F.lit(0.4), F.lit(0.9))).otherwise(F.array(F.lit(0.1), F.lit(0.1), F.lit(0.4), F.lit(0.9))).alias("bbox"), F.when(k % 23 == 0, F.slice(fields, 1, 6)).otherwise(fields).alias("fields"),
    )
    return contract.preflight(d, F.col("fields")).select("fault", "n", F.array_join("first_ids", ",").alias("first_ids"))


@query("WITH a AS (SELECT p_name || p_brand AS field, min(p_size) AS v FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), e AS (SELECT p_name || p_brand AS field, min(p_size) AS v FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1) SELECT coalesce(a.field, e.field) AS field, CASE WHEN a.field IS NULL THEN 'missing' WHEN e.field IS NULL THEN 'extra' ELSE 'mismatch' END AS fault FROM a FULL OUTER JOIN e ON a.field = e.field WHERE a.v IS DISTINCT FROM e.v")
def contract_compare_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("field", F.concat("p_name", "p_brand"))
    side = lambda c: p.where(c).groupBy("field").agg(F.min("p_size").cast("string").alias("value"))
    return contract.compare_fields(side("p_partkey % 3 <> 0"), side("p_partkey % 4 <> 0"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN l_orderkey % 2 = 0 THEN CAST(0.25 AS DOUBLE) END, CAST(p_size AS DOUBLE) / 100) AS x1 FROM lineitem JOIN part ON l_partkey = p_partkey")
def contract_lookup(spark, sf_dir):
    box = lambda e: F.array(e, F.lit(0.0), F.lit(1.0), F.lit(1.0))
    records = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("sample"), F.when(F.col("l_orderkey") % 2 == 0, box(F.lit(0.25))).alias("bbox"))
    index = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample"), box(F.col("p_size").cast("double") / 100).alias("bbox"))
    return contract.lookup(records, index, "sample").select("l_orderkey", "l_linenumber", F.col("sample").alias("l_partkey"), F.get("bbox", 0).alias("x1"))


@query("SELECT DISTINCT l_partkey AS sample FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)")
def contract_unmatched(spark, sf_dir):
    return contract.unmatched(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sample")), table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("sample")), "sample")


@query("SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS keys, count(*) <> count(DISTINCT l_orderkey) AS repeats FROM lineitem")
def contract_repeats(spark, sf_dir):
    return contract.has_repeats(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("WITH f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'path' WHEN o_orderkey % 7 = 0 THEN 'distinct' WHEN o_orderkey % 11 = 0 THEN 'size' END AS fault FROM orders) SELECT id, fault FROM f WHERE fault IS NOT NULL")
def contract_path_faults(spark, sf_dir):
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 5 == 0, "a/./b.png").otherwise("a/v.png").alias("visible"), F.when(k % 7 == 0, "a/v.png").otherwise("a/i.png").alias("infrared"), F.lit("a/d.png").alias("depth"), F.when(k % 11 == 0, 0).otherwise(640).alias("width"), F.lit(480).alias("height"))
    return contract.path_faults(d)


# ---- bookkeeping --------------------------------------------------------------------------------------------------

_EPOCHS = "e AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS epoch, CAST(o_orderkey % 5 AS DOUBLE) / 10 AS acc, CAST(o_orderkey * 7 % 11 AS DOUBLE) / 10 AS val_loss FROM orders)"


def _epochs(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(k)).alias("epoch"), ((k % 5).cast("double") / 10).alias("acc"), ((k * 7 % 11).cast("double") / 10).alias("val_loss"))


@query(f"WITH {_EPOCHS}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY acc DESC, val_loss, epoch) AS n FROM e) SELECT run, epoch, acc AS best FROM r WHERE n = 1")
def training_best_epoch(spark, sf_dir):
    return training.best_epoch(_epochs(spark, sf_dir))


@query(f"WITH {_EPOCHS}, o AS (SELECT *, max(acc) OVER (PARTITION BY run ORDER BY epoch) AS best_so_far, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n FROM e), p AS (SELECT o.*, (SELECT min_by(x.val_loss, x.val_loss) FROM e AS x WHERE x.run = o.run AND x.epoch < o.epoch AND x.acc = (SELECT max(y.acc) FROM e AS y WHERE y.run = o.run AND y.epoch < o.epoch)) AS bl, (SELECT max(y.acc) FROM e AS y WHERE y.run = o.run AND y.epoch < o.epoch) AS ba FROM o) SELECT run, epoch, best_so_far, ba IS NULL OR acc > ba OR (acc = ba AND val_loss < bl) AS improved FROM p")
def training_running_best(spark, sf_dir):
    return training.running_best(_epochs(spark, sf_dir)).select("run", "epoch", "best_so_far", "improved")


@query("SELECT l_suppkey AS epoch, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,9)) * CAST(l_linenumber AS BIGINT)) AS DOUBLE) / greatest(1, sum(l_linenumber)) AS mean_loss FROM lineitem GROUP BY l_suppkey")
def training_losses(spark, sf_dir):
    return training.losses(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("epoch"), F.col("l_extendedprice").alias("loss"), F.col("l_linenumber").cast("long").alias("n")))


_COUNT = "n AS (SELECT count(*) AS n FROM orders), r AS (SELECT unnest(range(0, n + n // 10)) AS i, n, n // 20 AS w FROM n)"


@query(f"WITH {_COUNT} SELECT i AS batch, least(16, n - (i // 16) * 16) AS \"window\", (i + 1) % 16 = 0 OR i + 1 = n AS steps FROM r WHERE i >= 5 AND i < n")
def training_accumulation(spark, sf_dir):
    """An epoch of as many batches as there are orders."""
    return training.accumulation_plan(spark, table(spark, sf_dir, "orders").count(), 16, skip=5)


def _rates(decay: str) -> str:
    return f"CASE WHEN i < w THEN i / CAST(w AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) + CAST(0.9 AS DOUBLE) * ({decay}) END"


_PROGRESS = "least(CAST(1 AS DOUBLE), (i - w) / CAST(n - w AS DOUBLE))"


@query(f"WITH {_COUNT} SELECT i AS step, CAST(CAST({_rates(f'CAST(0.5 AS DOUBLE) * (1 + cos(pi() * {_PROGRESS}))')} AS DECIMAL(12,9)) AS DOUBLE) AS cosine, CAST(CAST({_rates(f'1 - {_PROGRESS}')} AS DECIMAL(12,9)) AS DOUBLE) AS linear, CAST(CAST({_rates('1')} AS DECIMAL(12,9)) AS DOUBLE) AS constant FROM r")
def training_rates(spark, sf_dir):
    """A run of as many steps as there are orders, a twentieth of them to warm up, and a tenth beyond its end."""
    n = table(spark, sf_dir, "orders").count()
    i, total, warm = F.col("id"), F.lit(n), F.lit(n // 20)
    return spark.range(n + n // 10).select(i.alias("step"), *(schedule.rate_factor(i, total, warm, k).cast("decimal(12,9)").cast("double").alias(k) for k in ("cosine", "linear", "constant")))


@query("SELECT o_orderkey AS key, CAST(ceil(o_orderkey / CAST(16 AS DOUBLE)) AS BIGINT) AS per_epoch, CAST(ceil(ceil(o_orderkey / CAST(4 AS DOUBLE)) / 16) * 3 AS BIGINT) AS steps, CAST(floor(o_orderkey * CAST(0.03 AS DOUBLE)) AS BIGINT) AS warmup, CASE WHEN o_orderkey % 10 = 0 THEN '-' WHEN o_orderkey >= 3600 THEN (o_orderkey // 3600) || 'h' || lpad(CAST(o_orderkey % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN o_orderkey >= 60 THEN (o_orderkey // 60) || 'm' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || 's' ELSE o_orderkey || 's' END AS left_, o_orderkey * 2 AS budget FROM orders")
def training_steps(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("key"), schedule.steps_per_epoch(k, 16).alias("per_epoch"), schedule.expected_steps(k, 4, 16, 3).alias("steps"), schedule.warmup_steps(k, 0.03).alias("warmup"), schedule.time_left(F.when(k % 10 == 0, -1).otherwise(k)).alias("left_"), schedule.pixel_budget(k).alias("budget"))


_NAMES = "CASE WHEN o_orderkey % 4 = 0 THEN 'step_' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 4 = 1 THEN 'epoch_' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 4 = 2 THEN 'step_x' || CAST(o_orderkey AS VARCHAR) ELSE 'other' END"


@query(f"WITH c AS (SELECT {_NAMES} AS name FROM orders), s AS (SELECT name, coalesce(try_cast(substr(name, 6) AS BIGINT), -1) AS step FROM c WHERE name LIKE 'step@_%' ESCAPE '@'), r AS (SELECT name, row_number() OVER (ORDER BY step DESC, name DESC) AS n FROM s) SELECT name FROM r WHERE n > 10")
def training_prune(spark, sf_dir):
    return training.to_prune(table(spark, sf_dir, "orders").select(_spark(_NAMES).alias("name")), "step_", 10)


@query("SELECT o_totalprice AS global_step, CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE o_orderstatus <> 'X' AND o_orderkey % 3 <> 0 ORDER BY o_totalprice DESC, path DESC LIMIT 1")
def training_latest_checkpoint(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return training.latest_checkpoint(o.select(F.col("o_totalprice").alias("global_step"), F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") % 3 != 0).alias("complete")))


@query("SELECT CAST(sum(p_size * p_partkey * 3) AS BIGINT) AS bytes, sum(p_size * p_partkey * 3) <= 400000 AS fits FROM part")
def training_image_bytes(spark, sf_dir):
    return training.image_bytes(table(spark, sf_dir, "part").select(F.col("p_size").alias("width"), F.col("p_partkey").alias("height")), 1_000_000)


@query("WITH m AS (SELECT c_custkey AS key, c_custkey % 50 AS hits, 40 AS total, CAST(c_custkey % 50 AS DOUBLE) / 40 + CASE WHEN c_custkey % 7 = 0 THEN 0.01 ELSE 0 END AS acc, CASE WHEN c_custkey % 6 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS iou, c_custkey % 45 AS failures FROM customer) SELECT key, CASE WHEN hits > total THEN 'hits' WHEN failures > total THEN 'failures' WHEN acc > 1 THEN 'acc' WHEN isnan(iou) THEN 'mean_iou' WHEN abs(acc - hits / CAST(total AS DOUBLE)) > 0.000000001 THEN 'acc is not hits / total' END AS fault FROM m")
def training_metric_faults(spark, sf_dir):
    k = F.col("c_custkey")
    acc = (k % 50).cast("double") / 40 + F.when(k % 7 == 0, 0.01).otherwise(0.0)
    iou = F.when(k % 6 == 0, float("nan")).otherwise(0.5)
    return table(spark, sf_dir, "customer").select(k.alias("key"), training.metric_fault(k % 50, F.lit(40), acc, iou, k % 45).alias("fault"))


@query("WITH e AS (SELECT user_id AS run, event_id AS t, event_id * 2 + event_id * event_id % 7 AS done FROM events), r AS (SELECT *, (done - lag(done) OVER w) / CAST(t - lag(t) OVER w AS DOUBLE) AS rate FROM e WINDOW w AS (PARTITION BY run ORDER BY t)) SELECT run, t AS \"at\", rate, CASE WHEN rate > 0 THEN (1000000000 - done) / rate END AS left_ FROM r")
def inference_throughput(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), i.alias("at"), (i * 2 + i * i % 7).alias("done"), F.lit(10**9).alias("total"))
    return inference.throughput(e).select("run", "at", "rate", F.col("left").alias("left_"))


# ---- hashes -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def hash_contents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.file_hash(F.col("text").cast("binary")).alias("sha"))


@query("SELECT o_orderkey AS key, sha256('{\"a\":[' || o_totalprice || ',true,null],\"clerk\":\"x\\ty\\u00e9 ' || o_orderstatus || '\",\"n\":{\"k\":' || o_custkey || ',\"z\":' || -o_totalprice || '}}') AS sha FROM orders")
def hash_canonical_json(spark, sf_dir):
    raw = F.concat(F.lit('{ "n": {"z": -'), F.col("o_totalprice").cast("string"), F.lit(', "k" : '), F.col("o_custkey").cast("string"), F.lit('}, "clerk": "x\\ty\u00e9 '), F.col("o_orderstatus"), F.lit('",\n"a": ['), F.col("o_totalprice").cast("string"), F.lit(", true, null]}"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.sha2(hashing.canonical_json(raw), 256).alias("sha"))


@query(
    "SELECT p_partkey AS key, sha256('{' || CASE WHEN p_partkey % 3 = 0 THEN '\"bbox\": null, ' ELSE '' END || '\"visible\": \"é ' || p_name || '\"' || CASE WHEN p_partkey % 2 = 0 THEN ', \"width\": ' || p_size ELSE '' END || '}') AS present, "
    "sha256('{\"bbox\":null,\"depth\":null,\"height\":null,\"infrared\":null,\"visible\":\"\\u00e9 ' || p_name || '\",\"width\":' || CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'null' END || '}') AS every FROM part"
)
def hash_fields(spark, sf_dir):
    """A row's fields of a fixed list: those that it has, where a null is one, and all, where one that is missing is null."""
    k = F.col("p_partkey")
    raw = F.concat(F.lit('{"other": [1], '), F.when(k % 2 == 0, F.concat(F.lit('"width": '), F.col("p_size").cast("string"), F.lit(", "))).otherwise(""), F.when(k % 3 == 0, '"bbox":null, ').otherwise(""), F.lit('"visible": "\\u00e9 '), "p_name", F.lit('"}'))
    made = lambda style, missing: F.sha2(hashing.canonical_json(raw, style, hashing.SOURCE_FIELDS, missing), 256)
    return table(spark, sf_dir, "part").select(k.alias("key"), made("spaced", False).alias("present"), made("compact", True).alias("every"))


@query("WITH s AS (SELECT string_agg('\"' || c_custkey || '\":{\"k\":' || c_nationkey || '}', ',' ORDER BY CAST(c_custkey AS VARCHAR)) AS j FROM customer) SELECT sha256('{' || j || '}') AS sha FROM s")
def hash_dataset(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit('{"k": '), F.col("c_nationkey").cast("string"), F.lit("}")).alias("raw"))
    return spark.createDataFrame([(hashing.dataset_fingerprint(c),)], "sha string")


@query("WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS k, sha256(c_name) AS h FROM customer) SELECT CAST(CAST('0x' || substr(md5(k), 1, 8) AS BIGINT) % 1024 AS INTEGER) AS bucket, count(*) AS rows, sha256(string_agg(k || ':' || h, ',' ORDER BY k, h)) AS sha256 FROM c GROUP BY 1")
def hash_partitions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("f"))
    return hashing.partition_hashes(c, "id", F.col("f"))


@query("SELECT sha256('[' || string_agg('\"' || c_custkey || '\"', ',' ORDER BY CAST(c_custkey AS VARCHAR)) || ']') AS sha FROM customer")
def hash_keys(spark, sf_dir):
    keys = [str(r.c_custkey) for r in table(spark, sf_dir, "customer").select("c_custkey").toLocalIterator()]
    return spark.createDataFrame([(hashing.key_hash(keys),)], "sha string")


_SOURCE = "'{\"bbox\":[' || (s_suppkey % 50 / CAST(100 AS DOUBLE)) || ',0.5],\"depth\":\"d' || s_suppkey || '\",\"height\":480,\"infrared\":null,\"visible\":\"v' || s_suppkey || '\",\"width\":' || s_nationkey || '}'"


@query(f"SELECT sha256('{{' || string_agg('\"' || s_suppkey || '\":' || {_SOURCE}, ',' ORDER BY CAST(s_suppkey AS VARCHAR)) || '}}') AS sha FROM supplier")
def hash_source(spark, sf_dir):
    """The query and unknown fields do not count, a missing field counts as null."""
    k = F.col("s_suppkey").cast("string")
    box = ((F.col("s_suppkey") % 50) / F.lit(100.0)).cast("string")
    raw = F.concat(F.lit('{"width": '), F.col("s_nationkey").cast("string"), F.lit(', "query": "q'), k, F.lit('", "visible": "v'), k, F.lit('", "bbox": ['), box, F.lit('0, 0.50], "height": 480, "depth": "d'), k, F.lit('", "more": 1}'))
    return spark.createDataFrame([(hashing.source_fingerprint(table(spark, sf_dir, "supplier").select(k.alias("id"), raw.alias("raw"))),)], "sha string")


# ---- sessions' pictures and stores, ids, training windows ---------------------------------------------------------


@query("SELECT c_custkey AS key, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'val' END AS store FROM customer")
def session_stores(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("corpus"))
    return session.store_of(c, ["BUILDING", "MACHINERY"], "val").select("key", "store")


@query(
    "WITH e AS (SELECT DISTINCT p_brand || '/' || p_size || '.png' AS image FROM part), a AS (SELECT DISTINCT CASE WHEN l_suppkey % 9 = 0 THEN '../x.png' ELSE p_brand || '/' || l_quantity || '.png' END AS image FROM lineitem JOIN part ON l_partkey = p_partkey), "
    "f AS (SELECT DISTINCT 'r' || (p_size % 3) || '/' || p_brand || '/' || p_size || '.png' AS path FROM part UNION SELECT 'r1/../x.png') "
    "SELECT a.image, CASE WHEN a.image NOT LIKE '..%' AND a.image IN (SELECT image FROM e) THEN (SELECT min(path) FROM f WHERE path IN ('r0/' || a.image, 'r1/' || a.image)) END AS path FROM a"
)
def session_pictures(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    png = lambda size: F.concat("p_brand", F.lit("/"), size.cast("string"), F.lit(".png"))
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    asked = lines.select(F.when(F.col("l_suppkey") % 9 == 0, "../x.png").otherwise(png(F.col("l_quantity"))).alias("image"))
    files = part.select(F.concat(F.lit("r"), (F.col("p_size") % 3).cast("string"), F.lit("/"), png(F.col("p_size"))).alias("path")).distinct().unionAll(spark.createDataFrame([("r1/../x.png",)], "path string"))
    return session.pictures(part.select(png(F.col("p_size")).alias("image")), asked, files, ["r0", "r1"])


@query("SELECT o_orderkey AS id, o_totalprice AS total FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def contract_select_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id")).distinct()
    return contract.select_ids(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total")), ids)


_ROWS = "r AS (SELECT l_orderkey AS key, list(CAST(l_partkey AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids, list(CASE WHEN l_linenumber < 4 THEN -100 ELSE CAST(l_partkey AS BIGINT) END ORDER BY l_linenumber, l_partkey, l_suppkey) AS labels FROM lineitem GROUP BY 1)"
_JOIN = "array_to_string({0}, ',')"


def _token_rows(spark, sf_dir):
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(order.alias("o"))
    part = lambda o: o["l_partkey"].cast("long")
    return rows.select("key", F.transform("o", part).alias("ids"), F.transform("o", lambda o: F.when(o["l_linenumber"] < 4, F.lit(-100).cast("long")).otherwise(part(o))).alias("labels"))


@query(
    f"WITH {_ROWS}, f AS (SELECT key, ids, labels, coalesce(list_position(list_transform(labels, lambda v: v <> -100), TRUE), 0) AS first FROM r) "
    f"SELECT key, CAST(CASE WHEN first > 0 THEN least(len(labels), len(labels) - first + 2) ELSE 0 END AS INTEGER) AS keep, {_JOIN.format('CASE WHEN first > 0 THEN list_append(labels[greatest(first, 2):], -100) ELSE [] END')} AS ahead, "
    "CASE WHEN len(ids) > 2 AND ids[1] <> ids[2] THEN 2 END AS prompt FROM f"
)
def training_windows(spark, sf_dir):
    """A prompt that is the first two ids, or those turned round where they differ and no prefix."""
    x = _token_rows(spark, sf_dir).withColumn("w", schedule.supervised_window(F.col("labels")))
    prompt = F.when(F.get("ids", 0) == F.get("ids", 1), F.array(F.lit(-1).cast("long"))).otherwise(F.slice("ids", 1, 2))
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    return x.select("key", "w.keep", text(F.col("w.labels")).alias("ahead"), schedule.prompt_length(prompt, F.col("ids")).alias("prompt"))


@query(
    f"WITH {_ROWS}, b AS (SELECT key // 4 AS batch, max(len(ids)) AS longest FROM r GROUP BY 1), p AS (SELECT r.*, longest - len(ids) AS more FROM r JOIN b ON key // 4 = batch) "
    f"SELECT key, {_JOIN.format('ids || list_transform(range(0, more), lambda v: 7)')} AS input_ids, {_JOIN.format('labels || list_transform(range(0, more), lambda v: -100)')} AS labels, repeat('1', len(ids)) || repeat('0', more) AS mask FROM p"
)
def training_collated(spark, sf_dir):
    member = F.struct("key", F.col("ids").alias("input_ids"), "labels", F.transform("ids", lambda v: F.lit(1).cast("long")).alias("attention_mask"))
    batches = _token_rows(spark, sf_dir).groupBy(F.floor(F.col("key") / 4)).agg(F.array_sort(F.collect_list(member)).alias("rows"))
    x = batches.select(F.explode(F.arrays_zip(F.col("rows.key").alias("key"), schedule.collated(F.col("rows"), 7).alias("c"))).alias("r")).select("r.key", "r.c.*")
    text = lambda c, by=",": F.array_join(F.transform(c, lambda v: v.cast("string")), by)
    return x.select("key", text("input_ids").alias("input_ids"), text("labels").alias("labels"), text("attention_mask", "").alias("mask"))
