"""Queries that write files of the engine's formats from the tables and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as t
from ..operators import contract, inference, journal, package, training
from ..sinks import commit, writers
from ..sources import readers
from ..sources.scratch import scratch
from .boxes import TRUTH_SQL, flat, truth
from .records import _REPLAY, _state
from .registry import query, table


def _object(spark, rows, name: str) -> str:
    """One JSON object of the rows' (pos, key, raw) in order of pos, which all tasks write."""
    path = scratch(spark, name)
    writers.write_object(rows, path, "pos")
    return path


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("*", F.format_string("%06d_%03d", F.col("o_custkey").cast("int"), (F.col("o_orderkey") % 1000).cast("int")).alias("item"))


@query(
    "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, CAST(o_orderkey AS VARCHAR) AS key, 'Test/Images/visible/' || o_custkey || '.png' AS visible, 'Test/Images/depth/' || o_custkey || '.png' AS depth, 'the é ' || o_orderstatus AS query FROM orders"
)
def source_items(spark, sf_dir):
    """An official template: its first path makes all paths the test set's."""
    c = F.col("o_custkey").cast("string")
    path = lambda m: F.concat(F.lit(f'"{m}": "Images/{m}/'), c, F.lit('.png", '))
    raw = F.concat(F.lit("{"), path("visible"), path("infrared"), path("depth"), F.lit('"query": "the \\u00e9 '), "o_orderstatus", F.lit('"}'))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("key"), raw.alias("raw"))
    return readers.inference_items(spark, _object(spark, rows, "items")).select("pos", "key", "visible", "depth", "query")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS x1 FROM orders")
def source_predictions(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 7 == 0, "null").otherwise(F.concat(F.lit("["), F.col("o_totalprice").cast("string"), F.lit(", 0.5, 1, 1e0]")))
    rows = table(spark, sf_dir, "orders").select(k.alias("pos"), k.cast("string").alias("key"), raw.alias("raw"))
    return readers.predictions(spark, _object(spark, rows, "predictions")).select("key", F.get("bbox", 0).alias("x1"))


@query(
    "WITH l AS (SELECT l_suppkey % 40 AS s, l_partkey AS f, row_number() OVER (PARTITION BY l_suppkey % 40, l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC) AS n, l_orderkey, l_quantity FROM lineitem) "
    "SELECT 'sequence=' || s AS sequence, f || '.png' AS filename, CAST(-l_orderkey AS INTEGER) AS x, CAST(floor(l_quantity) AS INTEGER) AS w FROM l WHERE n = 1"
)
def source_groundtruth(spark, sf_dir):
    """A folder for each sequence: lines of a file name and four numbers among comments and blank lines; the last of a name wins. A
    sequence grows with the table, so its lines are in as many files as there are ranges of them, in the order of their names."""
    path, k = scratch(spark, "groundtruth"), F.col("l_orderkey").cast("string")
    number = F.concat(F.lit(" -"), k, F.lit(".75 , 2, "), F.col("l_quantity").cast("string"), F.lit(" ,4"))
    line = F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(".png,"), number, F.lit("\n# a comment, 1, 2, 3, 4\n\nfive, 1, 2\n"))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("sequence"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", line.alias("value"))
    order = ("sequence", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    lines = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("sequence", "value")
    lines.write.partitionBy("sequence").text(path)
    return readers.groundtruth(spark, f"{path}/*/*.txt").select("sequence", "filename", "x", "w")


@query("SELECT sha256(text) AS sha, CAST(doc_id AS VARCHAR) AS stem FROM documents WHERE text IS NOT NULL")
def source_hash_table(spark, sf_dir):
    """Hash to stems."""
    d = table(spark, sf_dir, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("key")).agg(F.array_join(F.transform(F.collect_list("doc_id"), lambda i: F.concat(F.lit('"'), i.cast("string"), F.lit('"'))), ", ").alias("stems"))
    return readers.hash_table(spark, _object(spark, d.select(F.col("key").alias("pos"), "key", F.concat(F.lit("["), "stems", F.lit("]")).alias("raw")), "hashes"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, CAST(p_partkey AS VARCHAR) AS sample_id, p_size AS object_index, p_name AS query, p_partkey % 2 = 0 AS collision FROM part")
def source_generation(spark, sf_dir):
    k = F.col("p_partkey")
    record = F.to_json(F.struct(k.cast("string").alias("sample_id"), F.col("p_size").alias("object_index"), F.col("p_name").alias("query"), (k % 2 == 0).alias("collision")))
    rows, path = table(spark, sf_dir, "part").select(k.alias("k"), record.alias("record")), scratch(spark, "generation")
    ends = rows.agg(F.min("k").alias("first"), F.max("k").alias("last")).first()
    opens = F.when(F.col("k") == ends["first"], '{"metadata": {}, "records": [').otherwise(",")
    rows.orderBy("k").select(F.concat(opens, "record", F.when(F.col("k") == ends["last"], "]}").otherwise("")).alias("value")).write.text(path)
    return readers.generation(spark, path).select("pos", "sample_id", "object_index", "query", "collision")


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN CAST(p_size * 1000 AS BIGINT) END AS width, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN CAST(p_partkey AS BIGINT) END AS height FROM part")
def source_png_sizes(spark, sf_dir):
    """Headers of pictures; some have another signature or chunk."""
    k = F.col("p_partkey")
    number = lambda v: F.lpad(F.hex(v.cast("long")), 8, "0")
    head = F.concat(F.when(k % 5 == 0, "FFD8FFE000104A46").otherwise("89504E470D0A1A0A"), F.lit("0000000D"), F.when(k % 7 == 0, "49454E44").otherwise("49484452"), number(F.col("p_size") * 1000), number(k), F.lit("0802000000"))
    return table(spark, sf_dir, "part").select(k.alias("key"), readers.png_size(F.unhex(head)).alias("s")).select("key", "s.width", "s.height")


@query("SELECT p_partkey AS key FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 2) AND p_size IN (SELECT CAST(l_quantity AS INTEGER) FROM lineitem)")
def source_complete_samples(spark, sf_dir):
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    name = lambda kind, c: F.concat(F.lit(kind), c.cast("long").cast("string"))
    frames = part.select(F.col("p_partkey").alias("key"), name("v", F.col("p_partkey")).alias("visible"), name("i", F.col("p_partkey")).alias("infrared"), name("d", F.col("p_size")).alias("depth"))
    files = line.select(name("v", F.col("l_partkey")).alias("path")).unionAll(line.where("l_linenumber = 2").select(name("i", F.col("l_partkey")))).unionAll(line.select(name("d", F.col("l_quantity"))))
    return readers.complete_samples(frames, files).select("key")


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE c_custkey % 5 + CAST(0.5 AS DOUBLE) END AS x1, CASE WHEN c_custkey % 3 = 0 THEN 'again ' || c_name WHEN c_custkey % 2 = 0 THEN c_name END AS query, c_custkey % 4 = 3 AS absent, "
    "CASE WHEN c_custkey % 4 = 3 THEN 'b:absent' ELSE CASE WHEN c_custkey % 5 > 0 THEN 'b' ELSE 'a' END END AS annotator FROM customer"
)
def journal_appended(spark, sf_dir):
    """Five appends to a journal, of which later ones take back earlier ones by their order alone."""
    c, path = table(spark, sf_dir, "customer"), scratch(spark, "journal")
    k = F.col("c_custkey")
    box = lambda x: F.array(x.cast("double"), *map(F.lit, (0.0, 9.0, 9.0)))
    none, no_box = F.lit(None).cast("string"), F.lit(None).cast("array<double>")

    def append(rows, has, bbox, text, who):
        edits = rows.select(k.cast("string").alias("id"), F.lit(has).alias("has_bbox"), bbox.alias("bbox"), text.alias("query"), F.lit(who).alias("annotator"), F.lit("t").alias("ts"))
        writers.append_journal(journal.as_lines(edits), path)

    append(c, True, box(F.lit(0.5)), none, "a")
    append(c.where("c_custkey % 2 = 0"), False, no_box, F.col("c_name"), "a")
    append(c.where("c_custkey % 5 > 0"), True, box(k % 5 + 0.5), none, "b")
    append(c.where("c_custkey % 3 = 0"), False, no_box, F.concat(F.lit("again "), "c_name"), "a")
    append(c.where("c_custkey % 4 = 3"), True, no_box, none, "b:absent")
    records = journal.parse_records(readers.json_lines(spark, path))
    return journal.replay(records).select("id", F.get("bbox", 0).alias("x1"), "query", "absent", "annotator")


@query(f"WITH {_REPLAY} SELECT id, 'box' AS kind, CAST(x1 AS VARCHAR) AS value FROM r WHERE x1 IS NOT NULL UNION ALL SELECT id, 'query', query FROM r WHERE query IS NOT NULL UNION ALL SELECT id, 'absent', annotator FROM r WHERE absent")
def journal_snapshot(spark, sf_dir):
    path = scratch(spark, "snapshot")
    writers.write_snapshot(_state(spark, sf_dir), path)
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    boxes = read("predictions", "id string, bbox array<double>").select("id", F.lit("box").alias("kind"), F.get("bbox", 0).cast("string").alias("value"))
    queries = read("queries", "id string, query string").select("id", F.lit("query"), "query")
    return boxes.unionAll(queries).unionAll(read("absent", "id string, annotator string").select("id", F.lit("absent"), "annotator"))


def _work(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit("the "), "p_name").alias("query"), F.lit("").alias("visible"))


class Measure:
    """An adapter whose boxes follow from how long a query is; every seventh answer is no box."""

    def load(self) -> None:
        pass

    def predict(self, rows: list[dict]) -> list[list[float] | None]:
        sizes = [len(r["query"]) for r in rows]
        return [None if n % 7 == 0 else [0.0, 0.125, (n % 5 + 1) / 8, (n % 4 + 2) / 8] for n in sizes]


_MEASURED = """SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN n % 7 <> 0 THEN CAST(0.0 AS DOUBLE) END AS x1, CASE WHEN n % 7 <> 0 THEN CAST(0.125 AS DOUBLE) END AS y1,
CASE WHEN n % 7 <> 0 THEN (n % 5 + 1) / CAST(8 AS DOUBLE) END AS x2, CASE WHEN n % 7 <> 0 THEN (n % 4 + 2) / CAST(8 AS DOUBLE) END AS y2 FROM (SELECT p_partkey, length('the ' || p_name) AS n FROM part)"""


@query(_MEASURED)
def inference_in_steps(spark, sf_dir):
    """An adapter's answers, of a run that was stopped after a part of its work and went on, in three steps, from what it has saved."""
    work, path = _work(spark, sf_dir), scratch(spark, "run")
    n = work.count()
    with inference.registered("measure", Measure) as name:
        inference.run_in_steps(work.where(F.col("pos") % 3 == 0), name, path, n)
        inference.run_in_steps(work, name, path, -(-n // 3))
    return flat(readers.saved_progress(spark, path)[0])


@query(_MEASURED)
def inference_in_shards(spark, sf_dir):
    """The same by four shards at a time, in two rounds."""
    work, path = _work(spark, sf_dir), scratch(spark, "shards")
    with inference.registered("measure", Measure) as name:
        return flat(inference.run_in_shards(work, name, path, 4, max(1, -(-work.count() // 8))))


class Unloadable(Measure):
    """An adapter that must not be asked."""

    def load(self) -> None:
        raise RuntimeError("a finished run loads no model")


@query(_MEASURED)
def inference_finished(spark, sf_dir):
    """A run that holds all items is returned as it is: another start of it loads nothing, in steps and in shards."""
    work, path = _work(spark, sf_dir), scratch(spark, "finished")
    with inference.registered("measure", Measure) as name:
        inference.run_in_shards(work, name, path, 3, work.count())
    with inference.registered("unloadable", Unloadable) as name:
        return flat(inference.run_in_shards(work, name, path, 2, 1))


def _picture(path: str) -> int:
    """What stands for a decoded picture: the number in its path."""
    return int(path[4:-4])


class Look(Measure):
    """An adapter whose boxes follow from the decoded picture and the query."""

    def predict(self, rows: list[dict]) -> list[list[float] | None]:
        return [[0.0, 0.0, (r["image"] % 8 + 1) / 8, (len(r["query"]) % 4 + 1) / 4] for r in rows]


@query(
    "SELECT CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS key, CAST(0 AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS y1, (CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_partkey END % 8 + 1) / CAST(8 AS DOUBLE) AS x2, "
    "(length(CAST(l_suppkey AS VARCHAR)) % 4 + 1) / CAST(4 AS DOUBLE) AS y2 FROM lineitem"
)
def inference_of_pictures(spark, sf_dir):
    """Rows are dealt by picture, which is decoded where they are; one picture has a third of them and is dealt to several tasks."""
    key = F.concat_ws("/", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    at = F.concat(F.lit("Raw/"), F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_partkey")).cast("string"), F.lit(".png"))
    items = table(spark, sf_dir, "lineitem").select(key.alias("key"), at.alias("visible"), F.col("l_suppkey").cast("string").alias("query"))
    with inference.registered("look", Look) as name:
        return flat(inference.predict(items, name, batch=16, decode=_picture))


#: Parts are samples here: 40 scenes, of which the first 30 are for training; some samples have two objects.
_SIDE = "CASE WHEN p_partkey % 40 < 30 THEN 'train' ELSE 'val' END"
_FRAME = "lpad(CAST(p_partkey % 40 AS VARCHAR), 3, '0') || '_' || p_partkey"
_WORDING = "'The ' || p_name || ' by the fence'"


def _side(spark, sf_dir, split: str, query=None):
    """The artifact of a split."""
    p = table(spark, sf_dir, "part").where(_SIDE + f" = '{split}'")
    sample = F.expr(_FRAME.replace("VARCHAR", "STRING")).alias("id")
    path = lambda kind: F.concat(F.lit("Raw/"), F.lpad((F.col("p_partkey") % 40).cast("string"), 3, "0"), F.lit(f"/{kind}/"), F.col("p_partkey").cast("string"), F.lit(".png"))
    box = F.array(F.lit(0.0), F.lit(0.0), (F.col("p_size") % 8 + 1) / 8, F.lit(1.0))
    index = p.select(sample, path("color").alias("visible"), path("infrared").alias("infrared"), path("depth").alias("depth"), box.alias("bbox"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    objects = p.withColumn("object_index", F.explode(F.when(F.col("p_size") > 25, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    own = F.when(F.col("object_index") == 1, F.array(F.lit(0.5), F.lit(0.5), F.lit(0.75), F.lit(0.75)))
    worded = F.expr(_WORDING) if query is None else query
    records = objects.select((F.col("p_partkey") * 2 + F.col("object_index")).alias("pos"), sample.alias("sample_id"), "object_index", own.alias("bbox"), F.concat(worded, F.when(F.col("object_index") == 1, " behind it.").otherwise(".")).alias("query"), F.lit(False).alias("collision"))
    return package.approve(records, index, split, "r", "p", "item_id")


_PACKAGED = f"""k AS (SELECT p_partkey, p_size, {_SIDE} AS split, {_FRAME} AS sample, {_WORDING} AS query, unnest(CASE WHEN p_size > 25 THEN [0, 1] ELSE [0] END) AS o FROM part),
n AS (SELECT split, count(*) AS samples, count(DISTINCT p_partkey % 40) AS scenes FROM k GROUP BY split)"""


@query(
    f"WITH {_PACKAGED} SELECT k.split, sample || '#0' || o AS id, query || CASE WHEN o = 1 THEN ' behind it' ELSE '' END AS query, CASE WHEN o = 1 THEN CAST(0.75 AS DOUBLE) ELSE (p_size % 8 + 1) / CAST(8 AS DOUBLE) END AS x2, samples, scenes FROM k JOIN n ON k.split = n.split"
)
def package_published(spark, sf_dir):
    """Both splits' artifacts from generated records and an index, published together and read again, with their metadata's counts. A
    query is stored clean, without the point at its end."""
    path, sides = scratch(spark, "published"), ("train", "val")
    package.publish([_side(spark, sf_dir, s) for s in sides], path)
    read = [readers.approved(spark, f"{commit.published(spark, path)}/{s}/approved") for s in sides]
    rows = [d.select(F.lit(m["split"]).alias("split"), "id", "query", F.get("bbox", 2).alias("x2"), F.lit(m["sample_count"]).cast("long").alias("samples"), F.lit(m["sequence_count"]).cast("long").alias("scenes")) for m, d in read]
    return rows[0].unionAll(rows[1])


@query(f"SELECT key, x1, y1, x2, y2 FROM ({TRUTH_SQL})")
def training_valid_boxes(spark, sf_dir):
    return flat(training.require_valid_boxes(truth(spark, sf_dir).select("key", "bbox")))


@query(
    "WITH f AS (SELECT doc_id, doc_id % 4 AS k, sha256(coalesce(text, '')) AS sha FROM documents) "
    "SELECT doc_id, CASE k WHEN 0 THEN 'manifest_' || sha WHEN 1 THEN 'manifest_' || upper(sha) || 'A' WHEN 2 THEN sha ELSE NULL END AS fingerprint, k = 0 AS trusted FROM f"
)
def text_fingerprints(spark, sf_dir):
    sha, k = F.sha2(F.coalesce("text", F.lit("")), 256), F.col("doc_id") % 4
    print_ = F.when(k == 0, F.concat(F.lit("manifest_"), sha)).when(k == 1, F.concat(F.lit("manifest_"), F.upper(sha), F.lit("A"))).when(k == 2, sha)
    return table(spark, sf_dir, "documents").select("doc_id", print_.alias("fingerprint"), t.is_trusted_fingerprint(print_).alias("trusted"))


@query(
    """WITH n AS (SELECT n_nationkey AS k, n_name AS n FROM nation)
SELECT k, 'infer_' || substr(sha256('{"name":"' || n || '","seed":' || k || '}'), 1, 16) AS infer, 'train_' || substr(sha256('{"name":"' || n || '","seed":' || k || '}'), 1, 16) || '_retry' AS train,
       'lora_' || substr(sha256(unhex(printf('%08x', length(n) + 4)) || encode(n || '.bin') || unhex(printf('%016x', length(n) * 2)) || encode(n || n)), 1, 16) AS adapter,
       'fusion_wbf_' || substr(sha256('{"algorithm": "wbf", "inputs": [{"path": "' || n || '", "sha256": "s"}], "iou_threshold": 0.55, "weights": [' || k || '.0]}'), 1, 16) AS fusion,
       sha256('{"protocol_version":13,"system_prompt":"' || n || '","user_template":"u"}') AS prompt FROM n"""
)
def hash_identities(spark, sf_dir):
    """Ids of runs, adapters, fusions and prompts, for each nation, whose table has 25 rows at any scale."""
    rows = []
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        k, n = int(r.n_nationkey), r.n_name
        identity = {"seed": k, "name": n, "lora_path": "/elsewhere"}
        rows.append((k, hashing.run_id(identity), hashing.run_id(identity, "train", True), hashing.folder_hash([(f"{n}.bin", (n + n).encode())]), hashing.fusion_id([(n, "s")], [k], 0.55, "wbf"), hashing.prompt_hash({"protocol_version": 13}, n, "u")))
    return spark.createDataFrame(rows, "k int, infer string, train string, adapter string, fusion string, prompt string")
