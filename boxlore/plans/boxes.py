"""Queries on boxes: geometry, notation, evaluation, fusion, submissions, resuming.

Boxes are derived from order keys by the same integer arithmetic in both engines; prediction sets shift them, and hold
null, missing, inverted and NaN boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import parsing as p
from ..operators import evaluate as ev
from ..operators import fusion, inference, resume, submission
from .registry import query, table

K = "o_orderkey"
X1, Y1 = f"CAST({K} * 37 % 600 AS DOUBLE) / 1000", f"CAST({K} * 53 % 500 AS DOUBLE) / 1000"
X2, Y2 = f"({X1} + CAST(50 + {K} * 13 % 300 AS DOUBLE) / 1000)", f"({Y1} + CAST(50 + {K} * 29 % 400 AS DOUBLE) / 1000)"
COORDINATES = ("x1", "y1", "x2", "y2")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col(K).alias("key"), F.col("o_custkey").alias("scene"), F.array(*map(F.expr, (X1, Y1, X2, Y2))).alias("bbox"))


def _predicted(m: int) -> list[str]:
    """The coordinates of set m as SQL for both engines."""
    shift = f"(CAST({K} * {m} % 7 AS DOUBLE) - 3) / 100"
    x1, x2 = f"({X1} + {shift})", f"({X2} + {shift})"
    nan = "CAST('NaN' AS DOUBLE)"
    return [f"CASE WHEN {K} % 31 = {m} THEN {nan} WHEN {K} % 29 = {m} THEN {x2} ELSE {x1} END", f"({Y1} + {shift})", f"CASE WHEN {K} % 29 = {m} THEN {x1} ELSE {x2} END", f"({Y2} + {shift})"]


def predictions(spark: SparkSession, sf_dir: str, m: int) -> DataFrame:
    """Set m has a box for each order of a price of at least 5000 m; the cheap ones are its gaps."""
    box = F.when(F.expr(f"{K} % 17 <> {m}"), F.array(*map(F.expr, _predicted(m))))
    return table(spark, sf_dir, "orders").where(F.col("o_totalprice") >= 5000 * m).select(F.col(K).alias("key"), box.alias("bbox"))


TRUTH_SQL = f"SELECT {K} AS key, o_custkey AS scene, {X1} AS x1, {Y1} AS y1, {X2} AS x2, {Y2} AS y2 FROM orders"


def prediction_sql(m: int) -> str:
    c = ", ".join(f"CASE WHEN {K} % 17 <> {m} THEN {e} END AS {n}" for e, n in zip(_predicted(m), COORDINATES))
    return f"SELECT {K} AS key, {c} FROM orders WHERE o_totalprice >= {5000 * m}"


def valid_sql(t: str = "") -> str:
    c = [f"{t}{n}" for n in COORDINATES]
    parts = [f"coalesce({x} IS NOT NULL AND NOT isnan({x}) AND {x} >= 0 AND {x} <= 1, FALSE)" for x in c]
    return "(" + " AND ".join([*parts, f"coalesce({c[0]} < {c[2]}, FALSE)", f"coalesce({c[1]} < {c[3]}, FALSE)"]) + ")"


def iou_sql(a: str, b: str) -> str:
    w = f"greatest(CAST(0 AS DOUBLE), least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
    h = f"greatest(CAST(0 AS DOUBLE), least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    area = lambda t: f"({t}x2 - {t}x1) * ({t}y2 - {t}y1)"
    return f"CASE WHEN {valid_sql(a)} AND {valid_sql(b)} THEN ({w} * {h}) / ({area(a)} + {area(b)} - {w} * {h}) ELSE CAST(0 AS DOUBLE) END"


def flat(df: DataFrame, column: str = "bbox") -> DataFrame:
    """A box column as four."""
    return df.select(*(c for c in df.columns if c != column), *(F.get(F.col(column), k).alias(n) for k, n in enumerate(COORDINATES)))


def r6(e: str) -> str:
    return f"CAST(CAST(CAST({e} AS DECIMAL(20,12)) AS DECIMAL(20,6)) AS DOUBLE)"


# ---- evaluation ---------------------------------------------------------------------------------------------------

_JOINED = f"t AS ({TRUTH_SQL}), p AS ({prediction_sql(1)}), j AS (SELECT t.key, {iou_sql('t.', 'p.')} AS iou, NOT {valid_sql('p.')} AS failed FROM t LEFT JOIN p ON t.key = p.key)"
_METRICS = "SELECT count(*) FILTER (iou >= 0.5) AS hits, count(*) AS total, count(*) FILTER (iou >= 0.5) / CAST(count(*) AS DOUBLE) AS acc_at_threshold, CAST(sum(CAST(iou AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS mean_iou, count(*) FILTER (failed) AS failures FROM j"


@query(f"WITH {_JOINED} {_METRICS}")
def evaluate_accuracy(spark, sf_dir):
    return ev.evaluate(truth(spark, sf_dir), predictions(spark, sf_dir, 1))


@query(f"WITH {_JOINED} SELECT key, iou, iou >= 0.5 AS hit, failed FROM j")
def evaluate_items(spark, sf_dir):
    return ev.scored(truth(spark, sf_dir), predictions(spark, sf_dir, 1)).select("key", "iou", g.is_hit(F.col("iou")).alias("hit"), "failed")


@query(f"WITH {_JOINED.replace('FROM t LEFT JOIN', 'FROM (SELECT * FROM t WHERE key % 5 <> 0) t LEFT JOIN')} {_METRICS}")
def evaluate_trainable(spark, sf_dir):
    data = truth(spark, sf_dir).withColumn("query", F.when(F.col("key") % 5 == 0, "").otherwise("the box"))
    return ev.evaluate_trainable(data, predictions(spark, sf_dir, 1))


@query(f"WITH p AS ({prediction_sql(2)}) SELECT count(*) AS predictions, count(*) FILTER ({valid_sql()}) AS valid FROM p")
def valid_predictions(spark, sf_dir):
    return ev.valid_predictions(predictions(spark, sf_dir, 2))


# ---- geometry -----------------------------------------------------------------------------------------------------


@query(f"WITH p AS ({prediction_sql(2)}) SELECT key, " + ", ".join(f"CASE WHEN {valid_sql()} THEN {c} END AS {c}" for c in COORDINATES) + " FROM p")
def box_validate(spark, sf_dir):
    return flat(predictions(spark, sf_dir, 2).withColumn("bbox", g.valid_box(F.col("bbox"))))


_PIX = {"x": "CAST(l_partkey % 2100 - 100 AS DOUBLE)", "y": "CAST(l_suppkey * 7 % 1200 - 60 AS DOUBLE)", "w": "CAST(l_orderkey % 700 - 20 AS DOUBLE)", "h": "CAST(l_orderkey * 3 % 500 AS DOUBLE)"}
_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_PIXELS = f"SELECT {_LINE}, {', '.join(f'{e} AS {n}' for n, e in _PIX.items())} FROM lineitem"


def _pixels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*_LINE.split(", "), *(f"{e} AS {n}" for n, e in _PIX.items()))


def _clip(e: str, size: int) -> str:
    return r6(f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), ({e}) / {size}))")


@query(
    f"WITH q AS ({_PIXELS}), b AS (SELECT {_LINE}, {_clip('x', 1920)} AS x1, {_clip('y', 1080)} AS y1, {_clip('x + w', 1920)} AS x2, {_clip('y + h', 1080)} AS y2 FROM q) SELECT {_LINE}, "
    + ", ".join(f"CASE WHEN {valid_sql()} THEN {c} END AS {c}" for c in COORDINATES)
    + " FROM b"
)
def box_from_pixels(spark, sf_dir):
    box = g.pixel_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1920), F.lit(1080))
    return flat(_pixels(spark, sf_dir).select(*_LINE.split(", "), box.alias("bbox")))


_INSIDE = "x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x + w <= 1920 AND y + h <= 1080"


@query(f"WITH q AS ({_PIXELS}) SELECT {_LINE}, " + ", ".join(f"CASE WHEN {_INSIDE} THEN {e} END AS {n}" for e, n in zip(("x / 1920", "y / 1080", "(x + w) / 1920", "(y + h) / 1080"), COORDINATES)) + " FROM q")
def box_from_pixels_strict(spark, sf_dir):
    box = g.strict_pixel_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1920), F.lit(1080))
    return flat(_pixels(spark, sf_dir).select(*_LINE.split(", "), box.alias("bbox")))


_EDGES = [f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {c}))" for c in COORDINATES]
_REASON = (
    "CASE WHEN x1 IS NULL THEN 'a box has four coordinates' WHEN isnan(x1) OR isnan(y1) OR isnan(x2) OR isnan(y2) THEN 'a coordinate is not finite' "
    f"WHEN {_EDGES[2]} - {_EDGES[0]} <= 0.000001 OR {_EDGES[3]} - {_EDGES[1]} <= 0.000001 THEN 'a box needs an extent' END"
)


@query(f"WITH p AS ({prediction_sql(3)}), r AS (SELECT *, {_REASON} AS reason FROM p) SELECT key, reason, " + ", ".join(f"CASE WHEN reason IS NULL THEN {r6(e)} END AS {c}" for e, c in zip(_EDGES, COORDINATES)) + " FROM r")
def box_clip_for_annotator(spark, sf_dir):
    return flat(predictions(spark, sf_dir, 3).select("key", g.annotator_box(F.col("bbox")).alias("a")).select("key", "a.reason", F.col("a.box").alias("bbox")))


_Q = [f"CAST(round_even({c} * 1000, 0) AS INTEGER)" for c in COORDINATES]


@query(
    f"WITH p AS ({prediction_sql(4)}) SELECT key, CASE WHEN {valid_sql()} THEN least(999, {_Q[0]}) END AS x1, CASE WHEN {valid_sql()} THEN least(999, {_Q[1]}) END AS y1, "
    f"CASE WHEN {valid_sql()} THEN greatest(least(999, {_Q[0]}) + 1, {_Q[2]}) END AS x2, CASE WHEN {valid_sql()} THEN greatest(least(999, {_Q[1]}) + 1, {_Q[3]}) END AS y2 FROM p"
)
def box_quantize(spark, sf_dir):
    return flat(predictions(spark, sf_dir, 4).withColumn("bbox", g.quantize(F.col("bbox"))))


@query(f"WITH t AS ({TRUTH_SQL}) SELECT key, {r6('1 - x2')} AS x1, y1, {r6('1 - x1')} AS x2, y2 FROM t")
def box_mirror(spark, sf_dir):
    return flat(truth(spark, sf_dir).select("key", g.mirror_box(F.col("bbox")).alias("bbox")))


_DRAG = [("least(x, w)", 1920, "x1"), ("least(y, h)", 1080, "y1"), ("greatest(x, w)", 1920, "x2"), ("greatest(y, h)", 1080, "y2")]


@query(f"WITH q AS ({_PIXELS}) SELECT {_LINE}, " + ", ".join(f"{r6(f'greatest(CAST(0 AS DOUBLE), least(CAST({s} AS DOUBLE), {e})) / {s}')} AS {n}" for e, s, n in _DRAG) + " FROM q")
def box_from_drag(spark, sf_dir):
    return flat(_pixels(spark, sf_dir).select(*_LINE.split(", "), g.dragged_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1920), F.lit(1080)).alias("bbox")))


@query(f"WITH t AS ({TRUTH_SQL}) SELECT key, x1 * 1920 AS x, y1 * 1080 AS y, (x2 - x1) * 1920 AS w, (y2 - y1) * 1080 AS h, (x1 * 1920 - 5) / 2 AS image_x, (y1 * 1080 - 7) / 2 AS image_y FROM t")
def box_to_pixels(spark, sf_dir):
    b = F.col("bbox")
    point = g.screen_to_image(g.at(b, 0) * 1920, g.at(b, 1) * 1080, F.lit(2), F.lit(5), F.lit(7))
    return truth(spark, sf_dir).select("key", g.to_pixels(b, F.lit(1920), F.lit(1080)).alias("p"), point.alias("s")).select("key", "p.*", F.col("s.x").alias("image_x"), F.col("s.y").alias("image_y"))


def _byte(k: int) -> str:
    return f"(CAST(CAST('0x' || substr(sha256(q), {2 * k + 1}, 2) AS INTEGER) AS DOUBLE) / 255.0)"


_SX = [f"(CAST(0.05 AS DOUBLE) + {_byte(0)} * CAST(0.40 AS DOUBLE))", f"(CAST(0.05 AS DOUBLE) + {_byte(1)} * CAST(0.40 AS DOUBLE))"]
_STAND = [_SX[0], _SX[1], f"least(CAST(1 AS DOUBLE), {_SX[0]} + CAST(0.15 AS DOUBLE) + {_byte(2)} * CAST(0.25 AS DOUBLE))", f"least(CAST(1 AS DOUBLE), {_SX[1]} + CAST(0.15 AS DOUBLE) + {_byte(3)} * CAST(0.25 AS DOUBLE))"]


@query("WITH q AS (SELECT p_partkey AS key, 'the ' || p_name AS q FROM part) SELECT key, " + ", ".join(f"round({e}, 6) AS {c}" for e, c in zip(_STAND, COORDINATES)) + " FROM q")
def inference_stand_in(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("the "), "p_name").alias("query"))
    return flat(inference.stand_in(items))


# ---- notation -----------------------------------------------------------------------------------------------------

_N = {n: f"CAST({e} AS VARCHAR)" for n, e in zip(COORDINATES, (f"{K} * 37 % 1100", f"{K} * 53 % 900", f"{K} * 37 % 1100 + 50 + {K} * 13 % 300", f"{K} * 53 % 900 + {K} * 29 % 90"))}
_PAIR = f"'(' || {_N['x1']} || ',' || {_N['y1']} || '), (' || {_N['x2']} || ' ,' || {_N['y2']} || ')'"
_LIST = f"{_N['x1']} || ', ' || {_N['y1']} || ',' || {_N['x2']} || ',' || {_N['y2']}"
_TAG = f"'<|box_start|>' || {_PAIR} || '<|box_end|>'"
_GTAG = f"'<|begin_of_box|>' || {_LIST} || ' <|end_of_box|>'"
#: Answers by kind (the order's key modulo their number), and whether each states its one box.
_ANSWERS = [(_TAG, True), (f"'Result: ' || {_TAG} || ' done'", True), (_PAIR, True), (f"'at ' || {_PAIR}", False), (f"'[' || {_LIST} || ']'", True), (_LIST, True), ("'{\"bbox_2d\": [' || " + _LIST + " || ']}'", True), (f"{_TAG} || {_TAG}", False), ("'nothing'", False), (f"' `' || {_PAIR} || '` '", True), ("''", False)]
_GANSWERS = [(_GTAG, True), (f"'It is ' || {_GTAG} || '.'", True), (_LIST, True), (f"'box ' || {_LIST} || ' there'", True), (f"{_GTAG} || {_GTAG}", False), (f"{_LIST} || ', 5'", False), (f"'1, ' || {_LIST}", False), ("'none'", False), (f"{_LIST} || ' or 1,2,3,4'", False)]


def _answer(kinds) -> str:
    return "CASE " + " ".join(f"WHEN {K} % {len(kinds)} = {n} THEN {e}" for n, (e, _) in enumerate(kinds)) + " END"


def _answer_sql(kinds) -> str:
    stated = f"{K} % {len(kinds)} IN ({', '.join(str(n) for n, (_, ok) in enumerate(kinds) if ok)})"
    ints = [f"CAST({v} AS DOUBLE)" for v in _N.values()]
    fits = " AND ".join(f"{e} <= 1000" for e in ints) + f" AND {ints[0]} < {ints[2]} AND {ints[1]} < {ints[3]}"
    return f"SELECT {K} AS key, " + ", ".join(f"CASE WHEN {stated} AND {fits} THEN {e} / 1000 END AS {c}" for e, c in zip(ints, COORDINATES)) + " FROM orders"


@query(_answer_sql(_ANSWERS))
def parse_boxes(spark, sf_dir):
    return flat(table(spark, sf_dir, "orders").select(F.col(K).alias("key"), p.parse_box(F.expr(_answer(_ANSWERS).replace("AS VARCHAR", "AS STRING"))).alias("bbox")))


@query(_answer_sql(_GANSWERS))
def parse_glm_boxes(spark, sf_dir):
    return flat(table(spark, sf_dir, "orders").select(F.col(K).alias("key"), p.parse_glm_box(F.expr(_answer(_GANSWERS).replace("AS VARCHAR", "AS STRING"))).alias("bbox")))


_WQ = [f"least(999, {_Q[0]})", f"least(999, {_Q[1]})", f"greatest(least(999, {_Q[0]}) + 1, {_Q[2]})", f"greatest(least(999, {_Q[1]}) + 1, {_Q[3]})"]


@query(f"WITH t AS ({TRUTH_SQL}) SELECT key, '<|box_start|>(' || {_WQ[0]} || ',' || {_WQ[1]} || '),(' || {_WQ[2]} || ',' || {_WQ[3]} || ')<|box_end|>' AS tagged, '(' || {_WQ[0]} || ',' || {_WQ[1]} || '),(' || {_WQ[2]} || ',' || {_WQ[3]} || ')' AS bare, '<|begin_of_box|>' || {_WQ[0]} || ',' || {_WQ[1]} || ',' || {_WQ[2]} || ',' || {_WQ[3]} || '<|end_of_box|>' AS glm FROM t")
def write_boxes(spark, sf_dir):
    b = F.col("bbox")
    return truth(spark, sf_dir).select("key", p.write_box(b).alias("tagged"), p.write_box(b, False).alias("bare"), p.write_glm_box(b).alias("glm"))


# ---- fusion and submission ----------------------------------------------------------------------------------------


def _fusion_sql(threshold: float, weights: tuple[float, float, float]) -> str:
    """The fold written out for three sets whose weights do not rise: a before b before c."""
    keys = " UNION ".join(f"SELECT key FROM p{m}" for m in (1, 2, 3))
    joins = " ".join(f"LEFT JOIN p{m} AS {n} ON k.key = {n}.key" for m, n in ((1, "a"), (2, "b"), (3, "c")))
    w = dict(zip("abc", weights))
    columns = ", ".join(f"{n}.{c} AS {n}{c}" for n in "abc" for c in COORDINATES)
    flags = f"k.key, {columns}, {', '.join(f'{valid_sql(n + '.')} AS v{n}' for n in 'abc')}, {iou_sql('a.', 'b.')} AS ab, {iou_sql('a.', 'c.')} AS ac, {iou_sql('b.', 'c.')} AS bc"
    member = {"a": "CASE win WHEN 'A' THEN va ELSE FALSE END", "b": "CASE win WHEN 'A' THEN inb WHEN 'B' THEN TRUE ELSE FALSE END", "c": "CASE win WHEN 'A' THEN cin = 'A' WHEN 'B' THEN cin = 'B' WHEN 'C' THEN TRUE ELSE FALSE END"}
    total = " + ".join(f"CASE WHEN m{n} THEN CAST({w[n]} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END" for n in "abc")
    mean = lambda c: r6("(" + " + ".join(f"CASE WHEN m{n} THEN CAST({w[n]} AS DOUBLE) * {n}{c} ELSE CAST(0 AS DOUBLE) END" for n in "abc") + f") / ({total})")
    return f"""
WITH p1 AS ({prediction_sql(1)}), p2 AS ({prediction_sql(2)}), p3 AS ({prediction_sql(3)}), k AS ({keys}),
f AS (SELECT {flags} FROM k {joins}),
g AS (SELECT *, va AND vb AND ab > {threshold} AS inb,
      CASE WHEN NOT vc THEN '' WHEN va AND vb AND ab > {threshold} THEN CASE WHEN greatest(ac, bc) > {threshold} THEN 'A' ELSE 'C' END
           WHEN va AND ac > {threshold} AND ac >= bc THEN 'A' WHEN vb AND bc > {threshold} THEN 'B' ELSE 'C' END AS cin FROM f),
h AS (SELECT *, CASE WHEN va THEN {w['a']} + CASE WHEN inb THEN {w['b']} ELSE 0 END + CASE WHEN cin = 'A' THEN {w['c']} ELSE 0 END ELSE 0 END AS wa,
      CASE WHEN vb AND NOT inb THEN {w['b']} + CASE WHEN cin = 'B' THEN {w['c']} ELSE 0 END ELSE 0 END AS wb, CASE WHEN cin = 'C' THEN {w['c']} ELSE 0 END AS wc FROM g),
i AS (SELECT *, CASE WHEN wa > 0 AND wa >= wb AND wa >= wc THEN 'A' WHEN wb > 0 AND wb >= wc THEN 'B' WHEN wc > 0 THEN 'C' ELSE '' END AS win FROM h),
j AS (SELECT *, {', '.join(f'{e} AS m{n}' for n, e in member.items())} FROM i)
SELECT key, {', '.join(f"CASE WHEN win <> '' THEN {mean(c)} END AS {c}" for c in COORDINATES)} FROM j"""


@query(_fusion_sql(0.55, (1.5, 1.0, 1.0)))
def fuse_predictions(spark, sf_dir):
    return flat(fusion.fuse([(predictions(spark, sf_dir, 1), 1.5), (predictions(spark, sf_dir, 2), 1.0), (predictions(spark, sf_dir, 3), 1.0)]))


@query(_fusion_sql(0.8, (1.0, 1.0, 1.0)))
def fuse_predictions_equal_weights(spark, sf_dir):
    return flat(fusion.fuse([(predictions(spark, sf_dir, m), 1.0) for m in (1, 2, 3)], threshold=0.8))


_TEMPLATE = f"SELECT key FROM ({TRUTH_SQL}) WHERE key % 11 <> 0"


@query(
    f"WITH t AS ({_TEMPLATE}), p AS ({prediction_sql(5)}) SELECT count(*) FILTER (p.key IS NULL) AS missing, count(*) FILTER (t.key IS NULL) AS extra, count(*) FILTER (t.key IS NOT NULL AND p.key IS NOT NULL AND NOT {valid_sql('p.')}) AS invalid FROM t FULL OUTER JOIN p ON t.key = p.key"
)
def submission_gaps(spark, sf_dir):
    return submission.gaps(truth(spark, sf_dir).where("key % 11 <> 0").select("key"), predictions(spark, sf_dir, 5))


@query(f"WITH t AS ({_TEMPLATE}), p AS ({prediction_sql(5)}) SELECT t.key, " + ", ".join(f"CASE WHEN {valid_sql('p.')} THEN p.{c} ELSE CAST({v} AS DOUBLE) END AS {c}" for c, v in zip(COORDINATES, submission.FALLBACK)) + " FROM t LEFT JOIN p ON t.key = p.key")
def submission_build(spark, sf_dir):
    return flat(submission.build_submission(truth(spark, sf_dir).where("key % 11 <> 0").select("key"), predictions(spark, sf_dir, 5), allow_fallback=True))


_IDS = "CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '_' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END"
_VIS = "CASE WHEN o_orderkey % 7 = 1 THEN 'visible/' ELSE 'Images/visible/' END || CAST(o_orderkey AS VARCHAR) || '.png'"
_INF = "'Images/infrared/' || CAST(o_orderkey + CASE WHEN o_orderkey % 19 = 2 THEN 1 ELSE 0 END AS VARCHAR) || '.png'"


@query(f"WITH t AS (SELECT {_IDS} AS key, {_VIS} AS visible, o_orderkey AS k, CASE WHEN o_orderkey % 17 = 3 THEN ' ' ELSE 'q' END AS query FROM orders), f AS (SELECT key, k, CASE WHEN key = 'x' THEN 'id' WHEN query = ' ' THEN 'query' WHEN visible NOT LIKE 'Images/%' THEN 'path' WHEN k % 19 = 2 THEN 'stems' END AS fault FROM t) SELECT key, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY ALL")
def template_faults(spark, sf_dir):
    s = lambda e: F.expr(e.replace("AS VARCHAR", "AS STRING"))
    t = table(spark, sf_dir, "orders").select(s(_IDS).alias("key"), s(_VIS).alias("visible"), s(_INF).alias("infrared"), F.expr("'Images/depth/' || CAST(o_orderkey AS STRING) || '.png'").alias("depth"), F.expr("CASE WHEN o_orderkey % 17 = 3 THEN ' ' ELSE 'q' END").alias("query"))
    return submission.template_faults(t).groupBy("key", "fault").agg(F.count("*").alias("n"))


# ---- resuming -----------------------------------------------------------------------------------------------------

_S = ", ".join(COORDINATES)


@query(
    f"WITH p AS ({prediction_sql(1)} AND o_orderkey % 3 = 0 UNION ALL {prediction_sql(1)} AND o_orderkey % 4 = 0 UNION ALL {prediction_sql(2)} AND o_orderkey % 30 = 0), d AS (SELECT DISTINCT key, x1 IS NULL AS nobox, {_S} FROM p) SELECT key, count(*) > 1 AS conflict FROM d GROUP BY key"
)
def resume_unite(spark, sf_dir):
    one, two = predictions(spark, sf_dir, 1), predictions(spark, sf_dir, 2)
    return resume.unite([one.where("key % 3 = 0"), one.where("key % 4 = 0"), two.where("key % 30 = 0")]).select("key", "conflict")


@query(
    f"WITH a AS ({_TEMPLATE}), p AS ({prediction_sql(6)}), x AS (SELECT coalesce(a.key, p.key) AS key, CASE WHEN a.key IS NULL THEN 'unexpected' WHEN p.key IS NULL THEN 'missing' WHEN p.y1 IS NOT NULL AND NOT {valid_sql('p.')} THEN 'invalid' END AS fault FROM a FULL OUTER JOIN p ON a.key = p.key) SELECT key, fault FROM x WHERE fault IS NOT NULL"
)
def resume_payload_faults(spark, sf_dir):
    return resume.payload_faults(predictions(spark, sf_dir, 6), truth(spark, sf_dir).where("key % 11 <> 0"), complete=True)


@query(f"WITH t AS ({TRUTH_SQL}), p AS ({prediction_sql(7)}) SELECT key, scene FROM t WHERE key NOT IN (SELECT key FROM p)")
def resume_pending(spark, sf_dir):
    return resume.pending(truth(spark, sf_dir), predictions(spark, sf_dir, 7)).select("key", "scene")


@query(f"WITH t AS ({TRUTH_SQL}), p AS ({prediction_sql(7)}), s AS (SELECT key % 8 AS shard, key FROM t) SELECT shard, count(*) AS assigned, count(p.key) AS done FROM s LEFT JOIN p ON s.key = p.key GROUP BY shard HAVING count(p.key) < count(*)")
def resume_shard_gaps(spark, sf_dir):
    return resume.shard_gaps(truth(spark, sf_dir).select("key", (F.col("key") % 8).alias("shard")), predictions(spark, sf_dir, 7))


@query(f"WITH q AS (SELECT p_partkey AS key, 'the ' || p_name AS q FROM part WHERE p_partkey % 3 <> 0) SELECT count(*) + (SELECT count(*) FROM part WHERE p_partkey % 3 = 0) AS predictions, count(*) + (SELECT count(*) FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0) AS valid FROM q")
def resume_run_summary(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("the "), "p_name").alias("query"), F.lit("").alias("visible"))
    saved = items.where("key % 3 = 0").select("key", F.when(F.col("key") % 2 == 0, g.box(0.1, 0.1, 0.2, 0.2)).alias("bbox"))
    return inference.summary(inference.continue_run(items, saved, "stand-in"))
