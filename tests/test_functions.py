import math
import random

import pytest
from pyspark.sql import functions as F

from boxlore.functions import geometry as g
from boxlore.functions import hashing, parsing, schedule
from boxlore.functions import text as t


def boxes(spark, rows):
    return spark.createDataFrame([(k, r and [None if v is None else float(v) for v in r]) for k, r in enumerate(rows)], "k int, b array<double>")


def values(df, column):
    return [r[0] for r in df.orderBy("k").select(column).collect()]


def test_valid_boxes(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.1, 0.2, 0.3], [0.5, 0.2, 0.1, 0.4], [0.1, 0.2, nan, 0.4], [-0.1, 0.2, 0.3, 0.4], [0.1, 0.2, inf, 0.4], [0.1, 0.2, 0.1, 0.4], [0.1, None, 0.3, 0.4], [0.1, 0.2, 0.3, 0.4, 0.5]]
    assert values(boxes(spark, bad), g.valid_box(F.col("b"))) == [None] * len(bad)
    assert values(boxes(spark, [[0.0, 0.0, 1.0, 1.0]]), g.valid_box(F.col("b"))) == [[0.0, 0.0, 1.0, 1.0]]
    assert values(boxes(spark, [[5.0, 2.0, 9.0, 4.0]]), g.valid_box(F.col("b"), normalized=False)) == [[5.0, 2.0, 9.0, 4.0]]


def test_pixel_boxes(spark):
    one = spark.range(1)
    lit = lambda *v: [F.lit(float(x)) for x in v]
    get = lambda c: one.select(c).first()[0]
    for exact in (False, True):
        assert get(g.pixel_box(*lit(570, 578, 305, 73, 1920, 1080), exact=exact)) == [0.296875, 0.535185, 0.455729, 0.602778]
    assert get(g.strict_pixel_box(*lit(10, 20, 30, 40, 100, 200))) == [0.1, 0.1, 0.4, 0.3]
    for v in ((-1, 0, 5, 5), (0, 0, 0, 5), (0, 0, 5, -1), (90, 0, 20, 5), (0, 190, 5, 20)):
        assert get(g.strict_pixel_box(*lit(*v, 100, 200))) is None
    assert get(g.pixel_box(*lit(-50, 0, 100, 50, 100, 100))) == [0.0, 0.0, 0.5, 0.5] and get(g.pixel_box(*lit(0, 0, 1, 1, 0, 5))) is None
    assert get(g.annotator_box(F.array(*lit(-1, 0.1, 0.5, 3))))["box"] == [0.0, 0.1, 0.5, 1.0]
    assert get(g.annotator_box(F.array(*lit(0.5, 0.1, 0.5, 0.9))))["reason"] == "a box needs an extent"


def test_exact_rounding_is_pythons(spark):
    rng = random.Random(3)
    x = [rng.randrange(1921) / 1920 for _ in range(300)] + [n / 640 for n in range(300)] + [0.1234565, 2.675]
    df = spark.createDataFrame(list(enumerate(x)), "k int, x double")
    assert values(df, g.round6_exact(F.col("x"))) == [round(v, 6) for v in x]


def test_quantize_and_write(spark):
    b = boxes(spark, [[0, 0, 0.0004, 0.0007], [0.9997, 0.058, 1, 0.642], [0.137, 0.058, 0.642, 0.913], [0.7, 0.5, 0.2, 0.9]])
    b = b.withColumn("b", F.col("b").cast("array<double>"))
    assert values(b, g.quantize(F.col("b"))) == [[0, 0, 1, 1], [999, 58, 1000, 642], [137, 58, 642, 913], None]
    assert values(b, parsing.write_box(F.col("b")))[2] == "<|box_start|>(137,58),(642,913)<|box_end|>"
    assert values(b, parsing.write_glm_box(F.col("b")))[2] == "<|begin_of_box|>137,58,642,913<|end_of_box|>"


def test_iou(spark):
    rows = [([0, 0, 1, 1], [0, 0, 1, 1], 1.0), ([0, 0, 0.5, 0.5], [0.25, 0.25, 0.75, 0.75], 1 / 7), ([0, 0, 0.5, 0.5], [0.5, 0.5, 1, 1], 0.0), ([0, 0, 0.5, 0.5], None, 0.0)]
    df = spark.createDataFrame([(k, [float(v) for v in a], b and [float(v) for v in b]) for k, (a, b, _) in enumerate(rows)], "k int, a array<double>, b array<double>")
    assert values(df, g.iou(F.col("a"), F.col("b"))) == pytest.approx([r[2] for r in rows])


OWN = [0.137, 0.058, 0.642, 0.913]
PARSED = [
    ("<|box_start|>(137,58),(642,913)<|box_end|>", OWN),
    ("it stands at <|box_start|>(137,58),(642,913)<|box_end|>", OWN),
    ("(0,7),(3,9)", [0.0, 0.007, 0.003, 0.009]),
    ("Answer 2 found: (31,47),(650,812)", None),
    ("(137,-58),(642,913)", None),
    ('{"bbox_2d": [137, 58, 642, 913]}', OWN),
    ('{"bbox_2d": [137, 58, 642]}', None),
    ('{"bbox_2d": [137, 58, 642, 913], "score": 0.5}', None),
    ("<|box_start|>(7,8),(19,20)<|box_end|> <|box_start|>(7,8),(19,20)<|box_end|>", None),
    ("```[137., 5.8e1, 642, 9.13e2]```", OWN),
    (" 137,58,642,913\n", OWN),
    ("137,58,642,1004", None),
    ("", None),
    (None, None),
]
GLM = [
    ("look: <|begin_of_box|>137,58,642,913<|end_of_box|> there", OWN),
    ("137,58,642,913", OWN),
    ("at 137, 58, 642, 913.", OWN),
    ("<|begin_of_box|>7,8,19,20<|end_of_box|><|begin_of_box|>7,8,19,20<|end_of_box|>", None),
    ("<|begin_of_box|>642,58,137,913<|end_of_box|>", None),
    ("<|begin_of_box|>7,8,19,1004<|end_of_box|>", None),
    ("7,8,19,20,33", None),
    ("7.5,8,19,20", None),
    ("", None),
    ("nothing to see", None),
    (None, None),
]


def test_parsing(spark):
    for cases, parse in ((PARSED, parsing.parse_box), (GLM, parsing.parse_glm_box)):
        df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "k int, x string")
        assert values(df, parse(F.col("x"))) == [want for _, want in cases]
    one = spark.createDataFrame([(0, "[0.1,0.2,0.3,0.4]")], "k int, x string")
    assert values(one, parsing.parse_box(F.col("x"), "normalized")) == [[0.1, 0.2, 0.3, 0.4]]
    with pytest.raises(ValueError):
        parsing.parse_box(F.col("x"), "percent")


MIRRORED = [
    ("a tall lamp left of two stools", "a tall lamp right of two stools", True),
    ("rightmost jar, then the leftmost lid", "leftmost jar, then the rightmost lid", True),
    ("RIGHT gate and Left hedge", "LEFT gate and Right hedge", True),
    ("Right-Most kite", "Left-most kite", True),
    ("three grey pebbles under a bench", "three grey pebbles under a bench", False),
    ("second symbol to the right of the logo", "second symbol to the right of the logo", False),
    ("bandage round the left wrist of a man to the right", "bandage round the left wrist of a man to the right", False),
    ("a right‑hand mitten", "a right‑hand mitten", False),
    ("some leftovers", "some leftovers", False),
    ("", "", False),
    (None, None, False),
]


def test_mirrored_queries(spark):
    df = spark.createDataFrame([(k, x) for k, (x, _, _) in enumerate(MIRRORED)], "k int, x string")
    assert [tuple(v) for v in values(df, t.mirror_query(F.col("x")))] == [(q, c) for _, q, c in MIRRORED]


def test_query_rules(spark):
    cases = [
        ('`"Two muddy boots under a striped umbrella!"`', None),
        ("the red rectangle", "query mentions annotation scaffolding"),
        ("(100, 200)", "query contains coordinate-like output"),
        ("the red box", None),
        (" . ", "empty response"),
        ("a\nb", "query must be one line"),
        ("<|x|> a", "query contains a model control token"),
        ("- a chair", "query contains markdown formatting"),
        ("123", "expected 1-55 English words, got 0"),
        ("word " * 56, "expected 1-55 English words, got 56"),
        ("café éé", "query is not predominantly English/ASCII"),
        (None, "empty response"),
        ("the highlighted cup", "query mentions annotation scaffolding 'highlighted'"),
        ("the cup in this image", "query mentions annotation scaffolding 'this image'"),
        ("the cropped lawn", None),
        ("the RGB cup", "query mentions annotation term 'RGB'"),
        ("the thing", "query uses generic category 'thing'"),
    ]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "k int, x string")
    assert values(df, t.annotation_fault(F.col("x"))) == [want for _, want in cases]
    assert values(df, t.clean_query(F.col("x")))[0] == "Two muddy boots under a striped umbrella"
    exact = spark.createDataFrame([(0, " Straẞe  X ")], "k int, x string")
    assert values(exact, t.collision_key(F.col("x"), exact=True)) == ["strasse x"]


def test_ids(spark):
    df = spark.createDataFrame([(0, "001_5", "x"), (1, "n", "Raw/012/color/3.png"), (2, "n", "a/b")], "k int, i string, v string")
    assert values(df, t.scene_of(F.col("i"), F.col("v"))) == ["001", "012", None]
    assert values(df, t.item_key(F.col("i"), F.col("k") * 60)) == ["001_5#00", "n#60", "n#120"]


def test_hashes_are_canonical(spark):
    import hashlib
    import json

    rows = {f"k{n}é": {"b": [n, 0.1, 1e-05, None], "a": "日本", "z": {"y": 1.0, "x": True}} for n in range(150)}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()], "id string, raw string")
    want = hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert hashing.dataset_fingerprint(df) == want == hashing.stable_hash(rows)
    picked = {k: {f: v.get(f) for f in hashing.SOURCE_FIELDS} for k, v in rows.items()}
    assert hashing.source_fingerprint(df) == hashing.stable_hash(picked)
    with pytest.raises(ValueError):
        hashing.dataset_fingerprint(df.unionAll(df.limit(1)))
    with pytest.raises(ValueError):
        hashing.key_hash(["a", "a"])
    assert hashing.folder_hash([]) == "base" and hashing.folder_hash([("a", b"x")]).startswith("lora_")
    assert hashing.run_id({"a": 1, "lora_path": "/x"}) == hashing.run_id({"a": 1, "lora_path": "/y"}) != hashing.run_id({"a": 2})


def test_schedule(spark):
    df = spark.range(1).select(F.lit(0).alias("k"), F.array(*map(F.lit, (-100, -100, 5, 6))).cast("array<long>").alias("x"), F.array(F.lit(5), F.lit(6)).cast("array<long>").alias("y"))
    assert [tuple(v) for v in values(df, schedule.supervised_window(F.col("x")))] == [(3, [5, 6, -100])]
    assert [tuple(v) for v in values(df, schedule.supervised_window(F.col("y")))] == [(2, [6, -100])]
    assert values(df, schedule.prompt_length(F.slice("x", 1, 2), F.col("x"))) == [2] and values(df, schedule.prompt_length(F.col("y"), F.col("x"))) == [None]
    assert values(df, schedule.padded(F.col("y"), F.lit(4), 0)) == [[5, 6, 0, 0]]
    step = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 25).alias("s"))
    got = values(step, schedule.rate_factor(F.col("s"), F.lit(100), F.lit(50)))
    assert got == pytest.approx([0, 0.5, 1, 0.1 + 0.9 * 0.5 * (1 + math.cos(math.pi / 2)), 0.1])


def test_what_hashes_send_to_the_driver(spark, monkeypatch):
    """Both fingerprints come from one pass, whose chunks are far smaller than the members; keys are distinct across chunks too."""
    import json

    monkeypatch.setattr(hashing, "CHUNK", 4000)
    rows = {f"{n:05d}": {**{m: f"Raw/{n % 40:03d}/{m}/{n}.png" for m in ("visible", "infrared", "depth")}, "query": f"the é {n}", "bbox": [0.0, n / 7], "width": 640, "height": 480} for n in range(3000)}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()], "id string, raw string").repartition(5)
    paths = []
    monkeypatch.setattr(hashing, "scratch", lambda s, name, own=hashing.scratch: paths.append(own(s, name)) or paths[-1])
    source = {k: {f: v.get(f) for f in hashing.SOURCE_FIELDS} for k, v in rows.items()}
    assert hashing.fingerprints(df) == {"source_fingerprint": hashing.stable_hash(source), "dataset_fingerprint": hashing.stable_hash(rows)}
    sent = spark.read.parquet(paths[0]).agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("packed"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("whole")).first()
    assert len(paths) == 1 and sent.n > 50 and sent.packed * 4 < sent.whole
    for k in range(0, 3000, 701):
        with pytest.raises(ValueError):
            hashing.dataset_fingerprint(df.unionAll(df.where(F.col("id") == f"{k:05d}")))
    assert hashing.dataset_fingerprint(df.limit(0)) == hashing.stable_hash({})
