"""Queries on query texts, ids and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import contract, training
from .registry import query, table

_KINDS = (
    "'The ' || p_name || ' on the left'", "'LEFT-MOST ' || p_name", "'Rightmost ' || p_name || ' and left box'", "'the letter on the left of ' || p_name",
    "p_name || ' in the right hand'", "'`\"The ' || p_name || '.\"` '", "'highlighted ' || p_name", "p_name || ' at (10, 20)'", "'the ' || p_name || ' thing'", "'# ' || p_name", "''",
    "p_name || chr(10) || 'second'", "'<|x|> ' || p_name", "'Target ' || p_name", "'日本語の文字列と' || p_brand", "'Left left RIGHT ' || p_name", "NULL", "'the red rectangle of ' || p_name", "'in the image the ' || p_name", "'left of the ' || p_name || ' on the right.'",
)
Q = "CASE " + " ".join(f"WHEN p_partkey % {len(_KINDS)} = {n} THEN {e}" for n, e in enumerate(_KINDS)) + " END"


def texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.expr(Q).alias("query"), "p_name", "p_brand")


_T = f"t AS (SELECT p_partkey AS key, {Q} AS query, p_name, p_brand FROM part)"


def clean_sql(c: str) -> str:
    out = f"coalesce({c}, '')"
    for x in (r"\s", "`", r"\s", '"', "'", r"\s"):
        e = x.replace("'", "''")
        out = f"regexp_replace({out}, '^{e}+|{e}+$', '', 'g')"
    return rf"regexp_replace(regexp_replace({out}, '[.?!;]+$', ''), '^\s+|\s+$', '', 'g')"


def _or(words) -> str:
    return "|".join(words)


def fault_sql(q: str) -> str:
    """q: a cleaned text."""
    words = f"len(regexp_extract_all({q}, '{t.WORD_PATTERN.replace(chr(39), chr(39) * 2)}'))"
    scaffold = " OR ".join(f"contains(lower({q}), '{p}')" for p in t.FORBIDDEN_PHRASES)
    return (
        f"CASE WHEN {q} = '' THEN 'empty response' WHEN regexp_matches({q}, '[\\n\\r]') THEN 'query must be one line' WHEN {scaffold} THEN 'query mentions annotation scaffolding' "
        f"WHEN regexp_matches({q}, '{t.COORDINATE_PATTERN}') THEN 'query contains coordinate-like output' WHEN regexp_matches({q}, '{t.CONTROL_PATTERN}') THEN 'query contains a model control token' "
        f"WHEN regexp_matches({q}, '^(?:#|- |\\* )') THEN 'query contains markdown formatting' WHEN {words} < 1 OR {words} > 55 THEN 'expected 1-55 English words, got ' || {words} "
        f"WHEN length(regexp_replace({q}, '[^\\x00-\\x7F]', '', 'g')) / CAST(length({q}) AS DOUBLE) < 0.9 THEN 'query is not predominantly English/ASCII' END"
    )


def annotation_sql(q: str) -> str:
    phrases = " ".join(f"WHEN regexp_matches(lower({q}), '(^|[^a-z]){p}([^a-z]|$)') THEN 'query mentions annotation scaffolding ''{p}'''" for p in t.SCAFFOLD_PHRASES)
    term, generic = (f"regexp_extract({q}, '(?i)\\b(?:{_or(w)})\\b')" for w in (t.ANNOTATION_TERMS, t.GENERIC_CATEGORIES))
    own = f"CASE {phrases} WHEN {term} <> '' THEN 'query mentions annotation term ''' || {term} || '''' WHEN {generic} <> '' THEN 'query uses generic category ''' || {generic} || '''' END"
    return f"coalesce({fault_sql(q)}, {own})"


@query(f"SELECT conv_id, turn, {clean_sql('text')} AS cleaned FROM conversations")
def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.clean_query(F.col("text")).alias("cleaned"))


@query(f"WITH q AS (SELECT conv_id, turn, {clean_sql('text')} AS q FROM conversations) SELECT conv_id, turn, {fault_sql('q')} AS fault FROM q")
def text_faults_of_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.query_fault(F.col("text")).alias("fault"))


@query(f"WITH q AS (SELECT doc_id, {clean_sql('text')} AS q FROM documents), f AS (SELECT doc_id, {fault_sql('q')} AS fault FROM q) SELECT coalesce(fault, 'good') AS fault, count(*) AS n FROM f GROUP BY ALL")
def text_fault_counts_of_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.coalesce(t.query_fault(F.col("text")), F.lit("good")).alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


@query(f"WITH {_T}, q AS (SELECT key, {clean_sql('query')} AS q FROM t) SELECT key, {annotation_sql('q')} AS fault FROM q")
def text_annotation_faults(spark, sf_dir):
    return texts(spark, sf_dir).select("key", t.annotation_fault(F.col("query")).alias("fault"))


@query(f"WITH {_T}, q AS (SELECT key, {clean_sql('query')} AS q FROM t), f AS (SELECT key, CASE WHEN q = '' THEN 'empty query' ELSE {annotation_sql('q')} END AS reason FROM q) SELECT count(*) AS failures, min_by(key, key) AS first_id, min_by(reason, key) AS first_reason FROM f WHERE reason IS NOT NULL")
def text_failure_summary(spark, sf_dir):
    data = texts(spark, sf_dir).select(F.col("key").alias("id"), F.col("key").alias("pos"), "query")
    return contract.failure_summary(contract.query_failures(data))


_SAFE = (
    f"coalesce(query <> '' AND NOT regexp_matches(query, '(?i)(^|[^A-Za-z])(?:{_or(t.GLYPH_WORDS)})([^A-Za-z]|$)') "
    f"AND NOT regexp_matches(query, '(?i)(^|[^A-Za-z])(?:left|right)[\\s{t.DASHES}]+(?:{_or(t.BODY_PARTS)})([^A-Za-z]|$)'), FALSE)"
)


def _mirror_sql(c: str) -> str:
    """Each word in each case to a mark, then each mark to the other word."""
    swap = {"left": "right", "right": "left", "leftmost": "rightmost", "rightmost": "leftmost", "left-most": "right-most", "right-most": "left-most"}
    out, back = c, []
    for n, w in enumerate(t.LATERAL_WORDS):
        for m, case in enumerate((str.upper, str.capitalize, str.lower)):
            mark = f"@{n}{m}@"
            out = f"regexp_replace({out}, '\\b{case(w)}\\b', '{mark}', 'g')"
            back.append((mark, case(swap[w])))
    for mark, word in back:
        out = f"replace({out}, '{mark}', '{word}')"
    return out


_LATERAL = f"regexp_matches(query, '(?i)\\b({_or(t.LATERAL_WORDS)})\\b')"
_MIRROR = f"m AS (SELECT *, {_SAFE} AS safe, {_SAFE} AND {_LATERAL} AS changed FROM t), n AS (SELECT *, CASE WHEN changed THEN {_mirror_sql('query')} ELSE query END AS mirrored FROM m)"


@query(f"WITH {_T}, {_MIRROR} SELECT key, safe, changed, mirrored FROM n")
def text_mirror(spark, sf_dir):
    x = texts(spark, sf_dir).select("key", t.is_mirror_safe(F.col("query")).alias("safe"), t.mirror_query(F.col("query")).alias("m"))
    return x.select("key", "safe", "m.changed", F.col("m.query").alias("mirrored"))


_BOX = "CAST(key % 50 AS DOUBLE) / 100 AS x1, CAST(0.1 AS DOUBLE) AS y1, CAST(key % 50 AS DOUBLE) / 100 + CAST(0.25 AS DOUBLE) AS x2, CAST(0.9 AS DOUBLE) AS y2"


def _boxed(spark, sf_dir):
    x1 = (F.col("key") % 50).cast("double") / 100
    return texts(spark, sf_dir).withColumn("bbox", F.array(x1, F.lit(0.1), x1 + 0.25, F.lit(0.9)))


def _r6(e):
    return f"CAST(CAST(CAST({e} AS DECIMAL(20,12)) AS DECIMAL(20,6)) AS DOUBLE)"


@query(f"WITH {_T}, {_MIRROR}, b AS (SELECT *, {_BOX} FROM n WHERE query <> '') SELECT key, FALSE AS is_flipped, query, x1, x2 FROM b UNION ALL SELECT key, TRUE, mirrored, {_r6('1 - x2')}, {_r6('1 - x1')} FROM b WHERE changed")
def training_augment(spark, sf_dir):
    x = training.augment(_boxed(spark, sf_dir))
    return x.select("key", "is_flipped", "query", F.get("bbox", 0).alias("x1"), F.get("bbox", 2).alias("x2"))


@query(f"WITH {_T}, {_MIRROR} SELECT CAST(sum(1 + CAST(changed AS INTEGER)) AS BIGINT) AS n FROM n WHERE query <> ''")
def training_effective_count(spark, sf_dir):
    return training.effective_count(_boxed(spark, sf_dir))


@query("SELECT p_brand AS visible, trim(lower(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS query_key, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def text_collisions(spark, sf_dir):
    return contract.collisions(table(spark, sf_dir, "part").select(F.col("p_brand").alias("visible"), F.col("p_name").alias("query")))


@query("SELECT p_brand AS visible, trim(lower(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS query_key, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def text_collisions_exact(spark, sf_dir):
    """The folding beyond lower case, over names of ASCII letters, where both are one."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("visible"), t.collision_key(F.col("p_name"), exact=True).alias("query_key"))
    return p.groupBy("visible", "query_key").agg(F.count("*").alias("n")).where("n > 1")


_ROUTE = "CASE c_custkey % 5 WHEN 0 THEN '/api/item/' || CAST(c_custkey AS VARCHAR) || '%23%C3%A9+1/bbox' WHEN 1 THEN '/api/item//bbox' WHEN 2 THEN '/api/item/a/b/bbox' WHEN 3 THEN '/api/items/' || c_name || '/bbox' ELSE '/api/item/' || c_name || '/bbox' END"


@query(f"WITH r AS (SELECT c_custkey AS key, {_ROUTE} AS path FROM customer) SELECT key, CASE WHEN key % 5 IN (0, 4) THEN url_decode(regexp_extract(path, '^/api/item/([^/]+)/bbox$', 1)) END AS item FROM r")
def text_routes(spark, sf_dir):
    path = F.expr(_ROUTE.replace("AS VARCHAR", "AS STRING"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), t.item_of_route(path, "/bbox").alias("item"))


_ID = "CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE lpad(CAST(o_custkey AS VARCHAR), 4, '0') || '_' || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '_b' ELSE '' END END"
_PATH = "CASE o_orderkey % 5 WHEN 0 THEN 'Raw/' || CAST(o_custkey AS VARCHAR) || '/color/a.b.png' WHEN 1 THEN '/abs/x.png' WHEN 2 THEN 'a/../b.png' WHEN 3 THEN 'Raw//c.png' ELSE 'Raw/007/color/.hidden' END"


@query(
    f"WITH o AS (SELECT o_orderkey AS key, {_ID} AS id, {_PATH} AS path FROM orders) SELECT key, CASE WHEN contains(id, '_') THEN split_part(id, '_', 1) ELSE nullif(regexp_extract(path, '(?:^|/)([0-9]+)(?:/|$)', 1), '') END AS scene, "
    "id || '#' || CASE WHEN key % 120 < 10 THEN '0' ELSE '' END || CAST(key % 120 AS VARCHAR) AS item, CASE key % 5 WHEN 0 THEN 'a.b' WHEN 1 THEN 'x' WHEN 2 THEN 'b' WHEN 3 THEN 'c' ELSE '.hidden' END AS stem, key % 5 IN (0, 4) AS canonical, replace(path, '/color/', '/depth/') AS depth FROM o"
)
def text_ids_and_paths(spark, sf_dir):
    s = lambda e: F.expr(e.replace("AS VARCHAR", "AS STRING"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), s(_ID).alias("id"), s(_PATH).alias("path"))
    return o.select("key", t.scene_of(F.col("id"), F.col("path")).alias("scene"), t.item_key(F.col("id"), F.col("key") % 120).alias("item"), t.stem(F.col("path")).alias("stem"), t.is_canonical_path(F.col("path")).alias("canonical"), t.modality_path(F.col("path"), "depth").alias("depth"))


_TAGS = "CASE p_partkey % 6 WHEN 0 THEN 'run_train_a' WHEN 1 THEN 'run-val' WHEN 2 THEN 'run_trainer' WHEN 3 THEN 'val' WHEN 4 THEN 'x_val-y_train' ELSE '' END"


@query(f"SELECT p_partkey AS key, regexp_replace({_TAGS}, '[-_](train|val)([-_]|$)', '\\2', 'g') AS tag, coalesce(nullif({_TAGS}, ''), CASE WHEN p_partkey % 4 = 0 THEN 'val' ELSE 'train' END) AS split FROM part")
def text_run_tags(spark, sf_dir):
    path = F.when(F.col("p_partkey") % 4 == 0, "out/my_val_set.json").otherwise("val/other.json")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), t.common_tag(F.expr(_TAGS)).alias("tag"), t.split_name(F.expr(_TAGS), F.lit(None).cast("string"), path).alias("split"))


_WHO = "CASE c_custkey % 9 WHEN 0 THEN 'ann' WHEN 1 THEN 'ann:absent' WHEN 2 THEN 'bob:todo' WHEN 3 THEN 'seed' WHEN 4 THEN 'seed:absent' WHEN 5 THEN '' WHEN 6 THEN 'ai-prelabel' WHEN 7 THEN 'ai-prelabel:absent' END"


@query(
    f"WITH w AS (SELECT c_custkey AS key, {_WHO} AS a FROM customer) SELECT key, key % 9 IN (0, 6) AS human, coalesce(a IN ('', 'seed', 'seed:absent') OR a LIKE '%:todo', TRUE) AS pending, replace(a, 'ai-prelabel', 'seed') AS alias FROM w"
)
def text_annotators(spark, sf_dir):
    a = F.expr(_WHO)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), t.is_human(a).alias("human"), t.is_pending(a).alias("pending"), t.seed_alias(a).alias("alias"))


@query("SELECT conv_id, turn, 'Find: ' || text || ' now' AS content, length(text) AS answer_chars, 3 AS turns FROM conversations")
def text_chat_records(spark, sf_dir):
    c = t.chat_record(F.lit("You find things."), F.lit("Find: {query} now"), F.col("text"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(c, 1)["content"].alias("content"), F.length(F.get(c, 2)["content"]).alias("answer_chars"), F.size(c).alias("turns"))
