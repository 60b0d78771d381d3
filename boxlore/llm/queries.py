"""The corpus operators as queries over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, collocations, decontaminate, language, mixture, pii, quality, range_join, simhash, suffix_dedup, token_counts, toxicity, vector_codes
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded_digests(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM w) WHERE c > 1),
b AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, TRUE) AS first FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(CAST(first AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b) GROUP BY doc_id, k),
t AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT t.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.p = win.p AND dw.n = win.n),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id),
q AS (SELECT DISTINCT item_id, n, list_distinct(string_split(p, ' ')) AS q FROM win),
occ AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
freq AS (SELECT word, count(*) AS c FROM occ GROUP BY word),
rare AS (SELECT item_id, n, q, arg_min(word, c) AS word FROM (SELECT item_id, n, q, unnest(q) AS word FROM q) JOIN freq USING (word) GROUP BY item_id, n, q),
c AS (SELECT doc_id, item_id, n, q, i, w FROM rare JOIN occ USING (word) JOIN d USING (doc_id) WHERE list_has_all(w[greatest(i - n - 1, 1):i + n + 1], q)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM c WHERE len(list_filter(generate_series(greatest(i - n - 1, 1), i), lambda s: list_has_all(w[s:s + n + 1], q))) > 0 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

OP5_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(min(embedding) AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL GROUP BY vec_id),
u AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS r FROM v UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.r = link.a),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), n AS (SELECT a AS id, count(*) AS n_links FROM link GROUP BY a)
SELECT c.id AS vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, c.id = component_id AS kept FROM c LEFT JOIN n USING (id)
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || CAST(doc_id AS VARCHAR)) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
r AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM s),
x AS (SELECT *, row_number() OVER w AS turn, sum(CAST(source_size AS DOUBLE)) OVER () AS total,
             coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)) AS clamped,
             sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)) AS heavy
      FROM r WINDOW w AS (ORDER BY cap / weight, rank)),
l AS (SELECT *, (total * CAST(1.5 AS DOUBLE) - clamped) / heavy AS level FROM x),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, turn) FROM l WHERE level * weight <= cap) * weight, cap)) AS target FROM l),
y AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS earlier
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, whole * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size - earlier)) AS taken FROM y
"""

def _op11_rounds() -> str:
    """Assignment ``a``k to codebook ``c``k, and the codebook after it."""
    step = """
d{k} AS MATERIALIZED (SELECT r, v.part, entry, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{k} AS c ON v.part = c.part AND v.pos = c.pos GROUP BY r, v.part, entry),
a{k} AS MATERIALIZED (SELECT r, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM d{k} GROUP BY r, part),"""
    move = """
c{n} AS MATERIALIZED (SELECT c.entry, c.part, c.pos, coalesce(m.x, c.x) AS x FROM c{k} AS c LEFT JOIN
    (SELECT a.entry, v.part, v.pos, CAST((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM a{k} AS a JOIN v USING (r, part) GROUP BY a.entry, v.part, v.pos) AS m USING (entry, part, pos)),"""
    return step.format(k=0) + move.format(k=0, n=1) + step.format(k=1) + move.format(k=1, n=2) + step.format(k=2)


OP11_SQL = rf"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS MATERIALIZED (SELECT r, (i - 1) // s AS part, (i - 1) % s AS pos, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
                   FROM (SELECT r, embedding, len(embedding) // 16 AS s, unnest(generate_series(1, len(embedding))) AS i FROM e)),
c0 AS MATERIALIZED (SELECT r AS entry, part, pos, x FROM v WHERE r < 64),{_op11_rounds()}
t AS (SELECT r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN t USING (r), h
"""

OP13_SQL = r"""
WITH p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
i AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS s FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
o AS (SELECT c.* FROM c LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
x AS (SELECT *, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM o)),
s AS (SELECT x.lang, x.phrase, x.a, x.j, l.f AS l, r.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM x JOIN f AS l ON l.lang = x.lang AND l.phrase = x.first JOIN f AS r ON r.lang = x.lang AND r.phrase = x.rest JOIN t ON t.lang = x.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM b WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_language_id, op3_suffix_array_dedup, op4_benchmark_decontamination, op5_embedding_near_dedup,
        op6_quality_classifier, op7_source_mixing, op8_simhash_near_dedup, op9_personal_data, op10_toxicity,
        op11_vector_codes, op12_byte_bpe, op13_collocations,
    )
}
ORACLES: dict[str, str] = {"op3_suffix_array_dedup": OP3_SQL, "op4_benchmark_decontamination": OP4_SQL, "op5_embedding_near_dedup": OP5_SQL, "op7_source_mixing": OP7_SQL, "op11_vector_codes": OP11_SQL, "op13_collocations": OP13_SQL}
