"""The registered queries on the driver's smallest tables: columns of their contracts, and rows as SQL has them."""

import os

import duckdb
import pytest

from boxlore.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")

COLUMNS = {
    "op3": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op4": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, n_near bigint",
    "op5": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op6": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8": "doc_id bigint, fingerprint string, component_id bigint",
    "op9": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op10": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op12": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op13": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name.split("_")[0] in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name.split("_")[0]]
    if name.startswith("op13"):  # a report by language, which SQL checks
        return
    rows = {"op2": "pages", "op5": "embeddings", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    assert df.count() == spark.read.parquet(f"{FOLDER}/{rows}.parquet").count()


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(FOLDER):
        duck.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{f}')")
    df = QUERIES[name](spark, FOLDER)
    want = duck.sql(ORACLES[name]).df()
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    assert sorted(map(tuple, df.toPandas()[columns].astype(object).values), key=repr) == sorted(map(tuple, want[columns].astype(object).values), key=repr)
