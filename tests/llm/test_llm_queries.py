"""The registered queries on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from cairn.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")

COLUMNS = {
    "p1_found": [("corpus", "string"), ("record_id", "string"), ("case_id", "string")],
    "p2_found": [("scan_id", "string"), ("page_index", "int"), ("block_id", "int"), ("line_no", "int"), ("kind", "string"), ("word", "string")],
    "p4_found": [("text_id", "bigint"), ("kind", "string")],
    "p5_found": [("item_id", "bigint"), ("field", "string"), ("line_no", "int")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p8_found": [("doc_id", "bigint"), ("start_char", "bigint"), ("end_char", "bigint")],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, FOLDER)
    rows = [tuple(map(repr, r)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]


def test_sizes_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW material_texts AS SELECT * FROM '{FOLDER}/material_texts.parquet'")
    want = con.execute(Q.oracle_sql()["p4_found"]).fetchall()
    assert sorted(map(tuple, Q.p4_found(spark, FOLDER).collect())) == sorted(want) and want


def test_every_document_is_encoded_once(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert Q.p6_ids(spark, FOLDER).select("doc_id").distinct().count() == n == Q.p6_ids(spark, FOLDER).count()
