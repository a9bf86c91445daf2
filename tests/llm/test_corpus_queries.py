"""Every corpus-preparation query on the smallest tables; problems 7 and 8 against their SQL on another engine."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from parsloom.llm import queries

COLUMNS = {
    "p1_found": ["source_table", "doc_key"],
    "p2_found": ["source_table", "doc_key", "end_pos"],
    "p3_found": ["source_table", "doc_key", "field"],
    "p4_found": ["source_table", "doc_key", "line_no"],
    "p5_found": ["source_table", "doc_key"],
    "p6_ids": ["doc_id", "ids"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id_a", "doc_id_b"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf_dir, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for p in glob.glob(f"{sf_dir}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        run = con.execute(queries.oracle_sql()[name])
        assert [d[0] for d in run.description] == df.columns
        assert sorted(run.fetchall()) == sorted(rows)


def test_text_comes_back(spark, sf_dir):
    want = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["decoded"] for r in queries.p6_decoded(spark, sf_dir).collect()} == want
