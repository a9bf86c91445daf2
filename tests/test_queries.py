"""Every query against its SQL on another engine, over the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from parsloom.functions import tokens as tk
from parsloom.plans import oracles, queries

ALL, SQL = queries.queries(), oracles.oracle_sql()


def cell(x):
    if x is None or x != x:
        return "NULL"
    if isinstance(x, (float, Decimal)):
        return repr(round(float(x), 8)) if math.isfinite(x) else str(x)
    return str(x)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def test_no_sql_without_query():
    assert set(SQL) <= set(ALL)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sf_dir, duck, name):
    df = ALL[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert got
        return
    run = duck.execute(SQL[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in run.fetchall())


def test_operators_run_over_the_tables(spark, sf_dir):
    """Lemmas, subword vectors and the parser's rows come of whole tables, each word and token once."""
    text = spark.read.parquet(f"{sf_dir}/miras_doc.parquet").select(F.explode(tk.words(F.col("text"))).alias("w"))
    lemmas = ALL["informal_lemmas_of_tokens"](spark, sf_dir).collect()
    assert sorted(r["word"] for r in lemmas) == sorted(r["w"] for r in text.distinct().collect())
    rows = ALL["parser_input_of_sentences"](spark, sf_dir)
    sizes = ALL["pipeline_sentences"](spark, sf_dir)
    assert rows.count() == sizes.select(F.sum(F.size(F.split("words", " ")))).head()[0]
    assert {r["upos"] for r in rows.select("upos").distinct().collect()} == {"N", "VERB", "X"}
    vectors = ALL["subword_vectors_of_tokens"](spark, sf_dir)
    assert vectors.select("word").distinct().count() > 100 and vectors.groupBy("word", "i").count().where("count > 1").isEmpty()
