"""Every registered query of the library against its SQL on another engine, over the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from scriptorium.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, db, name):
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: No text of the small tables has what these look for; test_text.py and test_operators.py do.
FIND_NOTHING = {"acronym_expansions"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    """Whole results are made, and they are the same a second time in another partitioning."""
    one = rows(QUERIES[name](spark, SF).toPandas())
    assert bool(one) == (name not in FIND_NOTHING)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(QUERIES[name](spark, SF).toPandas()) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]


def test_filters_reach_the_files(spark, capsys):
    QUERIES["prefix_users"](spark, SF).explain("formatted")
    said = capsys.readouterr().out
    assert "StringStartsWith(c_name" in said and "ReadSchema: struct<c_custkey:bigint,c_name:string>" in said


def test_nothing_outside_imports_the_training_subpackage():
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for folder, _, files in os.walk(os.path.join(root, "scriptorium")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "scriptorium.llm" not in text.read() and "from ..llm" not in f
