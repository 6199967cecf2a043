import os

import duckdb
import pytest
from pyspark.sql import functions as F

from siltworks.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_its_sql_gives(spark, tables, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    got = tables.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    want = [tuple(r[names.index(c)] for c in sorted(names)) for r in got.fetchall()]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_the_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


#: Texts of which the lines' codec makes little or nothing.
ODD = (None, "", "\n", "\n\n\n", "\n \n", " ", "a\n", "\na\na", "a\r\na\r\n", "a\na", "\0\n\0", "é\né")


def odd_rows(spark, name, sf_dir):
    """What a query and its SQL give for documents of ODD."""
    spark.createDataFrame(list(enumerate(ODD * 2)), "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("src1").alias("source")).write.parquet(f"{sf_dir}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet/*.parquet'")
    got = con.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    return sorted(map(repr, (tuple(r[c] for c in names) for r in QUERIES[name](spark, str(sf_dir)).collect()))), sorted(map(repr, got.fetchall()))


def test_the_gate_counts_texts_of_which_nothing_is_left(spark, tmp_path):
    got, want = odd_rows(spark, "dedup_gate", tmp_path)
    assert got == want and len(got) == 3


def test_the_codec_of_lines_tells_the_sizes_of_every_text(spark, tmp_path):
    got, want = odd_rows(spark, "dedup_lines", tmp_path)
    assert got == want and len(got) == 2 * len(ODD)
