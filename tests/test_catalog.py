"""Registered queries against their SQL on the small driver tables."""

import os

import duckdb
import pytest

from kmerloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
CHOSEN = ["search_results", "unique_kmers", "wide_results", "four_letter_search", "kmer_qc_pass_counts", "kmer_status_counts", "fasta_stats", "n_content", "align_records", "align_sample_qc", "align_status", "upset_top_pinned", "interval_islands", "hit_filter", "region_summary"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    found = sql.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    expected = sorted(repr(tuple(r[i] for i in places)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == expected
