"""The registry, and a few queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from seriesframe.catalog import all_queries, all_sql
from __spark_entry__ import entry, oracle_sql, queries
from tools.check import compare

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_every_query_has_its_sql():
    assert set(all_sql()) == set(all_queries()) <= set(queries())


@needs_data
def test_entry_runs(spark):
    assert entry(spark).count() == 3


@needs_data
@pytest.mark.parametrize(
    "name",
    ["clean_table", "star_join_keep_left", "full_outer_join", "resolve_overlaps", "impute_linear", "impute_pmm",
     "impute_timeslot_median", "subsample_expansion_daily", "abundance_m1", "depth_scaled", "model_compare"],
)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert compare(queries()[name](spark, FOLDER), con.sql(oracle_sql()[name])).startswith("ok")
