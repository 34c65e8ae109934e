"""Queries that run a whole job, against their SQL or plain models on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from test_queries import SF, TABLES, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


def compare(spark, name, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf).toPandas()
    done = con.execute(entry.oracle_sql()[name])
    want = pd.DataFrame(done.fetchall(), columns=[c[0] for c in done.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return got


def test_replies_up_to_the_limit_are_sliced(spark):
    got = compare(spark, "plan_reply_slice")
    assert got["value"].dropna().str.len().between(2001, 25000).any()


def test_ingest_of_all_run_dates(spark):
    got = compare(spark, "stream_ingest_dates")
    assert got["report_date"].nunique() > 2 and got.groupby("id")["report_date"].nunique().max() > 1


def test_visits_behind_the_watermark_are_counted(spark):
    got = compare(spark, "stream_visitors_late")
    assert got["late_views"].sum() > 0
