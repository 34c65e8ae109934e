"""Registered queries against their SQL on the smallest tables (a sample of the costly ones)."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from broadsheet.queries.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(tuple(str(v) for v in r) for r in frame.itertuples(index=False, name=None))


NAMES = ["scan_feed_xml", "recency_filter", "host_policy", "quota_select", "dedupe_history", "backfill_asof", "anti_prev_day",
         "visitor_stats_idle", "validate_document", "validate_plan", "drop_toc", "stream_daily_views", "stream_visitors",
         "report_index", "snapshot_write", "stream_ingest", "visitor_approx", "line_signals", "prompt_bundle"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    done = duck.execute(entry.oracle_sql()[name])
    want = pd.DataFrame(done.fetchall(), columns=[c[0] for c in done.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries())
