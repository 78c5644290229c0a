"""Registry health, and a sample of queries compared with DuckDB on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry
from check_results import TABLES, canon

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
SAMPLE = ["book_chunk_summary", "chapter_detection", "pause_policy", "segment_start_times", "playhead_lookup", "name_dictionary", "best_voice",
          "book_status_rollup", "segment_edits", "quote_spans", "assembled_script", "stitch_chains", "nested_book_pages"]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(canon(v) for v in r) for r in cur.fetchall())
    assert sorted(tuple(canon(v) for v in r) for r in df.select(cols).collect()) == want
