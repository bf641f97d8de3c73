"""Every query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from bayerloom import plans

from .conftest import SF


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows(spark, oracle, name):
    df = plans.QUERIES[name](spark, SF)
    expected = oracle.sql(plans.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    places = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in places) for r in expected.fetchall())


@pytest.mark.parametrize("name, passed_over", [("stream_dual_decode", {603}), ("stream_average", set())])
def test_streams_keep_numbers_over_gaps(spark, tmp_path, name, passed_over):
    """Runs of ten frames with gaps between them; a half frame's buffer after 602 frames is 0, which is no change for a stream that begins there."""
    source, folder = f"{SF}/events.parquet", str(tmp_path)
    duckdb.sql(f"copy (select event_id + 200 * k as event_id, * exclude (event_id) from '{source}', (values (0), (6), (11), (201), (206), (603), (608), (5001), (5006)) shifts(k) where event_id < 1000) to '{folder}/events.parquet' (format parquet)")
    connection = duckdb.connect()
    connection.sql(f"create view events as select * from '{folder}/events.parquet'")
    expected = connection.sql(plans.ORACLE_SQL[name])
    rows = [tuple(r[c] for c in expected.columns) for r in plans.QUERIES[name](spark, folder).collect()]
    assert sorted(rows) == sorted(r for r in expected.fetchall() if r[0] not in passed_over) and len(rows) >= 800


def test_every_query_has_an_oracle():
    assert set(plans.QUERIES) == set(plans.ORACLE_SQL)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1000
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
