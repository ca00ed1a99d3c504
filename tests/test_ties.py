"""Ties against SQL: equal times across sessions, equal sums of other parts."""

import datetime as dt
import json

import check_oracle
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

START = dt.datetime(2024, 1, 1, 12)


def agrees(spark, folder, name, rows):
    """Whether a query equals its SQL on (ms, user, type, value, k) events."""
    columns = {
        "event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array([START + dt.timedelta(milliseconds=r[0]) for r in rows], pa.timestamp("us")),
        "user_id": pa.array([r[1] for r in rows], pa.int64()), "event_type": [r[2] for r in rows],
        "value": pa.array([float(r[3]) for r in rows], pa.float64()), "props": [json.dumps({"k": r[4]}) for r in rows],
    }
    pq.write_table(pa.table(columns), f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"SET TimeZone='UTC'; CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return check_oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], str(folder))


@pytest.mark.parametrize("name", ["j12_interleavings", "j12_overlap_summary"])
@pytest.mark.parametrize("rows", [
    # Users 50, 0 and 10 of one team at the same time: by id "u0" would come first.
    [(0, 20, "signup", 0, 1), (10, 50, "signup", 0, 1), (10, 0, "signup", 0, 1), (10, 10, "signup", 0, 1), (20, 20, "signup", 0, 1), (30, 0, "signup", 0, 1)],
    # "u0" arrives before the pair of "u20" begins at the same time.
    [(10, 0, "signup", 0, 1), (10, 20, "signup", 0, 1), (20, 20, "signup", 0, 1), (30, 0, "signup", 0, 1)],
    # A table in which arrival and time differ.
    [(0, 20, "signup", 0, 1), (40, 20, "signup", 0, 1), (10, 30, "signup", 0, 1), (5, 20, "signup", 0, 1), (50, 30, "signup", 0, 1), (45, 20, "signup", 0, 1)],
])
def test_equal_times_interleave_in_order_of_arrival(spark, tmp_path, name, rows):
    ok, message = agrees(spark, tmp_path, name, rows)
    assert ok, message


def test_requests_of_equal_time_rank_by_the_sum_that_sql_sees(spark, tmp_path):
    # 0.3 s of waiting, then 0.1 s of model and 0.2 s of tools: 0.30000000000000004.
    rows = [(0, 1, "signup", 0, 1), (300, 1, "signup", 0, 1), (400, 1, "view", 100.01 / 60000, 1), (600, 1, "click", 200.01 / 60000, 1), (600, 1, "signup", 0, 1), (650, 1, "signup", 0, 1)]
    ok, message = agrees(spark, tmp_path, "t6_slowest_requests", rows)
    assert ok, message
