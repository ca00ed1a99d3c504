"""Queries over written logs: slice by slice, with whole results and no logs left behind."""

import os

import check_oracle
import pytest

from worktrail.catalog import load, source_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.mark.parametrize("name", ["s15_report_counts", "j24_reconciliation", "j07_sidecar_activity", "s12_incremental_build", "r1_live_messages", "s01_log_scan"])
def test_slices_give_the_whole_and_leave_no_logs(spark, monkeypatch, name):
    monkeypatch.setattr(source_queries, "SLICE_RECORDS", 600)
    folder = lambda: spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = {x for x in os.listdir(folder()) if x.startswith("logs-")} if spark.sparkContext.getCheckpointDir() else set()
    ok, message = check_oracle.compare(spark, check_oracle.connect(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, message
    assert {x for x in os.listdir(folder()) if x.startswith("logs-")} <= before
    assert len(list(source_queries.tree_slices(spark, SF))) == 2
