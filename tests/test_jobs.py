"""Background jobs of both kinds."""

import check_oracle

import __spark_entry__ as entry

SF = "/root/testdata/sf0.1"  # smaller tables have no shell job whose call waits for something


def test_all_background_jobs(spark):
    name = "j04_all_background_jobs"
    ok, message = check_oracle.compare(spark, check_oracle.connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message
    rows = entry.queries()[name](spark, SF).collect()
    tasks = entry.queries()["j04_background_jobs"](spark, SF).collect()
    assert sorted(r for r in rows if r.job_type == "task") == sorted(tasks)
    assert len({r.bucket for r in rows if r.job_type == "bash"}) > 1
