"""Writing log files from lines that a join made."""

import os

from pyspark.sql import functions as F

from worktrail.catalog.log_files import write_logs
from worktrail.session import materialise, spread


def test_a_log_is_written_whole_after_a_join_by_path(spark, tmp_path):
    """As many partitions as the join has; it turns into a broadcast while it runs."""
    settings = {"spark.sql.shuffle.partitions": str(spread(spark)), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = materialise(spark.range(0, 4000, 1, 8).select(F.concat(F.lit("p/a"), F.col("id") % 40, F.lit(".jsonl")).alias("path"), F.col("id").alias("seq"), F.col("id").cast("string").alias("line")))
        chosen = rows.where("seq < 20").select("path").distinct()
        write_logs(rows.join(chosen, "path", "left_semi"), str(tmp_path))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(os.listdir(tmp_path / "p")) == 20
    for i in range(20):
        assert (tmp_path / "p" / f"a{i}.jsonl").read_text().split() == [str(x) for x in range(i, 4000, 40)]
