"""The mapped messages written as log files, for queries that start from files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.session import ensure_checkpoint_dir, ship_package, spread
from worktrail.sources.scan import open_store


def new_folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def written_logs(lines: DataFrame) -> Iterator[str]:
    """The folder of the written lines, gone at the end: logs are many times their tables' size."""
    root = new_folder(lines.sparkSession, "logs")
    try:
        write_logs(lines, root)
        yield root
    finally:
        drop_folder(root)


def drop_folder(root: str) -> None:
    system, base = open_store(root)
    system.delete_dir(base)


def write_logs(lines: DataFrame, root: str) -> None:
    """Write (path, seq, line) below `root`, a file per path, as lines stream past.

    Files are opened one at a time and truncated first, so a task that runs
    again writes the same.
    """
    ship_package(lines.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, out, n = None, None, 0
        system, base = open_store(root)
        made = set()
        for batch in batches:
            for name, line in zip(batch["path"], batch["line"]):
                if name != path:
                    if out:
                        out.close()
                    folder = name.rpartition("/")[0]
                    if folder not in made:
                        system.create_dir(f"{base}/{folder}", recursive=True)
                        made.add(folder)
                    path, out = name, system.open_output_stream(f"{base}/{name}")
                    n += 1
                out.write(line.encode() + b"\n")
        if out:
            out.close()
        yield pd.DataFrame({"files": [n]})

    # By a hash of the path, not by the path: Spark leaves out a repartition by the key of
    # a join before it, and then may deal that join's rows out by another plan.
    ordered = lines.select("path", "seq", "line").repartition(spread(lines.sparkSession), F.xxhash64("path")).sortWithinPartitions("path", "seq")
    ordered.mapInPandas(write, "files bigint").agg(F.sum("files")).collect()
