"""Sets of tables published as one version.

All tables of a version are written first; a marker file makes the version
readable last. Readers take the newest marked version, so they never see half
of one, and a write that fails leaves the one before as it was.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

MARKER = "_published"


def _store(spark: SparkSession, path: str):
    """(file system, path) through Hadoop: any store that Spark writes to."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def folder(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/versions/{version:08d}"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, oldest first."""
    system, path = _store(spark, f"{root.rstrip('/')}/versions")
    if not system.exists(path):
        return []
    found = sorted(int(s.getPath().getName()) for s in system.listStatus(path) if s.getPath().getName().isdigit())
    return [v for v in found if system.exists(_store(spark, f"{folder(root, v)}/{MARKER}")[1])]


def mark(spark: SparkSession, root: str, version: int) -> None:
    """Make a version readable. Fails if it already is, so of two writers one loses."""
    system, path = _store(spark, f"{folder(root, version)}/{MARKER}")
    system.create(path, False).close()


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], root: str) -> int:
    """Write the tables as the next version; returns its number."""
    version = max(versions(spark, root), default=0) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder(root, version)}/{name}")
    mark(spark, root, version)
    return version


def published(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """Tables of a version, the newest by default; empty if nothing is published."""
    version = version or max(versions(spark, root), default=0)
    if version not in versions(spark, root):
        return {}
    system, path = _store(spark, folder(root, version))
    names = [s.getPath().getName() for s in system.listStatus(path) if s.isDirectory()]
    return {name: spark.read.parquet(f"{folder(root, version)}/{name}") for name in sorted(names)}
