"""Incremental builds over a store of parsed records and session tables.

A refresh lists the logs, compares the listing with the last version, and reads
only logs whose signature, place or schema changed. Their records and the
session tables made of them are appended as a batch; a version is one row per
session that names the batches it is read from, so neither records nor tables
of unchanged sessions are opened or written again.

A fork leaves out what an ancestor holds: when a log changes or goes, all
sessions of its fork tree, as it was and as it is, are built again from their
stored records, without opening their logs.

    <store>/records/schema=<s>/batch=<n>    parsed records
    <store>/parts/schema=<s>/<table>/batch=<n>    session tables
    <store>/versions/<n>    logs and sidecars of the version, marked last
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.operators import forks
from worktrail.plans import build, publish
from worktrail.session import materialise, ship_package
from worktrail.sources import logs

SCHEMA_VERSION = 2
IDENTITY = ["session_id", "path", "signature", "schema_version"]
SessionTables = Callable[[DataFrame, build.LogTables, build.LogDialect], dict[str, DataFrame]]
LEARNT = ["parent_session", "dropped", "read_batch", "built_batch"]


@dataclass(frozen=True)
class Version:
    """A version of the store: log files, session tables, and what the refresh did."""

    number: int
    files: DataFrame
    owned: DataFrame
    parts: dict[str, DataFrame]
    logs_read: int = 0
    sessions_built: int = 0


def _live(spark: SparkSession, path: str, files: DataFrame, batch: str) -> DataFrame:
    """Rows of the sessions' batches; batches that no session names are not opened."""
    batches = [r[0] for r in files.select(batch).where(F.col(batch).isNotNull()).distinct().collect()]
    named = files.select("session_id", F.col(batch).alias("batch"))
    rows = spark.read.parquet(path).where(F.col("batch").isin(batches))
    return rows.join(named, ["session_id", "batch"], "left_semi").drop("batch")


def _records(store: str) -> str:
    return f"{store.rstrip('/')}/records/schema={SCHEMA_VERSION}"


def _part(store: str, name: str = "") -> str:
    return f"{store.rstrip('/')}/parts/schema={SCHEMA_VERSION}/{name}"


def current(spark: SparkSession, store: str) -> Version | None:
    """The newest version, None before the first refresh."""
    number = max(publish.versions(spark, store), default=0)
    if not number:
        return None
    tables = publish.published(spark, store, number)
    files = tables["logs"]
    system, path = publish._store(spark, _part(store))
    names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
    kept = files.drop(*LEARNT[:1], *LEARNT[2:], "schema_version")
    parts = {n: _live(spark, _part(store, n), files, "built_batch") for n in sorted(names)}
    return Version(number, kept, tables["owned"], parts | {"files": kept})


def refresh(spark: SparkSession, root: str, store: str, dialect: build.LogDialect | None = None, tables_of_sessions: SessionTables = build.session_tables) -> Version:
    """Bring the store up to date with a log folder.

    `tables_of_sessions` makes the session tables that are kept: any tables with
    a session_id whose rows depend on their session's records alone.
    """
    dialect = dialect or build.DialectA()
    ship_package(spark)
    before = current(spark, store)
    number = (before.number if before else 0) + 1
    found, owned = logs.find_logs(logs.list_files(spark, root), root, dialect.name, dialect.flat)
    found = found.withColumn("schema_version", F.lit(SCHEMA_VERSION))
    old = publish.published(spark, store, before.number)["logs"] if before else None
    if old is None:
        stale, gone = materialise(found.select("session_id")), found.select("session_id").where("false")
    else:
        stale = materialise(found.join(old.select(*IDENTITY), IDENTITY, "left_anti").select("session_id"))
        gone = materialise(old.join(found, "session_id", "left_anti").select("session_id"))
        if stale.isEmpty() and gone.isEmpty():
            return before

    # Read what changed.
    read = owned.join(stale, "session_id", "left_semi")
    dialect.parse(logs.read_logs(read)).write.mode("overwrite").parquet(f"{_records(store)}/batch={number}")
    fresh = spark.read.parquet(f"{_records(store)}/batch={number}")
    first = dialect.tables(fresh)
    marked = build.mark_dropped(found.join(stale, "session_id", "left_semi"), first)
    parents = build.primary(first.header).select("session_id", "parent_session")
    new = marked.join(parents, "session_id", "left").withColumns({"read_batch": F.lit(number), "built_batch": F.lit(number)})
    if old is not None:
        unchanged = found.join(stale, "session_id", "left_anti").join(old.select("session_id", *LEARNT), "session_id")
        new = new.unionByName(unchanged)
    new = materialise(new)

    # Build what that touches.
    links = lambda files: forks.parent_links(files.select("session_id", "parent_session"))
    trees = None if dialect.flat else build.fork_trees(links(new))
    touched = stale
    past = None if dialect.flat or old is None else build.fork_trees(links(old))
    for labels in (trees, past):
        if labels is not None:
            changed = stale.unionByName(gone)
            roots = labels.join(changed, "session_id", "left_semi").select("root").distinct()
            touched = touched.unionByName(labels.join(roots, "root", "left_semi").select("session_id"))
    touched = materialise(touched.distinct())
    files = new.join(touched, "session_id", "left_semi")
    records = _live(spark, _records(store), files, "read_batch")
    tables = build.without_dropped(files, dialect.tables(build.without_copies(records, trees)))
    parts = tables_of_sessions(files, tables, dialect)
    for name, df in parts.items():
        if name != "files":
            df.write.mode("overwrite").parquet(f"{_part(store, name)}/batch={number}")
    again = touched.withColumn("_again", F.lit(number))
    version = new.join(again, "session_id", "left").withColumn("built_batch", F.coalesce("_again", "built_batch")).drop("_again")
    where = publish.folder(store, number)
    version.write.mode("overwrite").parquet(f"{where}/logs")
    owned.write.mode("overwrite").parquet(f"{where}/owned")
    publish.mark(spark, store, number)
    done = current(spark, store)
    return Version(number, done.files, done.owned, done.parts, read.count(), files.count())


def compact(spark: SparkSession, store: str) -> Version:
    """Rewrite all live rows as one batch of a new version; older batches can then go."""
    before = current(spark, store)
    number = before.number + 1
    old = publish.published(spark, store, before.number)["logs"]
    _live(spark, _records(store), old, "read_batch").write.mode("overwrite").parquet(f"{_records(store)}/batch={number}")
    for name, df in before.parts.items():
        if name != "files":
            df.write.mode("overwrite").parquet(f"{_part(store, name)}/batch={number}")
    old.withColumns({"read_batch": F.lit(number), "built_batch": F.lit(number)}).write.mode("overwrite").parquet(f"{publish.folder(store, number)}/logs")
    before.owned.write.mode("overwrite").parquet(f"{publish.folder(store, number)}/owned")
    publish.mark(spark, store, number)
    return current(spark, store)
