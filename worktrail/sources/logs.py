"""Finding log files and reading their records."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worktrail.session import ensure_checkpoint_dir, materialise, ship_package, spread
from worktrail.sources.scan import OPEN_COST, OWNER, SCHEMA, LogSource, open_store

ADVISOR_FILE = "__advisor.jsonl"  # fixed value: file name of an advisor sidecar
PATH_SCHEMA = "path string, size bigint, mtime_ms bigint"


LISTED_ROWS = 10_000


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every *.jsonl in a project folder of `root` or below, with size and time.

    Each folder is listed once, hidden names included, and no content is read.
    The driver sees the names of the project folders alone: tasks list these,
    and other tasks the folders of sidecars found there. A missing root gives
    no rows. Paths are those of the root's file system.
    """
    from pyarrow import fs

    system, plain = open_store(root)
    scheme = root[: root.index("://") + 3] if "://" in root and not root.startswith("file:") else ""
    projects = [i.path for i in system.get_file_info(fs.FileSelector(plain, allow_not_found=True)) if i.type == fs.FileType.Directory]
    ship_package(spark)

    def below(recursive: bool):
        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = []
            frame = lambda: pd.DataFrame(rows, columns=["path", "size", "mtime_ms", "is_folder"])
            for batch in batches:
                for folder in batch["folder"]:
                    system, plain = open_store(scheme + folder)
                    for i in system.get_file_info(fs.FileSelector(plain, recursive=recursive, allow_not_found=True)):
                        if i.is_file and i.base_name.endswith(".jsonl"):
                            rows.append((i.path, i.size, i.mtime_ns // 1_000_000, False))
                        elif not recursive and i.type == fs.FileType.Directory:
                            rows.append((i.path, 0, 0, True))
                        if len(rows) >= LISTED_ROWS:
                            yield frame()
                            rows = []
            if rows:
                yield frame()

        return look

    schema = PATH_SCHEMA + ", is_folder boolean"
    asked = spark.createDataFrame([(p,) for p in projects], "folder string").repartition(spread(spark), "folder")
    seen = materialise(asked.mapInPandas(below(False), schema))
    deeper = seen.where("is_folder").select(F.col("path").alias("folder")).repartition(spread(spark), "folder").mapInPandas(below(True), schema)
    files = seen.where("not is_folder").unionByName(deeper)
    return materialise(files.select(F.concat(F.lit(scheme), "path").alias("path"), "size", "mtime_ms"))


def _inside(path: Column, root: str) -> Column:
    """Path relative to the root folder, ignoring the file system scheme."""
    plain = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    return F.regexp_replace(F.substring_index(path, plain + "/", -1), r"^/+", "")


def primary_logs(files: DataFrame, root: str) -> DataFrame:
    """Logs at exactly <root>/<project>/<name>.jsonl.

    The id is the text after the first underscore of the name, else the name.
    """
    relative = _inside(F.col("path"), root)
    base = F.regexp_extract(relative, r"([^/]+)\.jsonl$", 1)
    after = F.regexp_extract(base, r"^[^_]*_(.*)$", 1)
    return (
        files.where(relative.rlike(r"^[^/]+/[^/]+\.jsonl$"))
        .withColumn("project_dir", F.regexp_extract(relative, r"^([^/]+)/", 1))
        .withColumn("base", base)
        .withColumn("session_id", F.when(base.contains("_"), after).otherwise(base))
    )


def sidecar_logs(files: DataFrame, root: str) -> DataFrame:
    """Logs below <root>/<project>/<base>/, with the name relative to that folder."""
    relative = _inside(F.col("path"), root)
    shape = r"^([^/]+)/([^/]+)/(.+)\.jsonl$"
    return (
        files.where(relative.rlike(shape))
        .withColumn("project_dir", F.regexp_extract(relative, shape, 1))
        .withColumn("base", F.regexp_extract(relative, shape, 2))
        .withColumn("sidecar_name", F.regexp_extract(relative, shape, 3))
        .withColumn(
            "kind",
            F.when(relative.endswith("/" + ADVISOR_FILE), "advisor").otherwise("subagent"),
        )
    )


def with_signatures(primary: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Add size:mtime of the log and of each sidecar, in name order."""
    part = F.concat(F.col("sidecar_name"), F.lit("="), F.col("size"), F.lit(":"), F.col("mtime_ms"))
    per_log = sidecars.groupBy("project_dir", "base").agg(
        F.array_join(F.array_sort(F.collect_list(part)), "|").alias("side_signature"),
        F.count_if(F.col("kind") == "advisor").alias("advisor_logs"),
        F.count_if(F.col("kind") == "subagent").alias("subagent_logs"),
    )
    own = F.concat(F.col("size"), F.lit(":"), F.col("mtime_ms"))
    return (
        primary.join(per_log, ["project_dir", "base"], "left")
        .withColumn("signature", F.concat_ws("|", own, F.col("side_signature")))
        .na.fill(0, ["advisor_logs", "subagent_logs"])
        .drop("side_signature")
    )


def drop_duplicate_logs(primary: DataFrame) -> DataFrame:
    """One log per id: the largest, then the first by path.

    An aggregate, not a window: copies combine before the shuffle, so a log
    copied very many times is no hot task.
    """
    names = [c for c in primary.columns if c != "session_id"]
    best = F.min_by(F.struct(*names), F.struct((-F.col("size")).alias("s"), F.col("path")))
    return primary.groupBy("session_id").agg(best.alias("b"), (F.count("*") - 1).alias("duplicate_logs")).select("session_id", "b.*", "duplicate_logs")


def is_record(line: Column) -> Column:
    """A line that starts with a brace and parses; a cut-off tail does not."""
    return line.startswith("{") & F.try_parse_json(line).isNotNull()


def records_of_lines(lines: DataFrame) -> DataFrame:
    """Keep the lines that are records."""
    return lines.where(is_record(F.col("line")))


def read_logs(owned: DataFrame, width: int = 64 << 20, open_cost: int = OPEN_COST) -> DataFrame:
    """Record lines of the given logs: source, session_id, kind, sidecar_name, seq, line.

    `owned` has a log per row: path, size and the owner columns. Logs are cut
    into ranges of `width` bytes and packed to tasks of like size; the pack list
    is a table that the tasks read, so the driver holds only pack numbers.
    """
    spark = owned.sparkSession
    ranges = owned.where("size > 0").select(
        *OWNER, "path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(width).cast("bigint"))).alias("start")
    ).withColumn("stop", F.least(F.col("start") + width, F.col("size"))).withColumn("cost", F.col("stop") - F.col("start") + open_cost)
    total = ranges.agg(F.count("*").alias("n"), F.sum("cost").alias("cost")).first()
    if not total["n"]:
        return spark.createDataFrame([], SCHEMA)
    room = min(width + open_cost, max(open_cost, total["cost"] // spark.sparkContext.defaultParallelism))
    groups = -(-total["n"] // 20_000)
    grouped = ranges.withColumn("group", F.pmod(F.xxhash64("path", "start"), F.lit(groups)).cast("int"))
    upto = W.partitionBy("group").orderBy("path", "start").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = grouped.withColumn("filled", F.floor((F.sum("cost").over(upto) - F.col("cost")) / room))
    packed = filled.withColumn("pack", F.dense_rank().over(W.partitionBy("group").orderBy("filled")) - 1)
    ensure_checkpoint_dir(spark)
    plan = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/ranges-{uuid.uuid4().hex}"
    packed.select(*OWNER, "path", "start", "stop", "pack", "group").write.partitionBy("group").parquet(plan)
    packs = {r["group"]: r["n"] for r in spark.read.parquet(plan).groupBy("group").agg((F.max("pack") + 1).alias("n")).collect()}
    spark.dataSource.register(LogSource)
    lines = spark.read.format(LogSource.name()).option("plan", plan).option("packs", json.dumps(packs)).load()
    return records_of_lines(lines)


def find_logs(files: DataFrame, root: str, source: str, flat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(log files, owned logs) of a listing.

    Log files: one row per session, with signature and counts of its sidecars
    and of the copies that were left out. Owned logs: a row per log to read,
    with the owner columns. `flat` is the layout without sidecars. Corpora of
    different sources are never mixed: every table carries `source`.
    """
    primary = primary_logs(files, root)
    if flat:
        logs = primary.withColumn("signature", F.concat(F.col("size"), F.lit(":"), F.col("mtime_ms"))).withColumns(
            {"advisor_logs": F.lit(0).cast("bigint"), "subagent_logs": F.lit(0).cast("bigint")}
        )
    else:
        side = sidecar_logs(files, root)
        logs = with_signatures(primary, side)
    kept = materialise(drop_duplicate_logs(logs).withColumn("source", F.lit(source)))
    owned = kept.select("source", "session_id", F.lit("primary").alias("kind"), F.lit("").alias("sidecar_name"), "path", "size")
    if not flat:
        own = side.join(kept.select("source", "project_dir", "base", "session_id"), ["project_dir", "base"])
        owned = owned.unionByName(own.select(*OWNER, "path", "size"))
    return kept, materialise(owned)


def read_corpus(spark: SparkSession, root: str, source: str, flat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(log files, records) of a log folder."""
    kept, owned = find_logs(list_files(spark, root), root, source, flat)
    return kept, read_logs(owned)


def scan_summary(logs: DataFrame, reasons: DataFrame) -> DataFrame:
    """Counts of logs and of each exclusion reason, as (measure, n).

    `reasons` has one row per session with `exclusion` (NULL when included).
    """
    counted = logs.agg(
        F.count("*").alias("primary_logs"),
        F.coalesce(F.sum("advisor_logs"), F.lit(0)).alias("advisor_logs"),
        F.coalesce(F.sum("subagent_logs"), F.lit(0)).alias("subagent_logs"),
    )
    wide = counted.select(
        F.explode(
            F.create_map(
                *[x for c in counted.columns for x in (F.lit(c), F.col(c).cast("bigint"))]
            )
        ).alias("measure", "n")
    )
    by_reason = reasons.groupBy(
        F.coalesce(F.concat(F.lit("excluded_"), F.col("exclusion")), F.lit("included")).alias("measure")
    ).agg(F.count("*").alias("n"))
    return wide.unionByName(by_reason)
