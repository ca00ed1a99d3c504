"""Spark session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package is written for. Shuffle partition counts
# are left to the cluster (AQE coalesces); only semantics-bearing options and
# adaptive execution are fixed here.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
WHOLE_STAGE = "spark.sql.codegen.wholeStage"


def build_session(app_name: str = "worktrail", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the required settings; `master` only for local runs."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """Local session for tests and the bench."""
    spark = build_session(
        "worktrail-local",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": memory,
            "spark.ui.enabled": "false",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
            "spark.local.dir": os.environ.get("SPARK_LOCAL_DIRS", "/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir.

    Only a local session without the setting gets a temporary folder; on a
    cluster a missing setting is an error, as no local folder is shared.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)


def spread(spark: SparkSession) -> int:
    """Partitions for rows whose cost is not their bytes, such as one file each.

    Adaptive execution would put very many of them into one task.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def materialise(df: DataFrame, *, wide: bool = False) -> DataFrame:
    """Write `df` as Parquet into the checkpoint folder and read it back.

    For results that a plan reads more than once: without it each reader would
    run the whole plan below again, doubling at every further scan. Readers
    prune columns and see real sizes, and no executor's loss replays the plan.

    `wide` is for very many expressions on one row. Whole-stage code would put
    them all into one method, too long for the JVM to compile; by operator they
    are split into methods of their own.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(WHOLE_STAGE)
    if wide:
        spark.conf.set(WHOLE_STAGE, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(WHOLE_STAGE, before)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run in Python workers are sent by module name, so workers
    need the package whatever folder they were started in.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-")
    tree = shutil.copytree(package, os.path.join(folder, "tree", os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "worktrail"), "zip", os.path.dirname(tree)))
    _shipped.add(context.applicationId)
