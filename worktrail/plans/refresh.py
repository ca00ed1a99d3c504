"""Rows of a refresh, audit rows and cost reconciliation; `store` builds on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.functions.numeric import exact_sum

SCHEMA_VERSION = 1
IDENTITY = ["session_id", "signature", "schema_version"]


def stale_logs(logs: DataFrame, previous: DataFrame, schema_version: int = SCHEMA_VERSION) -> DataFrame:
    """Logs whose session row is missing, of another signature or another schema."""
    now = logs.withColumn("schema_version", F.lit(schema_version))
    return now.join(previous.select(*IDENTITY), IDENTITY, "left_anti")


def still_valid(previous: DataFrame, logs: DataFrame, schema_version: int = SCHEMA_VERSION) -> DataFrame:
    """Previous session rows that need no new computation."""
    now = logs.select("session_id", "signature").withColumn("schema_version", F.lit(schema_version))
    return previous.join(now, IDENTITY, "left_semi")


def refreshed(previous: DataFrame, recomputed: DataFrame, logs: DataFrame, schema_version: int = SCHEMA_VERSION) -> DataFrame:
    """The new session table: valid rows plus recomputed ones."""
    fresh = recomputed.withColumn("schema_version", F.lit(schema_version))
    return still_valid(previous, logs, schema_version).unionByName(fresh, allowMissingColumns=True)


def manifest(sessions: DataFrame, logs: DataFrame, sidecars: DataFrame) -> DataFrame:
    """The exact session set behind a report, with paths and cost split.

    Sidecars are counted here; `build.manifest` lists them, one per row.
    """
    paths = sidecars.groupBy("session_id").agg(F.count("*").alias("sidecars"))
    cost = ["total_cost", "cost_primary", "cost_advisor", "cost_subagent"]
    return sessions.select("session_id", "start_ms", *cost).join(
        logs.select("session_id", "path", "signature"), "session_id", "left"
    ).join(paths, "session_id", "left").na.fill(0, ["sidecars"])


def reconcile(usage_events: DataFrame, sessions: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Re-sum raw cost by class and compare with the session rows.

    The raw side shares no operator with the session build. Rows: class,
    reported, recomputed, difference, matches.
    """
    raw = usage_events.groupBy(F.col("kind").alias("class")).agg(exact_sum(F.col("cost")).alias("recomputed"))
    cells = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"cost_{c}").alias("cost")) for c in ("primary", "advisor", "subagent")])
    reported = sessions.select(F.explode(cells).alias("x")).groupBy(F.col("x.class").alias("class")).agg(
        exact_sum(F.col("x.cost")).alias("reported")
    )
    both = reported.join(raw, "class", "full_outer").na.fill(0.0, ["reported", "recomputed"])
    diff = F.abs(F.col("reported") - F.col("recomputed"))
    return both.withColumn("difference", diff).withColumn("matches", F.col("difference") < tolerance)


def changed_sizes(manifest_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Logs whose current size is not the one in the manifest's signature."""
    recorded = F.split(F.col("signature"), ":")[0].cast("bigint")
    return manifest_rows.select("session_id", "path", recorded.alias("recorded_size")).join(
        files.select("path", "size"), "path", "left"
    ).where(~F.col("recorded_size").eqNullSafe(F.col("size")))
