"""Corpus rollup of session time and the levers it suggests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from worktrail.functions.numeric import exact_sum, ratio
from worktrail.functions.waits import is_heavy_model
from worktrail.operators.timesplit import ACTIVE, BUCKETS
from worktrail.operators.usage import top_rows, with_row

UNRECOGNISED = ["polling: generic", "polling: polling"]  # fixed values: polling of unknown target

# Families that are no command one could speed up.
NOT_ACTIONABLE = [
    "wait", "ask", "task", "eval", "polling: generic", "polling: polling", "read", "grep", "edit",
    "write", "glob", "search", "find", "lsp",
]


def elsewhere_seconds(session_time: DataFrame, elsewhere_gaps: DataFrame) -> DataFrame:
    """Move waiting time to `elsewhere`, at most the session's own waiting time."""
    moved = elsewhere_gaps.groupBy("session_id").agg((F.sum(F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("_moved"))
    amount = F.least(F.coalesce("_moved", F.lit(0.0)), F.col("you"))
    return (
        session_time.join(moved, "session_id", "left")
        .withColumn("elsewhere", amount)
        .withColumn("you", F.col("you") - F.col("elsewhere"))
        .drop("_moved")
    )


def time_rollup(session_time: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, bucket, seconds, share): shares of active time; idle over active + idle.

    Input has one column per bucket, `elsewhere` already moved.
    """
    sums = session_time.groupBy(*by).agg(*[exact_sum(F.col(b)).alias(b) for b in BUCKETS], F.count("*").alias("sessions"))
    active = sum((F.col(b) for b in ACTIVE), F.lit(0.0))
    rows = sums.withColumn("active_sec", active)
    cells = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("seconds")) for b in BUCKETS])
    long = rows.select(*by, "sessions", "active_sec", F.col("idle").alias("_idle"), F.explode(cells).alias("x")).select(
        *by, "sessions", "active_sec", "_idle", "x.bucket", "x.seconds"
    )
    whole = F.when(F.col("bucket") == "idle", F.col("active_sec") + F.col("_idle")).otherwise(F.col("active_sec"))
    return long.withColumn("share", ratio(F.col("seconds"), whole)).drop("_idle")


def wide_rollup(rollup: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per `by`: seconds and share of each bucket."""
    cell = lambda b, c: F.max(F.when(F.col("bucket") == b, F.col(c)))
    return rollup.groupBy(*by).agg(
        F.max("active_sec").alias("active_sec"), F.max("sessions").alias("sessions"),
        *[cell(b, "seconds").alias(b) for b in BUCKETS], *[cell(b, "share").alias(f"{b}_share") for b in BUCKETS],
    )


def is_actionable(family: Column) -> Column:
    return ~family.isin(*NOT_ACTIONABLE) & ~family.rlike(r"^eval: (?:python|js)")


def levers(
    rollup: DataFrame, families: DataFrame, model_cost: DataFrame, subagent_busy: DataFrame, by: Sequence[str]
) -> DataFrame:
    """(by, lever, subject, seconds, share) of the rules that hold.

    families: by, family, busy_sec. model_cost: by, model, cost.
    subagent_busy: by, busy_sec. All are one row per corpus or per corpus and
    name, so the joins are small against the logs.
    """
    by = list(by)
    wide = wide_rollup(rollup, by)
    top = families.where(is_actionable(F.col("family"))).groupBy(*by).agg(
        F.min_by(F.struct("family", "busy_sec"), F.struct((-F.col("busy_sec")).alias("s"), F.col("family"))).alias("f")
    )
    costly = model_cost.groupBy(*by).agg(F.min_by("model", F.struct((-F.col("cost")).alias("c"), F.col("model"))).alias("model"))
    # `model` is both a bucket and the costliest model's name; tell them apart.
    r = wide.withColumnRenamed("model", "model_sec").join(top, by, "left").join(
        costly.withColumnRenamed("model", "model_name"), by, "left"
    ).join(subagent_busy.select(*by, F.col("busy_sec").alias("subagent_sec")), by, "left").na.fill(0.0, ["subagent_sec"])
    largest = F.greatest(*[F.col("model_sec" if b == "model" else b) for b in ACTIVE])
    rules = [
        ("command_family", (F.col("tools") > 0) & (F.col("f.busy_sec") / F.col("tools") > 0.2), F.col("f.family"),
         F.col("f.busy_sec"), ratio(F.col("f.busy_sec"), F.col("active_sec"))),
        ("waiting_on_you", F.col("you_share") > 0.3, F.lit(None), F.col("you"), F.col("you_share")),
        ("slow_model", (F.col("model_sec") > 0) & (F.col("model_sec") == largest) & is_heavy_model(F.col("model_name")),
         F.col("model_name"), F.col("model_sec"), F.col("model_share")),
        ("serial_agent_waits", (F.col("agents_share") > 0.2) & (F.col("subagent_sec") < F.col("agents") * 1.2), F.lit(None),
         F.col("agents"), F.col("agents_share")),
        ("review_waits", F.col("review_share") > 0.15, F.lit(None), F.col("review"), F.col("review_share")),
    ]
    cells = F.array(*[
        F.when(test, F.struct(F.lit(n).alias("lever"), s.cast("string").alias("subject"), v.alias("seconds"), sh.alias("share")))
        for n, test, s, v, sh in rules
    ])
    return r.select(*by, F.explode(F.array_compact(cells)).alias("x")).select(*by, "x.*")


def ranked_levers(found: DataFrame, slowest: DataFrame, by: Sequence[str]) -> DataFrame:
    """Levers by share, largest first; the slowest request comes last.

    slowest: by, session_id, active_sec, dominant, rank (1 is the slowest).
    """
    last = slowest.where("rank = 1").select(
        *by, F.lit("slowest_requests").alias("lever"), F.col("session_id").alias("subject"), F.col("active_sec").alias("seconds"), F.lit(None).cast("double").alias("share"),
    )
    order = W.partitionBy(*by).orderBy(F.desc_nulls_last("share"), "lever")
    return found.unionByName(last).withColumn("place", F.row_number().over(order))


# Which session figure backs a lever.
EVIDENCE = {"waiting_on_you": "you", "slow_model": "model", "serial_agent_waits": "agents", "review_waits": "review"}


def lever_evidence(found: DataFrame, session_time: DataFrame, session_families: DataFrame, by: Sequence[str], k: int = 3) -> DataFrame:
    """Up to three sessions behind each lever, most seconds first."""
    by = list(by)
    cells = F.array(*[F.struct(F.lit(n).alias("lever"), F.col(c).alias("value")) for n, c in EVIDENCE.items()])
    plain = session_time.select(*by, "session_id", F.explode(cells).alias("x")).select(*by, "session_id", "x.lever", "x.value")
    plain = plain.where("value > 0").join(found.select(*by, "lever"), [*by, "lever"], "left_semi")
    family = session_families.join(
        found.where("lever = 'command_family'").select(*by, F.col("subject").alias("family")), [*by, "family"], "left_semi"
    ).select(*by, "session_id", F.lit("command_family").alias("lever"), F.col("busy_sec").alias("value")).where("value > 0")
    return top_rows(plain.unionByName(family), [*by, "lever"], [F.desc("value"), F.asc("session_id")], k)


def unrecognised_waiting(families: DataFrame, rollup: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Seconds in polling loops of unknown target and their share of tool time."""
    keys = list(by)
    unknown = F.col("family").isin(*UNRECOGNISED)
    sec = families.groupBy(*keys).agg(exact_sum(F.when(unknown, F.col("busy_sec"))).alias("unrecognised_sec"))
    tools = rollup.where("bucket = 'tools'").select(*keys, F.col("seconds").alias("tools_sec"))
    joined = sec.join(tools, keys, "left") if keys else with_row(sec, tools)
    return joined.withColumn("share", ratio(F.col("unrecognised_sec"), F.coalesce("tools_sec", F.lit(0.0))))
