"""Pairing of starts, calls and results by call id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.functions.labels import LABELS, TOOL_FAILURES
from worktrail.functions.text import display_label, lookup, trimmed
from worktrail.operators.scan import SEQ_CHUNK, by_width, ordered_scan

CALL = ["session_id", "call_id"]


def timed_calls(starts: DataFrame, results: DataFrame) -> DataFrame:
    """Each start with the first result after it, before any newer start.

    Rows: session_id, call_id, tool (the start's), seq (the result's),
    started_ms, ts_ms, duration_sec. A start without a result gives no row; a
    result uses up its start.
    """
    a = starts.where("call_id <> '' and tool <> '' and started_ms is not null").select(
        *CALL, "seq", F.struct("tool", "started_ms").alias("s"), F.lit(None).cast("bigint").alias("ts_ms")
    )
    b = results.where("call_id <> ''").select(
        *CALL, "seq", F.lit(None).cast("struct<tool:string,started_ms:bigint>").alias("s"), "ts_ms"
    )
    # A result pairs if the row right before it (same id) is a start.
    prior = F.struct(F.col("s").alias("s"))
    rows = ordered_scan(
        a.unionByName(b), CALL, ["seq"], by_width("seq", SEQ_CHUNK), last={"p": prior}
    )
    return rows.where("s is null and p.s is not null and ts_ms is not null").select(
        *CALL, F.col("p.s.tool").alias("tool"), "seq", F.col("p.s.started_ms").alias("started_ms"), "ts_ms",
        F.greatest(F.lit(0.0), (F.col("ts_ms") - F.col("p.s.started_ms")) / 1000.0).alias("duration_sec"),
    )


def first_calls(calls: DataFrame) -> DataFrame:
    """The first call of each id; repeats of an id (branches, replays) drop out."""
    names = [c for c in calls.columns if c not in CALL]
    order = F.struct("seq", "idx")
    return calls.groupBy(*CALL).agg(F.min_by(F.struct(*names), order).alias("b")).select(*CALL, "b.*")


def tool_failure(tool):
    """Category of a failed call of `tool`."""
    server = F.regexp_extract(tool, r"^mcp__([^_]*)", 1)
    return (
        F.when(tool == "", "Unknown Tool")
        .when(tool.startswith("mcp__"), F.concat(F.lit("MCP: "), server))
        .otherwise(F.coalesce(lookup(tool, TOOL_FAILURES), F.concat(display_label(tool, LABELS), F.lit(" Failed"))))
    )


def call_outcomes(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One outcome per call id, the last result wins; id-less results all count.

    A result whose id no earlier call carries is dropped. Rows: session_id,
    rate_key, outcome (ok, error, not_found), category.
    `calls` needs whether each call drives a browser; the first call of an id says it.
    """
    per_call = calls.groupBy(*CALL).agg(
        F.min("seq").alias("call_seq"), F.min_by("drives_browser", F.struct("seq", "idx")).alias("drives_browser")
    )
    body = ["seq", "tool", "is_error", "text"]
    # Results before the call do not count, so the call's seq joins first.
    known = (
        results.where("call_id <> ''")
        .join(per_call, CALL)
        .where("call_seq < seq")
        .groupBy(*CALL)
        .agg(F.max_by(F.struct(*body, "drives_browser"), F.col("seq")).alias("b"))
        .select("session_id", "b.*")
    )
    free = results.where("call_id = ''").select("session_id", *body, F.lit(False).alias("drives_browser"))
    return classify_outcomes(known.unionByName(free))


def classify_outcomes(rows: DataFrame) -> DataFrame:
    tool = F.trim("tool")
    key = F.when((tool == "eval") & F.col("drives_browser"), "browser").otherwise(
        F.when(tool == "", "unknown").otherwise(tool)
    )
    missing = F.regexp_extract(trimmed(F.col("text")), r"^Tool (\S+) not found", 1)
    not_found = F.col("is_error") & (missing != "")
    return rows.select(
        "session_id",
        F.when(not_found, missing).otherwise(key).alias("rate_key"),
        F.when(~F.col("is_error"), "ok").when(not_found, "not_found").otherwise("error").alias("outcome"),
        F.when(
            F.col("is_error") & ~not_found,
            tool_failure(F.when(key == "browser", F.lit("browser")).otherwise(F.col("tool"))),
        ).alias("category"),
    )


def tool_outcomes(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, errors and invented-name misses per tool; misses leave the rate alone."""
    return outcomes.groupBy(*keys, F.col("rate_key").alias("tool")).agg(
        F.count_if(F.col("outcome") != "not_found").alias("calls"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("outcome") == "not_found").alias("not_found"),
    )


PROVISIONAL = r"(?i)\bBackgrounded as job (bg_\d+)"  # fixed value: notice of a moved call


def delivered_calls(starts: DataFrame, results: DataFrame) -> DataFrame:
    """The final delivery of each started call.

    A result with the background notice keeps the start open, and the next
    result of the id replaces it; the first result without it closes the call.
    Rows: session_id, call_id, tool, started_ms, ts_ms, seq, text, job_id.
    """
    a = starts.where("call_id <> '' and tool <> '' and started_ms is not null").select(
        *CALL, "seq", F.struct("tool", "started_ms", "seq").alias("s"),
        F.lit(None).cast("bigint").alias("ts_ms"), F.lit("").alias("text"),
    )
    b = results.where("call_id <> '' and ts_ms is not null").select(
        *CALL, "seq", F.lit(None).cast("struct<tool:string,started_ms:bigint,seq:bigint>").alias("s"), "ts_ms", "text"
    )
    rows = a.unionByName(b).withColumn("job_id", F.regexp_extract("text", PROVISIONAL, 1))
    closing = F.when(F.col("s").isNull() & (F.col("job_id") == ""), F.col("seq"))
    seen = ordered_scan(
        rows, CALL, ["seq"], by_width("seq", SEQ_CHUNK), last={"p": F.col("s"), "closed": closing}
    )
    is_open = F.col("closed").isNull() | (F.col("closed") < F.col("p.seq"))
    live = seen.where("s is null and p is not null").where(is_open)
    body = F.struct("p.tool", "p.started_ms", "ts_ms", "seq", "text", "job_id")
    return (
        live.groupBy(*CALL, F.col("p.seq").alias("start_seq"))
        .agg(
            F.max_by(body, F.col("seq")).alias("b"),
            F.max(F.when(F.col("job_id") != "", F.col("job_id"))).alias("moved_to"),
        )
        .select(*CALL, "b.*", "moved_to")
    )
