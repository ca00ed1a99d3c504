"""Corpus totals, pooled percentiles and top lists over session rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.functions.numeric import exact_sum, medians, percentiles, ratio, select_ranks
from worktrail.functions.text import last_segment
from worktrail.operators.usage import cache_hit_ratio, top_rows, with_row


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(1)), ["_all"])


def merged_counts(rows: DataFrame, key: str, by: Sequence[str] = (), n: str = "n") -> DataFrame:
    """Key-wise sum of long count rows (a map merge)."""
    return rows.groupBy(*by, key).agg(F.sum(n).alias(n))


def top_keys(counts: DataFrame, key: str, by: Sequence[str] = (), n: str = "n", k: int = 8) -> DataFrame:
    return top_rows(counts, by, [F.desc(n), F.asc(key)], k)


SUMMED = [
    "user_message_count", "input_tokens", "output_tokens", "git_commits", "git_pushes", "tool_errors", "lines_added",
    "lines_removed", "files_modified", "cache_read_tokens", "cache_write_tokens", "thinking_escalations", "model_switches",
    "compactions", "steering_messages", "tool_calls_with_intent", "error_generations", "aborted_generations",
    "aborted_at_session_end", "injections", "reset_boundaries", "turn_count", "advisor_logs", "subagent_logs",
]
MONEY = ["total_cost", "cost_primary", "cost_advisor", "cost_subagent", "utility_cost"]
FLAGS = ["uses_subagent", "uses_mcp"]


def corpus_totals(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All sums and flag counts in one aggregate, over the columns present."""
    have = set(sessions.columns)
    aggs = [F.count("*").alias("sessions")]
    aggs += [F.sum(c).alias(c) for c in SUMMED if c in have]
    aggs += [exact_sum(F.col(c)).alias(c) for c in MONEY if c in have]
    aggs += [F.count_if(c).alias(f"sessions_{c}") for c in FLAGS if c in have]
    if {"advisor_logs", "subagent_logs"} <= have:
        aggs.append(F.count_if(F.col("advisor_logs") + F.col("subagent_logs") > 0).alias("sessions_with_sidecars"))
    return sessions.groupBy(*by).agg(*aggs)


def interruption_rate(totals: DataFrame) -> DataFrame:
    """Aborts inside sessions plus steering, per human message."""
    aborted = F.col("aborted_generations") - F.col("aborted_at_session_end")
    total = aborted + F.col("steering_messages")
    return totals.withColumn("interruptions_aborted", aborted).withColumn("interruptions", total).withColumn(
        "interruption_rate", ratio(total, F.col("user_message_count"))
    )


def pooled_percentiles(
    rows: DataFrame, key: str, weight: str, by: Sequence[str] = (), names: Sequence[str] = ("p50", "p90")
) -> DataFrame:
    """Weighted median of per-session percentiles per `key` (metric or tool).

    An approximation of the percentile over all values; `exact_percentiles`
    gives the true one from the long table.
    """
    out = None
    for name in names:
        part = select_ranks(
            rows.where(F.col(weight) > 0), [*by, key], name, {name: lambda t: t * F.lit(0.5)}, weight=F.col(weight)
        )
        out = part if out is None else out.join(part, [*by, key])
    return out


def exact_percentiles(values: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    return percentiles(values, [*by, key], value, {"p50": 50, "p90": 90})


def pooled_tool_durations(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls, seconds, pooled p50 and p90, and share of tool time per tool.

    Rows: one per session and tool with calls, total_sec, p50_sec, p90_sec.
    """
    sums = rows.groupBy(*by, "tool").agg(F.sum("calls").alias("calls"), exact_sum(F.col("total_sec")).alias("total_sec"))
    pooled = pooled_percentiles(rows, "tool", "calls", by, ("p50_sec", "p90_sec"))
    if by:
        whole = sums.groupBy(*by).agg(exact_sum(F.col("total_sec")).alias("_whole"))
        withed = sums.join(whole, list(by))
    else:
        withed = with_row(sums, sums.agg(exact_sum(F.col("total_sec")).alias("_whole")))
    return withed.join(pooled, [*by, "tool"]).withColumn("share", ratio(F.col("total_sec"), F.col("_whole"))).drop("_whole")


def error_rates(outcomes: DataFrame, minimum: int = 5) -> DataFrame:
    """Tools with enough calls and their failure rate."""
    return outcomes.where(F.col("calls") >= minimum).withColumn("rate", ratio(F.col("errors"), F.col("calls")))


def worst_turns(turns: DataFrame, by: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Turns with most tool calls over analysis sessions."""
    return top_rows(
        turns.where("is_analysis"), by, [F.desc("tool_calls"), F.asc("session_id"), F.asc("turn_no")], k
    )


def worst_cache_sessions(sessions: DataFrame, by: Sequence[str] = (), minimum: int = 50_000, k: int = 5) -> DataFrame:
    tokens = F.col("input_tokens") + F.col("cache_read_tokens")
    rows = sessions.where("is_analysis").withColumn("tokens", tokens).withColumn(
        "ratio", cache_hit_ratio(F.col("cache_read_tokens"), F.col("input_tokens"))
    )
    return top_rows(rows.where(F.col("tokens") >= minimum), by, [F.asc("ratio"), F.asc("session_id")], k)


def churned_files(edits: DataFrame, by: Sequence[str] = (), k: int = 10) -> DataFrame:
    """Edits and distinct sessions per path."""
    per_session = edits.groupBy(*by, "path", "session_id").agg(F.sum("edits").alias("edits"))
    per_path = per_session.groupBy(*by, "path").agg(F.sum("edits").alias("edits"), F.count("*").alias("sessions"))
    return top_rows(per_path, by, [F.desc("edits"), F.asc("path")], k)


def calendar(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and last day, active days (UTC). Days collapse before the count."""
    day = F.to_date(F.timestamp_millis("start_ms"))
    days = sessions.groupBy(*by, day.alias("day")).agg(F.count("*").alias("n"))
    return days.groupBy(*by).agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count("*").alias("days_active"), F.sum("n").alias("sessions"),
    )


def project_counts(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    named = sessions.where("project_path <> ''")
    return named.groupBy(*by, last_segment(F.col("project_path")).alias("project")).agg(F.count("*").alias("sessions"))


def response_medians(
    replies: DataFrame, session_ttft: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Median and mean reply time; median of the positive per-session medians."""
    r, keys = _keyed(replies, by)
    t, _ = _keyed(session_ttft.where("median_ttft_ms > 0"), by)
    mid = medians(r, keys, "reply_sec", "median_reply_sec")
    mean = r.groupBy(*keys).agg((exact_sum(F.col("reply_sec")) / F.count("*")).alias("avg_reply_sec"))
    first = medians(t, keys, "median_ttft_ms", "median_ttft_ms")
    out = mid.join(mean, keys).join(first, keys, "left")
    return out if by else out.drop("_all")


def cost_shares(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c.removeprefix("cost_")).alias("class"), F.col(c).alias("cost")) for c in MONEY[1:4]])
    return totals.select(*by, "total_cost", F.explode(cells).alias("x")).select(
        *by, "x.class", "x.cost", ratio(F.col("x.cost"), F.col("total_cost")).alias("share")
    )
