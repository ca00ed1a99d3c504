"""Tool counts, languages, edits, failures and durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.functions.labels import ERROR_CLASSES, LANGUAGES
from worktrail.functions.numeric import exact_sum, percentiles, ratio
from worktrail.functions.text import lookup
from worktrail.operators.usage import top_rows

DEVICE = "xd://"  # fixed value: a write to this scheme is a call of the device


def tool_name(tool: Column, path: Column) -> Column:
    """Tool as counted: a write to a device counts as the device."""
    device = F.regexp_extract(path, r"^xd://([^/?:]*)", 1)
    return F.when((tool == "write") & (device != ""), F.concat(F.lit(DEVICE), device)).otherwise(tool)


def tool_counts(calls: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Calls per tool; `calls` is already one row per call id."""
    counted = tool_name(F.col("tool"), F.coalesce("path", F.lit("")))
    return calls.groupBy(*keys, counted.alias("tool")).agg(F.count("*").alias("n"))


def tool_flags(counts: DataFrame) -> DataFrame:
    """Whether a session used subagents or remote tool servers."""
    return counts.groupBy("session_id").agg(
        F.max(F.col("tool") == "task").alias("uses_subagent"),
        F.max(F.col("tool").rlike(r"^(?:xd://)?mcp__")).alias("uses_mcp"),
    )


def language_of(path: Column) -> Column:
    """Language by file extension, NULL if unknown."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1))
    return lookup(ext, LANGUAGES)


def without_selector(path: Column) -> Column:
    """Path without a trailing line selector such as :10-20."""
    return F.regexp_replace(path, r":[^/\\]*$", "")


SECTION = r"^\[([^\]]+)#[0-9A-Fa-f]{4}\]$"  # fixed values: shapes of a patch line
RANGE = r"^(?:PUT|CUT)\s+(\d+)\.=(\d+)"


def patch_lines(calls: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """One row per line of each edit patch: section path, lines added, removed."""
    rows = calls.where("tool = 'edit'").select(
        *keys, F.explode(F.split(F.coalesce("input", F.lit("")), "\n")).alias("line")
    )
    line = F.col("line")
    section = F.regexp_extract(line, SECTION, 1)
    low, high = F.regexp_extract(line, RANGE, 1), F.regexp_extract(line, RANGE, 2)
    removed = (
        F.when(section != "", 0)
        .when(low != "", high.try_cast("bigint") - low.try_cast("bigint") + 1)
        .when(line.startswith("-") & ~line.startswith("---"), 1)
        .otherwise(0)
    )
    added = F.when((section == "") & (low == "") & line.startswith("+"), 1).otherwise(0)
    return rows.select(
        *keys, F.when(section != "", section).alias("path"),
        added.cast("bigint").alias("added"), removed.cast("bigint").alias("removed"),
    )


def edit_rows(calls: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Edits as rows of (path or NULL, added, removed) from writes and patches."""
    path = F.coalesce("path", F.lit(""))
    plain = calls.where((F.col("tool") == "write") & (path != "") & ~path.rlike(r"^xd://[^/?:]"))
    newlines = F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n")))
    writes = plain.select(
        *keys, path.alias("path"),
        (F.coalesce(newlines, F.lit(0)) + 1).cast("bigint").alias("added"), F.lit(0).cast("bigint").alias("removed"),
    )
    return writes.unionByName(patch_lines(calls, keys))


def edits_by_file(rows: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    return rows.where("path is not null").groupBy(*keys, "path").agg(F.count("*").alias("edits"))


def edit_totals(rows: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Lines added and removed, distinct files."""
    per_file = rows.groupBy(*keys, "path").agg(F.sum("added").alias("a"), F.sum("removed").alias("r"))
    return per_file.groupBy(*keys).agg(
        F.sum("a").alias("lines_added"), F.sum("r").alias("lines_removed"), F.count("path").alias("files_modified")
    )


def language_counts(calls: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    direct = calls.where(F.col("tool").isin("read", "write")).where(
        ~((F.col("tool") == "write") & F.coalesce("path", F.lit("")).rlike(r"^xd://[^/?:]"))
    ).select(*keys, language_of(without_selector(F.coalesce("path", F.lit("")))).alias("language"))
    patched = patch_lines(calls, keys).where("path is not null").select(*keys, language_of(F.col("path")).alias("language"))
    return direct.unionByName(patched).where("language is not null").groupBy(*keys, "language").agg(F.count("*").alias("n"))


def git_counts(calls: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    return calls.where("tool = 'bash'").groupBy(*keys).agg(
        F.count_if(F.col("command").contains("git commit")).alias("git_commits"),
        F.count_if(F.col("command").contains("git push")).alias("git_pushes"),
    )


def error_class(text: Column) -> Column:
    chain = F
    for name, pattern in ERROR_CLASSES:
        chain = chain.when(text.rlike("(?i)" + pattern), name)
    return chain.otherwise("other")


def failure_classes(messages: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Failed generations per class, every class present with zeros."""
    said = F.when(F.coalesce("error_message", F.lit("")) != "", F.col("error_message")).otherwise(F.col("text"))
    failed = messages.where("role = 'assistant'").select(
        *keys, F.when(F.col("stop_reason") == "error", error_class(said)).alias("c")
    )
    names = [name for name, _ in ERROR_CLASSES] + ["other"]
    wide = failed.groupBy(*keys).agg(*[F.count_if(F.col("c") == n).alias(n) for n in names])
    return wide.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(n).alias("class"), F.col(n).alias("n")) for n in names])).alias("x"),
    ).select(*keys, "x.class", "x.n")


def tool_durations(timed: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Calls, total, p50, p90 and share of tool time per tool."""
    keys = list(keys)
    sums = timed.groupBy(*keys, "tool").agg(
        F.count("*").alias("calls"), exact_sum(F.col("duration_sec")).alias("total_sec")
    )
    ranks = percentiles(timed, [*keys, "tool"], "duration_sec", {"p50_sec": 50, "p90_sec": 90})
    whole = sums.groupBy(*keys).agg(exact_sum(F.col("total_sec")).alias("_whole"))
    return (
        sums.join(ranks, [*keys, "tool"])
        .join(whole, keys)
        .withColumn("share", ratio(F.col("total_sec"), F.col("_whole")))
        .drop("_whole")
    )


def top_files(edits: DataFrame, k: int = 20) -> DataFrame:
    return top_rows(edits, ["session_id"], [F.desc("edits"), F.asc("path")], k)


def marker_counts(markers: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    count = lambda m: F.count_if(F.col("marker") == m)
    return markers.groupBy(*keys).agg(
        count("thinking_level_change").alias("thinking_escalations"),
        count("model_change").alias("model_switches"), count("compaction").alias("compactions"),
        count("ttsr_injection").alias("injections"), count("reset_boundary").alias("reset_boundaries"),
    )


def rule_counts(markers: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    return (
        markers.where("marker = 'ttsr_injection'").select(*keys, F.explode("rules").alias("rule"))
        .where("rule <> ''").groupBy(*keys, "rule").agg(F.count("*").alias("n"))
    )
