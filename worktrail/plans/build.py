"""From log lines to session tables to corpus tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.functions.numeric import exact_sum, medians
from worktrail.functions.text import trimmed
from worktrail.operators import activity, corpus, facts, filters, forks, labels, pairing, timerollup, timesplit, tools, trends, turns, usage
from worktrail.session import materialise, ship_package
from worktrail.sources import dialect_a, dialect_b, logs
from worktrail.sources.dialect_a import LogTables


class LogDialect(Protocol):
    """A log format: how to parse record lines, and the typed tables of the records.

    `flat`: one log per session, no sidecars; idle time may then dominate a
    request, and the slowest requests are those of longest wall time.
    """

    name: str
    flat: bool

    def parse(self, lines: DataFrame) -> DataFrame:
        """A record per line, with session_id, seq and whatever `tables` reads."""

    def tables(self, records: DataFrame) -> LogTables: ...

    def busy_calls(self, tables: LogTables) -> DataFrame:
        """Calls and jobs with interval, bucket, busy seconds and command family."""

    def edit_rows(self, calls: DataFrame) -> DataFrame: ...

    def language_counts(self, calls: DataFrame) -> DataFrame: ...

    def git_counts(self, calls: DataFrame) -> DataFrame: ...

    def tool_flags(self, counts: DataFrame, tables: LogTables) -> DataFrame: ...

    def recorded_totals(self, tables: LogTables) -> DataFrame | None:
        """session_id, cost_recorded, state_added, state_removed where logs keep totals."""


@dataclass(frozen=True)
class DialectA:
    name: str = "a"
    flat: bool = False

    def parse(self, lines: DataFrame) -> DataFrame:
        return dialect_a.parse_records(lines).drop("line")

    def tables(self, records: DataFrame) -> LogTables:
        return dialect_a.tables_of(records)

    def busy_calls(self, tables: LogTables) -> DataFrame:
        calls = primary(tables.tool_calls)
        results = primary(tables.messages).where("role = 'toolResult'")
        timed = timesplit.tool_intervals(primary(tables.tool_starts), results, calls)
        return timesplit.effective_calls(timed, timesplit.job_intervals(primary(tables.async_jobs), timed, calls))

    def edit_rows(self, calls: DataFrame) -> DataFrame:
        return tools.edit_rows(calls)

    def language_counts(self, calls: DataFrame) -> DataFrame:
        return tools.language_counts(calls)

    def git_counts(self, calls: DataFrame) -> DataFrame:
        return tools.git_counts(calls)

    def tool_flags(self, counts: DataFrame, tables: LogTables) -> DataFrame:
        return tools.tool_flags(counts)

    def recorded_totals(self, tables: LogTables) -> None:
        return None


@dataclass(frozen=True)
class DialectB:
    name: str = "b"
    flat: bool = True

    def parse(self, lines: DataFrame) -> DataFrame:
        return dialect_b.parse_records(lines).drop("line")

    def tables(self, records: DataFrame) -> LogTables:
        return dialect_b.tables_of(records, self.name)

    def busy_calls(self, tables: LogTables) -> DataFrame:
        calls = tables.tool_calls.select("session_id", "call_id", "seq", "ts_ms", "tool", F.col("arguments").alias("input"))
        results = tables.messages.where("role = 'toolResult'").select("session_id", "call_id", "seq", "ts_ms")
        return timesplit.flat_call_intervals(calls, results)

    def edit_rows(self, calls: DataFrame) -> DataFrame:
        return dialect_b.edit_rows(calls)

    def language_counts(self, calls: DataFrame) -> DataFrame:
        return dialect_b.language_counts(calls)

    def git_counts(self, calls: DataFrame) -> DataFrame:
        return dialect_b.git_counts(calls)

    def tool_flags(self, counts: DataFrame, tables: LogTables) -> DataFrame:
        return dialect_b.tool_flags(counts, tables.header)

    def recorded_totals(self, tables: LogTables) -> DataFrame:
        return dialect_b.recorded_totals(tables)


def build_tables(spark: SparkSession, root: str, dialect: LogDialect | None = None) -> tuple[DataFrame, LogTables]:
    """(log files, typed tables) of a folder, without fork copies.

    Sessions whose ids name no safe file, and those a report wrote about
    itself, stay in the files with a `dropped` reason and leave the tables.
    """
    return tables_of_records(*parsed_logs(spark, root, dialect), dialect)


def parsed_logs(spark: SparkSession, root: str, dialect: LogDialect | None = None) -> tuple[DataFrame, DataFrame]:
    """(log files, records) of a folder, both stored: the logs are not opened again."""
    dialect = dialect or DialectA()
    ship_package(spark)
    files, lines = logs.read_corpus(spark, root, dialect.name, dialect.flat)
    # Each line is parsed once, forks or not.
    return files, materialise(dialect.parse(lines))


def tables_of_records(files: DataFrame, records: DataFrame, dialect: LogDialect | None = None) -> tuple[DataFrame, LogTables]:
    """`build_tables` of stored records, of one folder or of several that share no session."""
    dialect = dialect or DialectA()
    first = dialect.tables(records)
    # Markers stand in a session's first messages, which a fork may have copied.
    marked = mark_dropped(files, first)
    trees = None if dialect.flat else fork_trees(forks.parent_links(first.header.where("kind = 'primary'"), files))
    return marked, without_dropped(marked, dialect.tables(without_copies(records, trees)))


def fork_trees(links: DataFrame) -> DataFrame | None:
    """Labels of the fork trees; None without forks."""
    links = materialise(links)
    return None if links.isEmpty() else materialise(forks.fork_trees(links))


def without_copies(records: DataFrame, trees: DataFrame | None) -> DataFrame:
    """Records without those that forks copied from an ancestor."""
    if trees is None:
        return records
    ids = records.select("session_id", "sidecar_name", "seq", F.col("r.id").alias("rec_id")).join(trees.select("session_id"), "session_id", "left_semi")
    ids = materialise(ids)
    drop = ids.join(forks.copied_records(ids, trees), ["session_id", "sidecar_name", "rec_id"], "left_semi").select("session_id", "sidecar_name", "seq")
    return materialise(records.join(drop, ["session_id", "sidecar_name", "seq"], "left_anti"))


def mark_dropped(files: DataFrame, tables: LogTables) -> DataFrame:
    """Log files with `dropped`: unparsed, tooling or NULL."""
    heads = primary(tables.header).select("session_id", F.col("record_session_id").alias("_record_id"), F.lit(True).alias("_read"))
    own = filters.self_generated(primary(tables.messages)).withColumn("_own", F.lit(True))
    reason = F.when(
        F.col("_read").isNull() | filters.safe_session_id(F.col("_record_id"), F.col("session_id")).isNull(), "unparsed"
    ).when(F.col("_own"), "tooling")
    joined = files.join(heads, "session_id", "left").join(own, "session_id", "left")
    return materialise(joined.withColumn("dropped", reason).drop("_record_id", "_read", "_own"))


def without_dropped(files: DataFrame, tables: LogTables) -> LogTables:
    gone = files.where("dropped is not null").select("session_id")
    return replace(tables, **{f.name: getattr(tables, f.name).join(gone, "session_id", "left_anti") for f in fields(tables)})


def primary(df: DataFrame) -> DataFrame:
    return df.where("kind = 'primary'")


def session_tables(files: DataFrame, tables: LogTables, dialect: LogDialect | None = None) -> dict[str, DataFrame]:
    """Every per-session table, keyed by name. All are lazy but the shared ones."""
    dialect = dialect or DialectA()
    msg, calls = primary(tables.messages), pairing.first_calls(primary(tables.tool_calls))
    results, starts = msg.where("role = 'toolResult'"), primary(tables.tool_starts)
    humans = msg.where("is_human")

    busy = materialise(dialect.busy_calls(tables))
    segments, gaps = time_parts(msg, busy, primary(tables.header))
    folded = materialise(sidecar_activity(tables, dialect))

    turn = materialise(turns.turn_rollup(msg))
    edits = dialect.edit_rows(calls)
    drives = (F.col("tool") == "eval") & F.coalesce(F.col("code").rlike(r"\bbrowser\s*\."), F.lit(False))
    outcomes = materialise(pairing.call_outcomes(primary(tables.tool_calls).withColumn("drives_browser", drives), results))
    aborts = turns.abort_events(msg, calls)
    span = dialect_a.session_span(primary(tables.header), files)
    counts = tools.tool_counts(calls)

    wide = (
        span.select("session_id", "start_ms", "stop_ms", "duration_minutes", F.coalesce("cwd", F.lit("")).alias("project_path"), "path")
        .join(files.select("session_id", "signature", "advisor_logs", "subagent_logs"), "session_id", "left")
        .join(message_counts(msg), "session_id", "left")
        .join(usage.fold_sidecars(tables.usage_events), "session_id", "left")
        .join(folded.drop("busy_sec"), "session_id", "left")
        .join(tools.edit_totals(edits), "session_id", "left")
        .join(dialect.git_counts(calls), "session_id", "left")
        .join(tools.marker_counts(primary(tables.markers)), "session_id", "left")
        .join(dialect.tool_flags(counts, tables), "session_id", "left")
        .join(outcomes.groupBy("session_id").agg(F.count_if(F.col("outcome") == "error").alias("tool_errors")), "session_id", "left")
        .join(turn.groupBy("session_id").agg(F.count("*").alias("turn_count")), "session_id", "left")
        .join(medians(msg.where("ttft_ms > 0"), ["session_id"], "ttft_ms", "median_ttft_ms"), "session_id", "left")
        .withColumnsRenamed({"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_tokens", "cache_write": "cache_write_tokens"})
        .withColumn("cost_unavailable", F.col("total_cost").isNull())
    )
    totals = dialect.recorded_totals(tables)
    if totals is not None:
        wide = wide.join(totals, "session_id", "left").withColumns({
            "cost_unavailable": ~F.coalesce("cost_recorded", F.lit(False)),
            "lines_added": F.coalesce("state_added", "lines_added"), "lines_removed": F.coalesce("state_removed", "lines_removed"),
        }).drop("cost_recorded", "state_added", "state_removed")
    wide = wide.na.fill(0).na.fill(False)
    requests = timesplit.request_times(segments, gaps, idle_may_dominate=dialect.flat)
    slowest = timesplit.slowest_requests(requests, by="wall_sec" if dialect.flat else "active_sec")
    return {
        "sessions": wide, "turns": turn, "turn_percentiles": turns.turn_percentiles(turn), "worst_turns": turns.worst_turns(turn),
        "abort_events": aborts, "reply_times": turns.reply_times(msg), "activity_runs": activity.activity_runs(msg.withColumn("ts_ms", F.col("entry_ms"))),
        "tool_counts": counts, "tool_outcomes": pairing.tool_outcomes(outcomes, ["session_id"]), "outcomes": outcomes,
        "tool_durations": tools.tool_durations(pairing.timed_calls(starts, results)), "languages": dialect.language_counts(calls),
        "session_files": tools.edits_by_file(edits), "failure_classes": tools.failure_classes(msg),
        "session_time": timesplit.session_time(segments, gaps), "you_gaps": timesplit.you_gaps(segments, gaps),
        "requests": timesplit.with_prompts(slowest, humans),
        "subagent_busy": folded.select("session_id", "busy_sec"), "files": files,
        "busy_by_tool": timesplit.busy_by(busy, "tool"), "busy_by_family": timesplit.busy_by(busy, "family"),
        "usage_events": tables.usage_events, "humans": humans.select("session_id", "seq", "ts_ms", "is_human", "text"),
    }


def time_parts(msg: DataFrame, busy: DataFrame, header: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Owned stretches and gaps of each session's time."""
    intervals = timesplit.model_intervals(msg).unionByName(busy.select("session_id", "start_ms", "end_ms", "bucket", "background"))
    times = msg.select("session_id", "ts_ms").unionByName(intervals.select("session_id", F.col("end_ms").alias("ts_ms"))).unionByName(
        busy.where("background").select("session_id", F.col("start_ms").alias("ts_ms"))
    ).unionByName(header.select("session_id", F.col("end_ms").alias("ts_ms")))
    humans = msg.where("is_human and ts_ms is not null")
    segments = timesplit.time_segments(intervals, timesplit.session_ranges(times, humans), humans)
    return segments, materialise(timesplit.gap_pieces(segments))


def sidecar_activity(tables: LogTables, dialect: LogDialect) -> DataFrame:
    """Per session with sidecars: their calls, failed results and active seconds.

    Every sidecar, advisor or subagent, is a log of its own: its time is split
    like a session's, so overlapping work inside it counts once.
    """
    if dialect.flat:
        return tables.header.where("false").select("session_id", F.lit(0).cast("bigint").alias("sidecar_tool_calls"), F.lit(0).cast("bigint").alias("sidecar_tool_errors"), F.lit(0.0).alias("busy_sec"))
    # A name can't hold a line break, so the two parts come apart again.
    log = F.concat("session_id", F.lit("\n"), "sidecar_name")
    side = lambda df: df.where("kind <> 'primary'").withColumn("session_id", log)
    own = replace(tables, **{f.name: side(getattr(tables, f.name)).withColumn("kind", F.lit("primary")) for f in fields(tables)})
    segments, gaps = time_parts(own.messages, materialise(dialect.busy_calls(own)), own.header)
    back = F.substring_index("session_id", "\n", 1).alias("session_id")
    active = timesplit.session_time(segments, gaps).groupBy(back).agg(exact_sum(F.col("active_sec")).alias("busy_sec"))
    calls = own.tool_calls.groupBy(back).agg(F.count("*").alias("sidecar_tool_calls"))
    errors = own.messages.where("role = 'toolResult' and is_error").groupBy(back).agg(F.count("*").alias("sidecar_tool_errors"))
    return own.header.select(back).distinct().join(active, "session_id", "left").join(calls, "session_id", "left").join(errors, "session_id", "left").na.fill(0)


def message_counts(msg: DataFrame) -> DataFrame:
    aborted = (F.col("role") == "assistant") & (F.col("stop_reason") == "aborted")
    first = F.min_by(F.substring(trimmed(F.col("text")), 1, 300), F.when(F.col("is_human"), F.col("seq")))
    return msg.groupBy("session_id").agg(
        F.count_if("is_human").alias("user_message_count"), F.count_if(F.col("role") == "assistant").alias("assistant_message_count"),
        F.count_if(F.col("is_human") & F.col("steering")).alias("steering_messages"), F.count_if(aborted).alias("aborted_generations"),
        F.count_if((F.col("role") == "assistant") & (F.col("stop_reason") == "error")).alias("error_generations"),
        F.max_by(aborted.cast("int"), "seq").alias("aborted_at_session_end"), first.alias("first_prompt"),
    )


def corpus_tables(
    parts: dict[str, DataFrame], basis: DataFrame, facet_rows: DataFrame | None = None, *, by: Sequence[str] = (), owners: DataFrame | None = None,
    excluded_projects: Sequence[str] = (), goals: DataFrame | None = None, facet_counts: DataFrame | None = None, given_abort_labels: DataFrame | None = None,
    prose: DataFrame | None = None, **window,
) -> dict[str, DataFrame]:
    """The tables behind each report section over the sessions that stay.

    `by` names the corpus (user, team, project): columns of `owners`, which
    has one row per session. Nothing crosses corpora. Without `by` all sessions
    are the one corpus `all`; every table carries the column or columns.

    facet_rows: one row per labelled session. facet_counts: session_id, dim
    (goal, friction, satisfaction, ...), key, n. given_abort_labels:
    session_id, ts_ms, label. prose: by, path, text to be checked.
    """
    by = list(by) or ["corpus"]
    sessions = with_corpus(parts["sessions"], owners, by)
    reasons = sessions.withColumn("exclusion", filters.exclusion_reason(**window))
    stay = reasons.where("exclusion is null").drop("exclusion")
    if facet_counts is not None:
        stay = filters.drop_warmup_only(stay, facet_counts.where("dim = 'goal'"))
    keep = materialise(stay.withColumn("is_analysis", filters.is_analysis(F.col("project_path"), excluded_projects)))
    ids = keep.select("session_id", *by, "is_analysis", "project_path", "start_ms")
    own = ids.select("session_id", *by)
    of = lambda name: parts[name].join(own, "session_id")

    events = materialise(of("usage_events"))
    humans, outcomes = of("humans"), of("outcomes")
    totals = materialise(corpus.interruption_rate(corpus.corpus_totals(keep, by)))
    providers = usage.cost_by_provider(events, basis, by)
    billed = usage.billed_split(providers, by)
    elsewhere = activity.busy_elsewhere(of("you_gaps"), humans, by)
    time = materialise(timerollup.elsewhere_seconds(of("session_time"), elsewhere))
    rollup = materialise(timerollup.time_rollup(time, by))
    models = materialise(usage.list_price(usage.usage_by_model(events, by)))
    tiers = materialise(usage.model_tiers(models, by))
    session_models = events.groupBy("session_id", "model").agg(exact_sum(F.col("cost")).alias("cost"), F.count("*").alias("message_count"))
    series = materialise(
        keep.where("is_analysis").join(usage.primary_model(session_models), "session_id", "left").select(
            *by, "session_id", "start_ms", F.col("total_cost").alias("cost"), F.col("tool_errors").cast("double").alias("errors"), F.coalesce("model", F.lit("")).alias("model"),
        )
    )
    hours = activity.active_hours_by_day(of("activity_runs"), by)
    tool_outcomes = materialise(pairing.tool_outcomes(outcomes, by))
    error_rates = corpus.error_rates(tool_outcomes)
    session_families = materialise(of("busy_by_family"))
    families = materialise(session_families.groupBy(*by, "family").agg(exact_sum(F.col("busy_sec")).alias("busy_sec")))
    found = materialise(timerollup.levers(rollup, families, models, of("subagent_busy").groupBy(*by).agg(exact_sum(F.col("busy_sec")).alias("busy_sec")), by))
    worst_cache = corpus.worst_cache_sessions(keep, by)
    delta, trend, spikes = trends.deltas(series, by), trends.trajectory(series, by), trends.anomalies(series, by)
    projects = corpus.project_counts(keep, by)
    worst_turns = materialise(corpus.worst_turns(parts["worst_turns"].drop("rank").join(ids.drop("start_ms"), "session_id"), by))

    slow = materialise(usage.top_rows(of("requests").drop("rank"), by, [F.desc("active_sec"), F.asc("session_id"), F.asc("request_no")], 5))

    out = {
        "kept": keep.select(*by, "session_id", "is_analysis"),
        "scan": scan_counts(with_corpus(parts["files"], owners, by), reasons, keep, by, facet_rows),
        "totals": totals, "cost_shares": corpus.cost_shares(totals, by), "cost_by_provider": providers, "billed": billed,
        "models": tiers, "tools": corpus.top_keys(corpus.merged_counts(of("tool_counts"), "tool", by), "tool", by),
        "error_rates": error_rates, "tool_durations": corpus.pooled_tool_durations(materialise(of("tool_durations")), by),
        "turn_percentiles": corpus.pooled_percentiles(
            materialise(of("turn_percentiles").join(keep.select("session_id", "turn_count"), "session_id")), "metric", "turn_count", by
        ),
        "worst_turns": worst_turns,
        "worst_cache": worst_cache, "churned_files": corpus.churned_files(of("session_files"), by),
        "calendar": corpus.calendar(keep, by), "projects": projects, "active_hours": hours,
        "overlaps": activity.overlap_summary(activity.interleavings(humans, by), by), "hour_histogram": activity.hour_histogram(humans, by),
        "responses": corpus.response_medians(of("reply_times"), keep, by), "reply_histogram": activity.reply_histogram(of("reply_times"), by),
        "time_rollup": rollup, "levers": timerollup.ranked_levers(found, slow, by), "lever_evidence": timerollup.lever_evidence(found, time, session_families, by),
        "unrecognised_waiting": timerollup.unrecognised_waiting(families, rollup, by),
        "slow_requests": slow,
        "abort_events": of("abort_events"), "weeks": trends.week_summary(series, by), "trajectory": trend, "anomalies": spikes, "delta": delta,
        "delta_unavailable": trends.delta_unavailable(series, delta, by),
    }
    given = given_abort_labels if given_abort_labels is not None else parts["abort_events"].select("session_id", "ts_ms", F.lit("").alias("label")).where("false")
    out["abort_labels"] = labels.abort_labels(of("abort_events"), given, by)
    named = {}
    if facet_rows is not None:
        good = materialise(labels.valid_facets(facet_rows).drop(*by, "start_ms").join(ids, "session_id"))
        analysed = good.where("is_analysis")
        out["outcomes"] = named["outcomes"] = materialise(labels.outcome_counts(analysed, by))
        # session columns win over facet columns of the same name
        mismatch = materialise(usage.model_mismatch(keep.where("is_analysis"), good.select("session_id", "outcome", "session_type"), session_models, tiers, by))
        out["model_mismatch"] = named["flagged"] = mismatch
        out["waste"] = named["waste"] = mismatch.groupBy(*by).agg(exact_sum(F.col("waste")).alias("estimated_waste"), F.count("*").alias("flagged"))
        out["narratives"] = labels.narrative_lists(good, by)
        if facet_counts is not None:
            counts = facet_counts.drop(*by, "start_ms").join(ids, "session_id")
            single = labels.single_labels(analysed.select("session_id", *by, "start_ms", "session_type"), ["session_type"])
            label_rows = counts.where("is_analysis").select("session_id", *by, "start_ms", "dim", "key", F.col("n").cast("double").alias("n"))
            weighted = materialise(labels.weighted_counts(label_rows.unionByName(single), by))
            whole = weighted.groupBy(*by, "dim").agg(F.sum("n").alias("all_n"))
            sample = analysed.groupBy(*by).agg(F.count("*").alias("facet_sessions"))
            out["label_shares"] = named["label_shares"] = weighted.join(whole, [*by, "dim"]).join(sample, by).withColumn("share", F.col("n") / F.col("all_n"))
            friction = label_rows.where("dim = 'friction'").drop("dim")
            latest = keep.groupBy(*by).agg(F.max("start_ms").alias("latest_ms"))
            current = weighted.where("dim = 'friction'").select(*by, "key", "n")
            out["friction_status"] = labels.capped_friction(labels.friction_status(friction, latest, current, by, since_days=window.get("since_days")), by)
    out["facts"] = materialise(facts.total_facts(totals, by, tool_outcomes=tool_outcomes, billed=billed).unionByName(facts.named_facts(
        by, models=models.join(totals.select(*by, "total_cost"), by), providers=providers.join(totals.select(*by, "sessions"), by), hours=hours.join(totals.select(*by, "sessions"), by),
        time_shares=rollup, families=families, error_rates=error_rates, worst_cache=worst_cache, turns=worst_turns, delta=delta, trend=trend, spikes=spikes,
        projects=projects.join(projects.groupBy(*by).agg(F.sum("sessions").alias("total_sessions")), by), **named,
    )).join(corpus.calendar(keep, by).select(*by, F.concat_ws("..", "first_day", "last_day").alias("window")), by))
    if prose is not None:
        quotes = facts.quoted_figures(prose, [*by, "path"])
        out["fact_flags"] = facts.unbacked_figures(quotes, out["facts"], by)
    return out


def with_corpus(df: DataFrame, owners: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Add the corpus columns; without owners all is one corpus."""
    if owners is None:
        return df.withColumns({c: F.lit("all") for c in by})
    return df.join(owners.select("session_id", *by), "session_id")


def scan_counts(files: DataFrame, reasons: DataFrame, keep: DataFrame, by: Sequence[str], facet_rows: DataFrame | None = None) -> DataFrame:
    """What the scan saw: logs by kind and copies, sessions left out by reason,
    kept, masked and without cost, labels read and failed; zeros included."""
    by = list(by)
    why = lambda r: F.count_if(F.col("exclusion") == r).alias(f"excluded_{r}")
    of = lambda r: F.count_if(F.col("dropped") == r)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    read = files.groupBy(*by).agg(
        F.count("*").alias("primary_logs"), total("duplicate_logs"), total("advisor_logs"), total("subagent_logs"),
        of("tooling").alias("excluded_meta"), of("unparsed").alias("excluded_unparsed"),
    )
    seen = reasons.groupBy(*by).agg(
        F.count("*").alias("sessions_scanned"), *[why(r) for r in ("current", "not_substantive", "by_since", "other_session")],
        F.count_if(F.col("exclusion").isNull()).alias("_open"),
    )
    stayed = keep.groupBy(*by).agg(
        F.count("*").alias("included"), F.count_if("is_analysis").alias("analysed"), F.count_if("cost_unavailable").alias("cost_unavailable")
    )
    joined = read.join(seen, by, "left").join(stayed, by, "left")
    if facet_rows is not None:
        mine = facet_rows.drop(*by, "start_ms").join(keep.select("session_id", *by), "session_id")
        good = labels.is_valid_facet()
        counted = mine.groupBy(*by).agg(F.count_if(good).alias("facets_analyzed"), F.count_if(~good).alias("facet_failures"))
        joined = joined.join(counted, by, "left")
    else:
        joined = joined.withColumns({c: F.lit(0).cast("bigint") for c in ("facets_analyzed", "facet_failures")})
    joined = joined.na.fill(0)
    return joined.withColumns({"excluded_warmup": F.col("_open") - F.col("included"), "excluded_tooling": F.col("included") - F.col("analysed")}).drop("_open")


def manifest(parts: dict[str, DataFrame], report: dict[str, DataFrame], owned: DataFrame | None = None) -> dict[str, DataFrame]:
    """The audit tables of a report: exact session set, sidecars, totals, facts and flags."""
    cost = ["total_cost", "cost_primary", "cost_advisor", "cost_subagent"]
    kept = report["kept"].select("session_id")
    session_set = parts["sessions"].join(kept, "session_id", "left_semi").select("session_id", "path", "signature", "start_ms", *cost)
    out = {"session_set": session_set, **{n: report[n] for n in ("scan", "totals", "facts", "fact_flags") if n in report}}
    if owned is not None:
        out["session_sidecars"] = owned.where("kind <> 'primary'").join(kept, "session_id", "left_semi").select("session_id", "kind", "sidecar_name", "path", "size")
    return out
