"""Quotable facts and the check of prose against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.functions.numeric import ratio, round_half_up
from worktrail.operators.scan import by_magnitude, ordered_scan
from worktrail.operators.usage import with_row
from worktrail.session import materialise

PERCENT_TOLERANCE = 1.0  # fixed values: how close a quoted figure must be
DOLLAR_TOLERANCE = 0.01

# How figures are written.
NUMBER = r"(\d[\d,]*(?:\.\d+)?)"
PERCENT = rf"{NUMBER}(?:\s*(?:-|to)\s*{NUMBER})?\s*%"
DOLLAR = rf"\$\s?{NUMBER}\s*([kKmM]\b)?"

FACT = ["fact_id", "value", "unit", "definition", "n", "population"]


def fact(df: DataFrame, by: Sequence[str], fact_id, value: Column, unit: str, definition, n: Column, population: str) -> DataFrame:
    """Rows of one kind of fact; figures that are not finite drop out."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    v = value.cast("double")
    rounded = round_half_up(v, 2 if unit == "usd" else 1)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.where(finite).select(
        *by, text(fact_id).alias("fact_id"), rounded.alias("value"), F.lit(unit).alias("unit"),
        text(definition).alias("definition"), n.cast("bigint").alias("n"), F.lit(population).alias("population"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def percent_of(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def total_facts(totals: DataFrame, by: Sequence[str], tool_outcomes: DataFrame | None = None, billed: DataFrame | None = None) -> DataFrame:
    """Facts from the corpus totals row: all figures in one pass over it.

    `tool_outcomes` (by, tool, calls) gives the tool calls that errors are out
    of; `billed` (by, billed_cost, subscription_cost) what was paid.
    """
    by = list(by)
    attach = lambda df, extra: df.join(extra, by, "left") if by else with_row(df, extra)
    if tool_outcomes is not None:
        totals = attach(totals, tool_outcomes.groupBy(*by).agg(F.sum(F.col("calls") + F.col("not_found")).alias("tool_calls"))).na.fill(0, ["tool_calls"])
    if billed is not None:
        totals = attach(totals, billed.select(*by, "billed_cost", "subscription_cost"))
    have = set(totals.columns)
    calls = F.col("tool_calls")
    s, m = F.col("sessions"), F.col("user_message_count")
    specs = [
        ("sessions", s, "count", "sessions that the report covers", s, "sessions", "sessions"),
        ("messages", m, "count", "human messages", s, "sessions", "user_message_count"),
        ("interruptions", F.col("interruptions"), "count", "aborts inside sessions + steering messages", m, "human messages", "interruptions"),
        ("interruptions.aborted", F.col("interruptions_aborted"), "count", "aborts not at session end", m, "human messages", "interruptions_aborted"),
        ("interruptions.steered", F.col("steering_messages"), "count", "steering messages", m, "human messages", "steering_messages"),
        ("interruption_rate", F.col("interruption_rate") * 100, "pct", "interruptions / human messages", m, "human messages", "interruption_rate"),
        ("cache_hit_ratio", percent_of(F.col("cache_read_tokens"), F.col("cache_read_tokens") + F.col("input_tokens")), "pct",
         "cache read / (input + cache read) tokens", s, "sessions", "cache_read_tokens"),
        ("tool_errors", F.col("tool_errors"), "count", "tool results that failed", calls, "tool calls", "tool_calls"),
        ("tool_error_rate", percent_of(F.col("tool_errors"), calls), "pct", "tool calls that failed, of all", calls, "tool calls", "tool_calls"),
        ("billed_cost", F.col("billed_cost"), "usd", "cost on providers paid by use", s, "sessions", "billed_cost"),
        ("subscription_cost", F.col("subscription_cost"), "usd", "list-price value of what plans cover", s, "sessions", "subscription_cost"),
        ("total_cost", F.col("total_cost"), "usd", "all cost that logs record", s, "sessions", "total_cost"),
        ("cost_per_session", ratio(F.col("total_cost"), s), "usd", "total cost / sessions", s, "sessions", "total_cost"),
        ("cost.utility", F.col("utility_cost"), "usd", "cost of out-of-band calls", s, "sessions", "utility_cost"),
        ("subagent_session_share", percent_of(F.col("sessions_uses_subagent"), s), "pct", "sessions with subagents / sessions", s, "sessions", "sessions_uses_subagent"),
        ("mcp_session_share", percent_of(F.col("sessions_uses_mcp"), s), "pct", "sessions with tool servers / sessions", s, "sessions", "sessions_uses_mcp"),
    ]
    for c in ("primary", "advisor", "subagent"):
        specs.append((f"cost.{c}", F.col(f"cost_{c}"), "usd", f"{c} cost", s, "sessions", f"cost_{c}"))
        specs.append((f"cost_share.{c}", percent_of(F.col(f"cost_{c}"), F.col("total_cost")), "pct", f"{c} cost / total cost", s, "sessions", f"cost_{c}"))
    cells = [
        F.struct(F.lit(i).alias("fact_id"), v.cast("double").alias("v"), F.lit(u).alias("unit"), F.lit(d).alias("definition"),
                 n.cast("bigint").alias("n"), F.lit(p).alias("population"))
        for i, v, u, d, n, p, need in specs if need in have
    ]
    rows = totals.select(*by, F.explode(F.array(*cells)).alias("x")).select(*by, "x.*")
    rounded = F.when(F.col("unit") == "usd", round_half_up(F.col("v"), 2)).otherwise(round_half_up(F.col("v"), 1))
    return rows.where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("value", rounded).select(*by, *FACT)


def named_facts(
    by: Sequence[str], *, models: DataFrame | None = None, providers: DataFrame | None = None, projects: DataFrame | None = None,
    error_rates: DataFrame | None = None, outcomes: DataFrame | None = None, label_shares: DataFrame | None = None,
    worst_cache: DataFrame | None = None, flagged: DataFrame | None = None, turns: DataFrame | None = None,
    delta: DataFrame | None = None, trend: DataFrame | None = None, spikes: DataFrame | None = None,
    hours: DataFrame | None = None, time_shares: DataFrame | None = None, families: DataFrame | None = None, waste: DataFrame | None = None,
) -> DataFrame:
    """Facts with a name in the id: per model, provider, project, tool, label, session.

    providers and hours carry `sessions`, the corpus size, which is their n.
    families: by, family, busy_sec; needs time_shares. waste: by,
    estimated_waste, flagged.
    """
    b, parts = list(by), []
    tag = lambda prefix, col: F.concat(F.lit(prefix + "."), F.col(col).cast("string"))
    short = lambda prefix: F.concat(F.lit(prefix + "."), F.substring("session_id", 1, 8))
    one = F.lit(1)

    def add(df, *spec):
        parts.append(fact(df, b, *spec))

    if models is not None:
        n = F.col("sessions")
        add(models, tag("model_cost", "model"), F.col("cost"), "usd", "recorded cost on the model", n, "sessions using the model")
        add(models, tag("model_cost_share", "model"), percent_of(F.col("cost"), F.col("total_cost")), "pct", "model cost / total cost", n, "sessions using the model")
        priced = models.where("input_per_mtok > 0 or output_per_mtok > 0")
        add(priced, tag("list_price.input", "model"), F.col("input_per_mtok"), "usd", "implied price per million input tokens", n, "sessions using the model")
        add(priced, tag("list_price.output", "model"), F.col("output_per_mtok"), "usd", "implied price per million output tokens", n, "sessions using the model")
    if providers is not None:
        add(providers, tag("cost_by_provider", "provider"), F.col("cost"), "usd", F.concat(F.lit("cost by basis: "), F.col("basis")), F.col("sessions"), "sessions")
    if projects is not None:
        add(projects, tag("project_share", "project"), percent_of(F.col("sessions"), F.col("total_sessions")), "pct", "sessions in the project / sessions", F.col("total_sessions"), "sessions")
    if error_rates is not None:
        add(error_rates, tag("tool_error_rate", "tool"), F.col("rate") * 100, "pct", "failed / calls of the tool", F.col("calls"), "calls")
    if outcomes is not None:
        whole = outcomes.groupBy(*b).agg(F.sum("n").alias("all_n"), F.sum(F.when(F.col("outcome").isin("fully_achieved", "mostly_achieved"), F.col("n")).otherwise(0)).alias("good_n"))
        add(whole, "success_rate", percent_of(F.col("good_n"), F.col("all_n")), "pct", "sessions that reached all or most of their goal, of those with an outcome", F.col("all_n"), "sessions with facets")
        counted = outcomes.join(whole, b) if b else with_row(outcomes, whole)
        add(counted, tag("outcome_share", "outcome"), F.col("share") * 100, "pct", "sessions with the outcome (unweighted)", F.col("all_n"), "sessions with facets")
    if label_shares is not None:
        add(label_shares, F.concat_ws(".", F.concat(F.col("dim"), F.lit("_share")), "key"), F.col("share") * 100, "pct", "decay-weighted share", F.col("facet_sessions"), "sessions with facets")
    if worst_cache is not None:
        add(worst_cache, short("cache_hit_ratio.session"), F.col("ratio") * 100, "pct", "cache hit ratio of one session", one, "session")
        add(worst_cache, short("cost.session"), F.col("total_cost"), "usd", "cost of one session", one, "session")
    if flagged is not None:
        add(flagged, short("model_efficiency"), F.col("model_cost"), "usd", F.concat(F.lit("cost of a session flagged "), F.col("flag")), one, "session")
    if turns is not None:
        add(turns, short("worst_turn"), F.col("cost"), "usd", "cost of one turn", one, "turn")
    if delta is not None:
        d, n = delta.where("not insufficient"), F.col("before_n") + F.col("after_n")
        for c, unit in (("cost", "usd"), ("errors", "count")):
            add(d, f"delta.{c}_per_session", F.col(f"{c}_pct"), "pct", "change of the mean per session", n, "sessions")
        add(d, "delta.cost_per_session.before", F.col("before_cost"), "usd", "mean cost per session before", F.col("before_n"), "sessions")
        add(d, "delta.cost_per_session.after", F.col("after_cost"), "usd", "mean cost per session after", F.col("after_n"), "sessions")
    if trend is not None:
        t, n = trend.where("cost_trend <> 'insufficient'"), F.col("recent_n") + F.col("older_n")
        for c in ("cost", "errors"):
            add(t, f"trajectory.{c}_per_session", F.col(f"{c}_pct"), "pct", "change of the mean, recent against older", n, "sessions")
        add(t, "trajectory.cost_per_session.recent", F.col("recent_mean_cost"), "usd", "mean cost, recent window", F.col("recent_n"), "sessions")
        add(t, "trajectory.cost_per_session.older", F.col("older_mean_cost"), "usd", "mean cost, older window", F.col("older_n"), "sessions")
    if spikes is not None:
        add(spikes, F.concat(F.lit("anomaly."), F.to_date(F.timestamp_millis("start_ms")).cast("string")), F.col("cost"), "usd", "cost of an outlier session", one, "session")
    if hours is not None:
        h = hours.groupBy(*b).agg(F.sum("hours").alias("h"), F.count("*").alias("d"), F.max("sessions").alias("sessions"))
        add(h, "active_hours", F.col("h"), "hours", "union of activity per day", F.col("sessions"), "sessions")
        add(h, "active_hours_per_day", ratio(F.col("h"), F.col("d")), "hours", "active hours / active days", F.col("d"), "active days")
    if time_shares is not None:
        add(time_shares, tag("time.share", "bucket"), F.col("share") * 100, "pct", "share of active time (idle: of active + idle)", F.col("sessions"), "sessions")
        tools = time_shares.where("bucket = 'tools'")
        add(tools, "time.active_sec", F.col("active_sec"), "count", "seconds in all buckets but idle", F.col("sessions"), "sessions")
        if families is not None:
            top = families.where("busy_sec > 0").groupBy(*b).agg(F.min_by(F.struct("family", "busy_sec"), F.struct((-F.col("busy_sec")).alias("s"), F.col("family"))).alias("top"))
            led = tools.where("seconds > 0")
            led = (led.join(top, b) if b else with_row(led, top)).select("*", "top.*")
            add(led, tag("time.top_command_family", "family"), F.col("busy_sec") / F.col("seconds") * 100, "pct", "the family's part of tool time", F.col("sessions"), "sessions")
    if waste is not None:
        add(waste, "estimated_waste", F.col("estimated_waste"), "usd", "what flagged sessions may have cost too much", F.col("flagged"), "flagged sessions")
    return _union(parts)


def quoted_figures(prose: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every percentage and dollar amount of each text: keys, unit, at, value, slack, excerpt.

    `slack` is half a unit of the precision the text printed. Whole texts are
    read; a range such as 40-60% gives two rows.
    """
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")

    def found(pattern: str, unit: str) -> DataFrame:
        group = lambda i: F.regexp_extract_all("text", F.lit(pattern), F.lit(i))
        length = lambda parts, n: F.aggregate(
            F.slice(parts, F.lit(1), n), F.lit(0), lambda acc, p: acc + F.length(p)
        )
        found_ = prose.where(F.col("text").rlike(pattern)).select(
            *keys, "text", F.split("text", pattern, -1).alias("pieces"), group(0).alias("matches"),
            F.arrays_zip(group(1).alias("a"), group(2).alias("b")).alias("zipped"),
        )

        # Excerpts are cut before the rows are multiplied, so no row carries the text.
        def quote(m, at):
            # Characters before the match: the pieces up to it and the earlier matches.
            before = length(F.col("pieces"), at + 1) + length(F.col("matches"), at)
            from_ = F.greatest(before - 39, F.lit(1))
            return F.struct(m["a"].alias("a"), m["b"].alias("b"), F.trim(F.substr("text", from_, before + 41 - from_)).alias("excerpt"))

        return found_.select(*keys, F.posexplode(F.transform("zipped", quote)).alias("at", "m")).select(
            *keys, F.lit(unit).alias("unit"), "at", "m", F.col("m.excerpt").alias("excerpt")
        )

    pct = found(PERCENT, "pct").select(
        *keys, "unit", "at", "excerpt", F.explode(F.filter(F.array("m.a", "m.b"), lambda x: x.isNotNull() & (x != ""))).alias("raw"),
    ).select(*keys, "unit", "at", number(F.col("raw")).alias("value"), F.lit(0.0).alias("slack"), "excerpt")
    scale = F.when(F.lower("m.b") == "k", 1e3).when(F.lower("m.b") == "m", 1e6).otherwise(1.0)
    decimals = F.length(F.regexp_extract("m.a", r"\.(\d+)$", 1))
    usd = found(DOLLAR, "usd").select(
        *keys, "unit", "at", (number(F.col("m.a")) * scale).alias("value"),
        (F.lit(0.5) * F.pow(F.lit(10.0), -decimals) * scale).alias("slack"), "excerpt",
    )
    return pct.unionByName(usd)


def unbacked_figures(quotes: DataFrame, facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Quotes no fact backs.

    A fact backs a percentage within one point, and an amount within 1 % of
    the fact or the printed precision; signs do not count. The nearest fact on
    each side decides, so quotes and facts meet in one sorted scan and never
    as pairs.
    """
    keys = [*by, "unit"]
    quotes = materialise(quotes)  # narrow; the texts are searched once
    # A figure quoted often is looked up once; verdicts are joined back.
    figure = [*keys, "value", "slack"]
    q = quotes.groupBy(*figure).agg(F.lit(1).alias("is_quote"))
    f = facts.where("unit in ('pct', 'usd')").select(*keys, F.abs("value").alias("value")).distinct().select(
        *keys, "value", F.lit(0.0).alias("slack"), F.lit(0).alias("is_quote")
    )
    known = F.when(F.col("is_quote") == 0, F.col("value"))
    # The scan reads its input twice.
    rows = ordered_scan(
        materialise(q.unionByName(f)), keys, ["value", "is_quote", "slack"], by_magnitude("value"), last={"lo": known}, next_={"hi": known}
    ).where("is_quote = 1")
    slack = lambda u: F.when(F.col("unit") == "pct", F.lit(PERCENT_TOLERANCE)).otherwise(
        F.greatest(u * DOLLAR_TOLERANCE, F.col("slack"))
    )
    near = lambda u: F.coalesce(F.abs(u - F.col("value")) <= slack(u), F.lit(False))
    unbacked = rows.where(~near(F.col("lo")) & ~near(F.col("hi"))).select(*figure)
    return quotes.join(unbacked, figure, "left_semi")
