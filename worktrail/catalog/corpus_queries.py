"""Queries over many sessions: totals, pooled figures, labels, trends, facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.catalog import mapping as m
from worktrail.catalog.mapping import dec, table
from worktrail.catalog.registry import query
from worktrail.catalog.session_queries import (
    ABORTS, COUNTED, DAYS, EDITS, FIRST_CALLS, GAP, MODEL_USAGE, OUTCOMES, RUNS, STARTS_AND_RESULTS, TOOL_DURATIONS, TURN_PCT, TURNS,
    abort_rows, edit_rows, first_calls, hours, outcomes, timed_calls, turn_rows,
)
from worktrail.functions import numeric
from worktrail.operators import corpus, facts, filters, labels, pairing, tools, trends, turns, usage
from worktrail.session import materialise
from worktrail.sources import facets as facet_files

# --- session rows -------------------------------------------------------------------

PROJECT = "concat('/home/dev/proj-', user_id % 12)"
SESSIONS = (
    f"sessions AS (SELECT session_id, user_id, {PROJECT} AS project_path, min(ts_ms) AS start_ms, max(ts_ms) AS stop_ms, "
    "CAST(floor((max(ts_ms) - min(ts_ms)) / 60000.0 + 0.5) AS BIGINT) AS duration_minutes, "
    "count(*) FILTER (is_human) AS user_message_count, count(*) FILTER (is_error) AS tool_errors, "
    "count(*) FILTER (is_human AND steering) AS steering_messages, count(*) FILTER (stop_reason = 'aborted') AS aborted_generations, "
    "count(*) FILTER (stop_reason = 'error') AS error_generations, arg_max(CASE WHEN stop_reason = 'aborted' THEN 1 ELSE 0 END, seq) AS aborted_at_session_end, "
    + ", ".join(f"{dec(c)} AS {n}" for c, n in (("cost", "total_cost"), ("input", "input_tokens"), ("output", "output_tokens"), ("cache_read", "cache_read_tokens"), ("cache_write", "cache_write_tokens")))
    + " FROM messages GROUP BY session_id, user_id)"
)


def sessions(spark, d):
    """One row per session, from one aggregate over the messages."""
    aborted = F.col("stop_reason") == "aborted"
    exact = numeric.exact_sum
    rows = m.messages(spark, d).groupBy("session_id", "user_id").agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("stop_ms"), F.count_if("is_human").alias("user_message_count"),
        F.count_if("is_error").alias("tool_errors"), F.count_if(F.col("is_human") & F.col("steering")).alias("steering_messages"),
        F.count_if(aborted).alias("aborted_generations"), F.count_if(F.col("stop_reason") == "error").alias("error_generations"),
        F.max_by(aborted, "seq").cast("int").alias("aborted_at_session_end"), exact(F.col("cost")).alias("total_cost"),
        exact(F.col("input")).alias("input_tokens"), exact(F.col("output")).alias("output_tokens"),
        exact(F.col("cache_read")).alias("cache_read_tokens"), exact(F.col("cache_write")).alias("cache_write_tokens"),
    )
    from worktrail.sources.dialect_a import span_columns

    return span_columns(rows).withColumn("project_path", F.expr(PROJECT))


query("s09_session_span", "session_id:s start_ms:l stop_ms:l duration_minutes:l", "SELECT * FROM sessions", ["messages"], [SESSIONS])(sessions)

# --- filters ------------------------------------------------------------------------

NOW_MS = 1_706_745_600_000
REASON = f"CASE WHEN user_message_count < 2 OR duration_minutes < 1 THEN 'not_substantive' WHEN {NOW_MS} - start_ms >= 14 * 86400000 THEN 'by_since' END"
query("f3_substance_and_since", "session_id:s reason:s", f"SELECT session_id, {REASON} AS reason FROM sessions", ["messages"], [SESSIONS])(
    lambda s, d: sessions(s, d).withColumn("reason", filters.exclusion_reason(now_ms=NOW_MS, since_days=14)))
query("f4_current_session", "session_id:s reason:s",
      f"SELECT session_id, CASE WHEN session_id = 'u0-w2818' THEN 'current' ELSE {REASON} END AS reason FROM sessions", ["messages"], [SESSIONS])(
    lambda s, d: sessions(s, d).withColumn("reason", filters.exclusion_reason(now_ms=NOW_MS, since_days=14, current_id="u0-w2818")))
query("f4_only_session", "session_id:s user_message_count:l", "SELECT * FROM sessions WHERE session_id = 'u0-w2818'", ["messages"], [SESSIONS])(
    lambda s, d: filters.substantive(sessions(s, d), now_ms=NOW_MS, only_id="u0-w2818"))
query("f5_warmup_only", "session_id:s",
      "SELECT session_id FROM facets WHERE session_id NOT IN (SELECT session_id FROM facet_counts WHERE dim = 'goal' AND n > 0 GROUP BY 1 HAVING min(key) = 'warmup_minimal' AND max(key) = 'warmup_minimal')",
      ["facets", "facet_counts"])(
    lambda s, d: filters.drop_warmup_only(m.facets(s, d).select("session_id"), m.facet_counts(s, d).where("dim = 'goal'")))
MASK = ["PROJ-3", "proj-7"]
query("f6_analysis_mask", "session_id:s is_analysis:l",
      "SELECT session_id, CASE WHEN contains(project_path, 'proj-3') OR contains(project_path, 'proj-7') THEN 0 ELSE 1 END AS is_analysis FROM sessions", ["messages"], [SESSIONS])(
    lambda s, d: sessions(s, d).withColumn("is_analysis", filters.is_analysis(F.col("project_path"), MASK)))
RECORD_ID = "CASE WHEN c_custkey % 5 = 0 THEN '..' WHEN c_custkey % 3 = 0 THEN concat('ok-', c_custkey) ELSE c_name END"
FILE_ID = "CASE WHEN c_custkey % 7 = 0 THEN 'bad/id' ELSE concat('f', c_custkey) END"
query("f7_safe_id", "c_custkey:l id:s",
      f"SELECT c_custkey, CASE WHEN regexp_full_match(r, '[A-Za-z0-9._-]+') AND r NOT IN ('.', '..') THEN r WHEN regexp_full_match(f, '[A-Za-z0-9._-]+') THEN f END AS id FROM (SELECT c_custkey, {RECORD_ID} AS r, {FILE_ID} AS f FROM customer)")(
    lambda s, d: table(s, d, "customer").withColumn("id", filters.safe_session_id(F.expr(RECORD_ID), F.expr(FILE_ID))))
query("f8_minimum_evidence", "o_orderkey:l",
      "SELECT o_orderkey FROM orders WHERE len(list_distinct([o_custkey % 3, o_orderkey % 3, o_custkey % 2])) >= 2")(
    lambda s, d: table(s, d, "orders").where(filters.has_evidence(F.expr("array(o_custkey % 3, o_orderkey % 3, o_custkey % 2)").cast("array<string>"))))
CANDIDATE = "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE concat(p_name, '_', lower(p_type)) END"
NAME_TOKENS = "list_filter(string_split(trim(replace(replace(lower({x}), '-', ' '), '_', ' ')), ' '), lambda w: length(w) > 3 AND w NOT IN ('with', 'your', 'that', 'this', 'skill', 'skills'))"
query("f9_near_duplicate_names", "name:s n:l",
      f"SELECT name, count(*) AS n FROM (SELECT {CANDIDATE} AS name FROM part) c WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT concat(lower(p_type), ' plating skill') AS e FROM part UNION ALL SELECT DISTINCT lower(p_type) FROM part) x "
      "WHERE contains(replace(lower(c.name), '_', ' '), x.e) OR len(list_intersect(list_distinct(" + NAME_TOKENS.format(x="c.name") + "), list_distinct(" + NAME_TOKENS.format(x="x.e")
      + "))) >= 0.5 * nullif(least(len(list_distinct(" + NAME_TOKENS.format(x="c.name") + ")), len(list_distinct(" + NAME_TOKENS.format(x="x.e") + "))), 0)) GROUP BY 1")(
    lambda s, d: filters.drop_near_duplicates(
        table(s, d, "part").select(F.expr(CANDIDATE).alias("name")),
        table(s, d, "part").select(F.expr("concat(lower(p_type), ' plating skill')").alias("existing")).union(table(s, d, "part").select(F.expr("lower(p_type)"))),
    ).groupBy("name").agg(F.count("*").alias("n")))

# Suggestions of four users, some naming features that the user has switched off or skills that are there.
SUGGESTED = {
    "usr": "p_size % 4", "name": "CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' Skill') ELSE p_name END",
    "text": m.pick("p_partkey % 6", ["use the Learn tool", "try manage_skill", "please recall it", "see memory (learn)", "retained", "plain words"]),
}
SUGGESTIONS = "sug AS (SELECT p_partkey, " + ", ".join(f"{e} AS {n}" for n, e in SUGGESTED.items()) + " FROM part), inst AS (SELECT DISTINCT p_size % 4 AS usr, lower(p_type) AS skill FROM part WHERE p_partkey % 7 = 0)"
CLOSE = (
    "contains(replace(lower(c.name), '_', ' '), x.skill) OR len(list_intersect(list_distinct(" + NAME_TOKENS.format(x="c.name") + "), list_distinct(" + NAME_TOKENS.format(x="x.skill")
    + "))) >= 0.5 * nullif(least(len(list_distinct(" + NAME_TOKENS.format(x="c.name") + ")), len(list_distinct(" + NAME_TOKENS.format(x="x.skill") + "))), 0)"
)


def suggestions_kept(spark, d):
    part = table(spark, d, "part")
    rows = part.select("p_partkey", *[F.expr(e).alias(n) for n, e in SUGGESTED.items()])
    installed = part.where("p_partkey % 7 = 0").select(F.expr("p_size % 4").alias("usr"), F.lower("p_type").alias("skill"))
    settings = rows.select("usr").distinct().where("usr < 3").select(
        "usr", (F.col("usr") != 1).alias("autolearn"), F.expr(m.pick("usr", ["hindsight", "off", "local"])).alias("backend"))
    return filters.filter_suggestions(rows, installed, settings, ["usr"])


query("f9_suggestions", "p_partkey:l usr:l",
      "SELECT p_partkey, usr FROM sug c WHERE NOT (contains(lower(name), 'skill') AND EXISTS (SELECT 1 FROM inst x WHERE x.usr = c.usr AND (" + CLOSE + "))) "
      "AND NOT (usr IN (1, 3) AND p_partkey % 6 IN (0, 1, 3)) AND NOT (usr <> 0 AND p_partkey % 6 = 2)", [], [SUGGESTIONS])(suggestions_kept)

# --- totals and top lists ------------------------------------------------------------

TOTALS = ["user_message_count", "input_tokens", "output_tokens", "tool_errors", "steering_messages", "aborted_generations", "error_generations", "aborted_at_session_end", "cache_read_tokens", "cache_write_tokens"]
TOTAL_CTE = "totals AS (SELECT user_id, count(*) AS sessions, " + ", ".join(f"sum({c}) AS {c}" for c in TOTALS) + f", {dec('total_cost')} AS total_cost FROM sessions GROUP BY 1)"
query("a22_corpus_totals", "user_id:l sessions:l " + " ".join(f"{c}:l" for c in TOTALS) + " total_cost:d", "SELECT * FROM totals", ["messages"], [SESSIONS, TOTAL_CTE])(
    lambda s, d: corpus.corpus_totals(sessions(s, d), ["user_id"]))
query("a28_interruption_rate", "user_id:l interruptions:l interruption_rate:d",
      "SELECT user_id, aborted_generations - aborted_at_session_end + steering_messages AS interruptions, CASE WHEN user_message_count > 0 THEN "
      "CAST(aborted_generations - aborted_at_session_end + steering_messages AS DOUBLE) / user_message_count ELSE 0 END AS interruption_rate FROM totals", ["messages"], [SESSIONS, TOTAL_CTE])(
    lambda s, d: corpus.interruption_rate(corpus.corpus_totals(sessions(s, d), ["user_id"])))


def tool_rows(spark, d):
    return tools.tool_counts(first_calls(spark, d), ["user_id"])


query("a21_merge_and_top8", "user_id:l tool:s n:l rank:l",
      "SELECT user_id, tool, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tool) AS rank FROM (SELECT user_id, counted AS tool, count(*) AS n FROM counted GROUP BY ALL) QUALIFY rank <= 8",
      ["tool_calls"], [FIRST_CALLS, COUNTED])(lambda s, d: corpus.top_keys(corpus.merged_counts(tool_rows(s, d), "tool", ["user_id"]), "tool", ["user_id"]))
query("a21_top8_all", "tool:s n:l rank:l",
      "SELECT tool, n, row_number() OVER (ORDER BY n DESC, tool) AS rank FROM (SELECT counted AS tool, count(*) AS n FROM counted GROUP BY ALL) QUALIFY rank <= 8",
      ["tool_calls"], [FIRST_CALLS, COUNTED])(lambda s, d: corpus.top_keys(corpus.merged_counts(tool_rows(s, d), "tool"), "tool"))

WEIGHTED = ("(SELECT {k}, {p} AS v, sum({w}) OVER (PARTITION BY {k} ORDER BY {p} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum({w}) OVER (PARTITION BY {k}) AS tot FROM {t})")


def weighted(k, p, w, t):
    return f"(SELECT {k}, min(v) AS {p} FROM {WEIGHTED.format(k=k, p=p, w=w, t=t)} WHERE cum >= tot * 0.5 GROUP BY ALL)"


query("a20_weighted_percentile", "user_id:l p50:d",
      "SELECT user_id, min(v) AS p50 FROM (SELECT user_id, v, sum(w) OVER (PARTITION BY user_id ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(w) OVER (PARTITION BY user_id) AS tot "
      "FROM (SELECT user_id, value AS v, CAST(json_extract(props, '$.k') AS INTEGER) AS w FROM events) WHERE w > 0) WHERE cum >= tot * 0.5 GROUP BY 1")(
    lambda s, d: numeric.weighted_percentile(m.events(s, d), ["user_id"], "value", "k", 50, "p50"))
query("a23_pooled_turn_percentiles", "metric:s p50:d p90:d",
      f"SELECT metric, p50, p90 FROM {weighted('metric', 'p50', 'n', 'turn_pct')} a JOIN {weighted('metric', 'p90', 'n', 'turn_pct')} b USING (metric)", ["messages"], [TURNS, TURN_PCT])(
    lambda s, d: pooled_turns(s, d))


def pooled_turns(spark, d):
    rows = turn_rows(spark, d)
    pct = turns.turn_percentiles(rows).join(rows.groupBy("session_id").agg(F.count("*").alias("n")), "session_id")
    return corpus.pooled_percentiles(materialise(pct), "metric", "n")


query("a23_exact_turn_percentiles", "metric:s p50:d p90:d",
      "SELECT metric, list_extract(list_sort(list(v)), least(count(*), CAST(floor(0.5::DOUBLE * count(*)) AS BIGINT) + 1)) AS p50, "
      "list_extract(list_sort(list(v)), least(count(*), CAST(floor(0.9::DOUBLE * count(*)) AS BIGINT) + 1)) AS p90 FROM turn_long GROUP BY 1", ["messages"], [TURNS, TURN_PCT])(
    lambda s, d: corpus.exact_percentiles(
        turn_rows(s, d).select(F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).cast("double").alias("v")) for x in turns.METRICS])).alias("y")).select("y.*"), "metric", "v"))
query("a24_pooled_tool_durations", "tool:s calls:l total_sec:d p50_sec:d p90_sec:d share:d",
      f"SELECT tool, calls, total_sec, p50_sec, p90_sec, total_sec / sum(total_sec) OVER () AS share FROM (SELECT tool, sum(calls) AS calls, {dec('total_sec')} AS total_sec FROM tool_durations GROUP BY 1) "
      f"JOIN {weighted('tool', 'p50_sec', 'calls', 'tool_durations')} a USING (tool) JOIN {weighted('tool', 'p90_sec', 'calls', 'tool_durations')} b USING (tool)",
      ["tool_starts", "results"], [STARTS_AND_RESULTS, TOOL_DURATIONS])(
    lambda s, d: corpus.pooled_tool_durations(materialise(tools.tool_durations(timed_calls(s, d)))))
query("a25_worst_turns_corpus", "session_id:s turn_no:l tool_calls:l cost:d rank:l",
      "SELECT *, row_number() OVER (ORDER BY tool_calls DESC, session_id, turn_no) AS rank FROM turns WHERE CAST(regexp_extract(session_id, '^u([0-9]+)-', 1) AS BIGINT) % 12 NOT IN (3, 7) QUALIFY rank <= 5",
      ["messages"], [TURNS])(
    lambda s, d: corpus.worst_turns(turn_rows(s, d).withColumn("project", F.expr("concat('/proj-', cast(regexp_extract(session_id, '^u([0-9]+)-', 1) as bigint) % 12)")).withColumn(
        "is_analysis", filters.is_analysis(F.col("project"), MASK))))
query("a29_error_rate_table", "user_id:l tool:s calls:l errors:l rate:d",
      "SELECT *, errors::DOUBLE / calls AS rate FROM (SELECT CAST(regexp_extract(session_id, '^u([0-9]+)-', 1) AS BIGINT) AS user_id, rate_key AS tool, count(*) FILTER (outcome <> 'not_found') AS calls, "
      "count(*) FILTER (outcome = 'error') AS errors FROM outcomes GROUP BY ALL) WHERE calls >= 5", ["tool_calls", "results"], [OUTCOMES])(
    lambda s, d: corpus.error_rates(pairing.tool_outcomes(
        outcomes(s, d).withColumn("user_id", F.regexp_extract("session_id", r"^u(\d+)-", 1).cast("bigint")), ["user_id"])))
query("a30_worst_cache_sessions", "session_id:s tokens:l ratio:d rank:l",
      "SELECT *, row_number() OVER (ORDER BY ratio, session_id) AS rank FROM (SELECT session_id, input_tokens + cache_read_tokens AS tokens, cache_read_tokens / nullif(input_tokens + cache_read_tokens, 0) AS ratio FROM sessions "
      "WHERE user_id % 12 NOT IN (3, 7)) WHERE tokens >= 1000 QUALIFY rank <= 5", ["messages"], [SESSIONS])(
    lambda s, d: corpus.worst_cache_sessions(sessions(s, d).withColumn("is_analysis", filters.is_analysis(F.col("project_path"), MASK)), minimum=1000))
query("a31_churned_files", "path:s edits:l sessions:l rank:l",
      "SELECT *, row_number() OVER (ORDER BY edits DESC, path) AS rank FROM (SELECT path, count(*) AS edits, count(DISTINCT session_id) AS sessions FROM edit_rows GROUP BY 1) QUALIFY rank <= 10",
      ["tool_calls"], [FIRST_CALLS, COUNTED, EDITS])(lambda s, d: corpus.churned_files(tools.edits_by_file(edit_rows(s, d))))
query("a32_calendar", "user_id:l first_day:s last_day:s days_active:l sessions:l",
      "SELECT user_id, min(dd) AS first_day, max(dd) AS last_day, count(DISTINCT dd) AS days_active, count(*) AS sessions FROM (SELECT user_id, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d') AS dd FROM sessions) GROUP BY 1",
      ["messages"], [SESSIONS])(lambda s, d: corpus.calendar(sessions(s, d), ["user_id"]))
query("a32_projects", "project:s sessions:l", "SELECT regexp_replace(project_path, '.*/', '') AS project, count(*) AS sessions FROM sessions GROUP BY 1", ["messages"], [SESSIONS])(
    lambda s, d: corpus.project_counts(sessions(s, d)))
query("a16_response_medians", "median_reply_sec:d avg_reply_sec:d median_ttft_ms:d",
      "SELECT median(reply_sec) AS median_reply_sec, avg(reply_sec) AS avg_reply_sec, (SELECT median(x) FROM (SELECT median(ttft_ms) AS x FROM messages WHERE ttft_ms > 0 GROUP BY session_id) WHERE x > 0) AS median_ttft_ms FROM "
      "(SELECT is_human, (ts_ms - last_value(CASE WHEN role = 'assistant' THEN ts_ms END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1000.0 AS reply_sec FROM messages) "
      "WHERE is_human AND reply_sec > 2 AND reply_sec < 3600", ["messages"])(
    lambda s, d: corpus.response_medians(turns.reply_times(m.messages(s, d)), numeric.medians(m.messages(s, d).where("ttft_ms > 0"), ["session_id"], "ttft_ms", "median_ttft_ms")))

# --- prices, tiers, mismatch ----------------------------------------------------------

PRICED = MODEL_USAGE + (
    ", priced AS (SELECT *, CASE WHEN cost_input <> 0 AND input_tokens > 0 THEN floor(cost_input / input_tokens * 1e6 * 10000 + 0.5) / 10000 ELSE 0 END AS input_per_mtok, "
    "CASE WHEN cost_output <> 0 AND output_tokens > 0 THEN floor(cost_output / output_tokens * 1e6 * 10000 + 0.5) / 10000 ELSE 0 END AS output_per_mtok FROM model_usage), "
    "med AS (SELECT list_extract(list_sort(list(input_per_mtok)), CAST(floor(count(*) / 2) AS BIGINT) + 1) AS mid FROM priced WHERE input_per_mtok > 0), "
    "tiers AS (SELECT priced.*, CASE WHEN input_tokens + output_tokens > 10000 AND cost < 0.01 THEN 'subscription' WHEN input_per_mtok = 0 AND cost > 0 THEN 'mid' "
    "WHEN input_per_mtok = 0 AND message_count > 20 THEN 'subscription' WHEN input_per_mtok = 0 THEN 'low' WHEN input_per_mtok > mid * 3 THEN 'high' WHEN input_per_mtok < mid * 0.4 THEN 'low' ELSE 'mid' END AS tier FROM priced, med)"
)


def model_tiers(spark, d):
    return usage.model_tiers(usage.list_price(usage.usage_by_model(m.usage_events(spark, d))))


query("a33_list_price", "model:s input_per_mtok:d output_per_mtok:d", "SELECT * FROM priced", ["usage_events"], [PRICED])(
    lambda s, d: usage.list_price(usage.usage_by_model(m.usage_events(s, d))))
query("a34_model_tier", "model:s tier:s", "SELECT * FROM tiers", ["usage_events"], [PRICED])(model_tiers)

# Brands by part and lineitem: a usage table with one row per line of an order.
BRAND_COLUMNS = {"model": "p_brand", "session_id": "cast(l_orderkey as varchar(20))", "input": "l_quantity * 1000", "output": "l_quantity * 100",
                 "cost": "l_extendedprice / 1000", "cost_input": "l_extendedprice * (l_suppkey % 9) / 100000", "cost_output": "l_extendedprice / 10000"}


def brand_usage(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return line.join(part, line.l_partkey == part.p_partkey).select(*[F.expr(e).alias(n) for n, e in BRAND_COLUMNS.items()])


BRANDS = ("usage_events AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in BRAND_COLUMNS.items()) + " FROM lineitem JOIN part ON l_partkey = p_partkey), " + PRICED)
query("a34_brand_tiers", "model:s input_per_mtok:d output_per_mtok:d tier:s message_count:l sessions:l", "SELECT * FROM tiers", [], [BRANDS])(
    lambda s, d: usage.model_tiers(usage.list_price(usage.usage_by_model(brand_usage(s, d)))))

SESSION_MODELS = f"session_models AS (SELECT session_id, model, {dec('cost')} AS cost, count(*) AS message_count FROM usage_events GROUP BY ALL)"
MISMATCH = PRICED + ", " + SESSION_MODELS + (
    ", prim AS (SELECT * FROM session_models QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY cost DESC, model) = 1), "
    "jn AS (SELECT s.session_id, s.user_message_count AS u, s.duration_minutes AS dm, f.outcome, f.session_type AS st, p.model, p.cost AS model_cost, p.message_count AS mc, t.tier FROM sessions s JOIN facets f USING (session_id) JOIN prim p USING (session_id) JOIN tiers t ON t.model = p.model), "
    "cl AS (SELECT *, st IN ('quick_question', 'single_task') OR (u <= 3 AND dm < 5) AS simple, st IN ('multi_task', 'iterative_refinement') OR u > 8 AS cplx, outcome IN ('not_achieved', 'partially_achieved') AS poor, outcome IN ('fully_achieved', 'mostly_achieved') AS good FROM jn), "
    "fl AS (SELECT *, CASE WHEN tier = 'subscription' THEN CASE WHEN simple AND good AND mc > 3 AND regexp_matches(model, 'medium|large|pro|opus|o[13]') AND NOT regexp_matches(model, 'small|mini|flash|haiku|lite') THEN 'quota_pressure' END "
    "WHEN tier = 'high' AND simple AND good THEN 'overspend' WHEN tier = 'low' AND cplx AND poor THEN 'underspend' WHEN tier = 'high' AND poor AND model_cost > 0.1 THEN 'overspend' END AS flag FROM cl), "
    "mismatch AS (SELECT *, CASE WHEN tier = 'subscription' THEN 0 WHEN tier = 'high' AND simple AND good THEN model_cost * 0.8 WHEN flag = 'underspend' THEN model_cost WHEN flag = 'overspend' THEN model_cost * 0.5 ELSE 0 END AS waste FROM fl WHERE flag IS NOT NULL)"
)


def session_models(spark, d):
    return m.usage_events(spark, d).groupBy("session_id", "model").agg(numeric.exact_sum(F.col("cost")).alias("cost"), F.count("*").alias("message_count"))


def mismatch(spark, d):
    return usage.model_mismatch(sessions(spark, d).withColumn("files_modified", F.lit(0)), m.facets(spark, d), session_models(spark, d), model_tiers(spark, d))


query("a35_model_mismatch", "session_id:s model:s tier:s flag:s model_cost:d waste:d", "SELECT * FROM mismatch", ["messages", "usage_events", "facets"], [SESSIONS, MISMATCH])(mismatch)
query("a35_top_flags", "session_id:s flag:s model_cost:d rank:l",
      "SELECT *, row_number() OVER (ORDER BY model_cost DESC, session_id) AS rank FROM mismatch QUALIFY rank <= 20", ["messages", "usage_events", "facets"], [SESSIONS, MISMATCH])(
    lambda s, d: usage.top_rows(mismatch(s, d), [], [F.desc("model_cost"), F.asc("session_id")], 20))

# --- labels ---------------------------------------------------------------------------

# Label files: whole, without an outcome, cut off, no object, with friction keys of several spellings.
def facet_lines(spark, d):
    doc = table(spark, d, "documents")
    name = F.concat(F.lit("s"), "doc_id")
    whole = F.to_json(F.struct(name.alias("session_id"), F.concat(F.lit("did "), "lang").alias("brief_summary"), F.when(F.col("doc_id") % 5 != 1, "done").alias("outcome"),
                               F.when(F.col("doc_id") % 5 == 4, F.create_map(F.lit("Wrong Approach"), F.col("doc_id") % 3, F.lit("approach-wrong"), F.lit(2), F.lit("bug_fixed"), F.lit(9))).alias("friction_counts")))
    kind = F.col("doc_id") % 5
    return doc.select(F.when(kind == 2, F.substr(whole, F.lit(1), F.length(whole) - 4)).when(kind == 3, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole).alias("value"))


query("s10_facet_status", "status:s n:l",
      "SELECT s.status, count(d.status) AS n FROM (VALUES ('valid'), ('incomplete'), ('broken')) s(status) LEFT JOIN (SELECT CASE WHEN doc_id % 5 IN (2, 3) THEN 'broken' WHEN doc_id % 5 = 1 OR lang IS NULL THEN 'incomplete' ELSE 'valid' END AS status FROM documents) d USING (status) GROUP BY 1")(
    lambda s, d: facet_files.facet_status(facet_files.parse_facets(facet_lines(s, d))))
query("s10_facet_counts", "session_id:s dim:s key:s n:d",
      "SELECT concat('s', doc_id) AS session_id, 'friction' AS dim, 'wrong_approach' AS key, doc_id % 3 + 2 AS n FROM documents WHERE doc_id % 5 = 4 AND lang IS NOT NULL")(
    lambda s, d: facet_files.facet_counts(facet_files.parse_facets(facet_lines(s, d))))
query("s10_valid_facets", "session_id:s outcome:s", "SELECT * FROM facets WHERE brief_summary <> ''", ["facets"])(lambda s, d: labels.valid_facets(m.facets(s, d)))
query("j08_sessions_with_facets", "session_id:s user_message_count:l outcome:s has_facets:l",
      "SELECT s.session_id, s.user_message_count, f.outcome, CASE WHEN f.session_id IS NULL THEN 0 ELSE 1 END AS has_facets FROM sessions s LEFT JOIN (SELECT * FROM facets WHERE brief_summary <> '') f USING (session_id)",
      ["messages", "facets"], [SESSIONS])(
    lambda s, d: sessions(s, d).join(labels.valid_facets(m.facets(s, d)).select("session_id", "outcome"), "session_id", "left").withColumn("has_facets", F.col("outcome").isNotNull()))
GIVEN = "CASE k % 3 WHEN 0 THEN 'agent_too_slow' WHEN 1 THEN '' ELSE 'agent_wrong_direction' END"
query("j09_abort_label_override", "abort_label:s n:l",
      f"SELECT CASE WHEN coalesce(g.label, '') <> '' THEN g.label ELSE a.label END AS abort_label, count(*) AS n FROM aborts a LEFT JOIN (SELECT session_id, ts_ms, {GIVEN} AS label FROM ev WHERE event_type = 'view' AND k % 10 = 3 AND k % 4 < 2) g USING (session_id, ts_ms) GROUP BY 1",
      ["messages", "tool_calls"], [ABORTS])(
    lambda s, d: labels.abort_labels(abort_rows(s, d), m.events(s, d).where("event_type = 'view' and k % 10 = 3 and k % 4 < 2").select("session_id", "ts_ms", F.expr(GIVEN).alias("label"))))

TOKENS = "regexp_extract_all(lower(key), '([a-z0-9]+)', 1)"
SING = "list_transform(tok, lambda t: CASE WHEN length(t) > 3 AND ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN t[:-2] ELSE t END)"
CANON = " ".join(f"WHEN '{'_'.join(sorted(k.split('_')))}' THEN '{k}'" for k in labels.FRICTION_LABELS)


def normal(src, keys, n, name):
    k = ", ".join(keys)
    return (
        f"{name}_a AS (SELECT {k}, {TOKENS} AS tok, {n} AS n FROM {src} WHERE {n} > 0), "
        f"{name}_b AS (SELECT {k}, n, array_to_string(tok, '_') AS sp, CASE array_to_string(list_sort(tok), '_') {CANON} END AS kn, array_to_string(list_sort({SING}), '_') AS gr FROM {name}_a "
        "WHERE len(tok) > 0 AND NOT list_has_any(tok, ['resolved', 'fixed', 'success', 'succeeded', 'solved', 'worked'])), "
        f"{name}_c AS (SELECT {k}, min(coalesce(kn, sp)) AS key, sum(n) AS n FROM {name}_b GROUP BY {k}, CASE WHEN kn IS NOT NULL THEN '=' || kn ELSE gr END), "
        f"{name} AS (SELECT {k}, key, sum(n) AS n FROM {name}_c GROUP BY {k}, key)"
    )


FRICTION = "fr AS (SELECT * FROM facet_counts WHERE dim = 'friction')"


def friction(spark, d):
    return m.facet_counts(spark, d).where("dim = 'friction'")


query("a27_normalised_keys", "session_id:s key:s n:d", "SELECT * FROM nk", ["facet_counts"], [FRICTION, normal("fr", ["session_id"], "n", "nk")])(
    lambda s, d: labels.normalise_keys(friction(s, d), ["session_id"]))
query("a27_merged_keys", "user_id:l key:s n:d", "SELECT * FROM n2",
      ["facet_counts"], [FRICTION, normal("fr", ["user_id", "session_id"], "n", "n1"), "mg AS (SELECT user_id, key, sum(n) AS n FROM n1 GROUP BY ALL)", normal("mg", ["user_id"], "n", "n2")])(
    lambda s, d: labels.merge_friction(friction(s, d), ["user_id", "session_id"], ["user_id"]))
WEIGHTS = "wt AS (SELECT c.*, exp(-ln(2) / 864000000.0 * (x.latest - c.start_ms)) AS w FROM facet_counts c JOIN (SELECT user_id, max(start_ms) AS latest FROM facet_counts GROUP BY 1) x USING (user_id))"
query("a26_decayed_labels", "user_id:l dim:s key:s n:d",
      "SELECT user_id, dim, key, sum(n * w) AS n FROM wt WHERE dim <> 'friction' AND n > 0 GROUP BY ALL UNION ALL SELECT user_id, 'friction', key, n FROM n2", ["facet_counts"],
      [WEIGHTS, "wf AS (SELECT * FROM wt WHERE dim = 'friction')", normal("wf", ["user_id", "session_id", "w"], "n", "n1"), "mg AS (SELECT user_id, key, sum(n * w) AS n FROM n1 GROUP BY ALL)", normal("mg", ["user_id"], "n", "n2")])(
    lambda s, d: labels.weighted_counts(m.facet_counts(s, d), ["user_id"]))
DIMS = ["session_type", "helpfulness", "primary_success"]
query("a26_decayed_single_labels", "user_id:l dim:s key:s n:d",
      "SELECT user_id, dim, key, sum(exp(-ln(2) / 864000000.0 * (latest - start_ms))) AS n FROM (UNPIVOT (SELECT user_id, start_ms, latest, session_type, helpfulness, primary_success FROM facets JOIN (SELECT user_id, max(start_ms) AS latest FROM facets GROUP BY 1) USING (user_id)) "
      "ON session_type, helpfulness, primary_success INTO NAME dim VALUE key) WHERE NOT (dim = 'primary_success' AND key = 'none') GROUP BY ALL", ["facets"])(
    lambda s, d: labels.decay_weights(m.facets(s, d), ["user_id"]).transform(lambda f: labels.single_labels(f, DIMS)).groupBy("user_id", "dim", "key").agg(F.sum("weight").alias("n")))
query("a26_outcome_counts", "user_id:l outcome:s n:l share:d",
      "SELECT user_id, outcome, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id) AS share FROM facets GROUP BY user_id, outcome", ["facets"])(
    lambda s, d: labels.outcome_counts(m.facets(s, d), ["user_id"]))
query("a36_narrative_lists", "user_id:l list:s session_id:s entry:s",
      "SELECT user_id, 'summary' AS list, session_id, brief_summary AS entry FROM (SELECT * FROM facets WHERE brief_summary <> '' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start_ms DESC, session_id DESC) <= 50) "
      "UNION ALL SELECT user_id, 'friction_detail', session_id, friction_detail FROM (SELECT * FROM facets WHERE trim(friction_detail) <> '' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start_ms, session_id) <= 20)",
      ["facets"])(lambda s, d: labels.narrative_lists(m.facets(s, d), ["user_id"]))

# --- trends ---------------------------------------------------------------------------

RN = "rn AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY start_ms, session_id) AS pos, count(*) OVER (PARTITION BY owner) AS n FROM order_sessions)"
WEEKS = ("wk AS (SELECT o.*, CASE WHEN now_ms - start_ms < 604800000 THEN 'this_week' WHEN now_ms - start_ms < 1209600000 THEN 'last_week' END AS band FROM order_sessions o JOIN (SELECT owner, max(start_ms) AS now_ms FROM order_sessions GROUP BY 1) USING (owner))")
query("w1_week_over_week", "owner:l band:s sessions:l avg_cost:d errors_per_session:d primary_model:s",
      f"SELECT owner, band, count(*) AS sessions, {dec('cost')} / count(*) AS avg_cost, {dec('errors')} / count(*) AS errors_per_session, any_value(pm) AS primary_model FROM wk "
      "JOIN (SELECT owner, band, model AS pm FROM wk WHERE band IS NOT NULL GROUP BY owner, band, model QUALIFY row_number() OVER (PARTITION BY owner, band ORDER BY count(*) DESC, model) = 1) USING (owner, band) WHERE band IS NOT NULL GROUP BY owner, band",
      ["order_sessions"], [WEEKS])(lambda s, d: trends.week_summary(m.order_sessions(s, d), ["owner"]))


def mean(c, cond):
    return f"{dec(f'CASE WHEN {cond} THEN {c} END')} / count(*) FILTER ({cond})"


PCT = "floor(({a} - {b}) / (CASE WHEN {b} = 0 THEN 1 ELSE {b} END) * 100 + 0.5)"
RAW_MEANS = (
    f"SELECT owner, count(*) FILTER (pos > n - 20) AS recent_n, count(*) FILTER (pos <= n - 20) AS older_n, {mean('cost', 'pos > n - 20')} AS rc, {mean('cost', 'pos <= n - 20')} AS oc, "
    f"{mean('errors', 'pos > n - 20')} AS re, {mean('errors', 'pos <= n - 20')} AS oe FROM rn GROUP BY 1"
)
# Both windows need 20 sessions; below that there is no trend and no figure.
query("w2_trajectory", "owner:l recent_n:l older_n:l cost_trend:s errors_trend:s recent_mean_cost:d older_mean_cost:d cost_pct:d errors_pct:d",
      "SELECT owner, recent_n, older_n, CASE WHEN NOT ok THEN 'insufficient' WHEN rc > oc * 1.2 THEN 'increasing' WHEN rc < oc * 0.8 THEN 'decreasing' ELSE 'stable' END AS cost_trend, "
      "CASE WHEN NOT ok THEN 'insufficient' WHEN re > oe * 1.2 THEN 'increasing' WHEN re < oe * 0.8 THEN 'decreasing' ELSE 'stable' END AS errors_trend, "
      "CASE WHEN ok THEN rc END AS recent_mean_cost, CASE WHEN ok THEN oc END AS older_mean_cost, CASE WHEN ok THEN " + PCT.format(a="rc", b="oc") + " END AS cost_pct, CASE WHEN ok THEN "
      + PCT.format(a="re", b="oe") + f" END AS errors_pct FROM (SELECT *, recent_n >= 20 AND older_n >= 20 AS ok FROM ({RAW_MEANS}))", ["order_sessions"], [RN])(
    lambda s, d: trends.trajectory(m.order_sessions(s, d), ["owner"]))
query("w3_anomalies", "owner:l session_id:l pos:l cost:d errors:l rank:l",
      "SELECT *, row_number() OVER (PARTITION BY owner ORDER BY cost DESC, pos) AS rank FROM (SELECT *, avg(cost) OVER w AS ac, avg(errors) OVER w AS ae FROM rn WINDOW w AS (PARTITION BY owner ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) "
      "WHERE pos > 5 AND ((cost > ac * 3 AND cost > 10) OR (errors > ae * 3 AND errors > 10)) QUALIFY rank <= 5", ["order_sessions"], [RN])(
    lambda s, d: trends.anomalies(m.order_sessions(s, d), ["owner"]))
MODES = (
    "win AS (SELECT a.owner, a.pos AS ix, b.model, b.pos, b.pos < a.pos AS before_ FROM rn a JOIN rn b ON a.owner = b.owner AND b.pos BETWEEN a.pos - 10 AND a.pos + 9 WHERE a.pos > 10), "
    "md AS (SELECT owner, ix, before_, model FROM win GROUP BY owner, ix, before_, model QUALIFY row_number() OVER (PARTITION BY owner, ix, before_ ORDER BY count(*) DESC, min(pos)) = 1), "
    "ok AS (SELECT b.owner, b.ix, b.model AS before_model, a.model AS after_model FROM md b JOIN md a ON a.owner = b.owner AND a.ix = b.ix AND b.before_ AND NOT a.before_ WHERE b.model <> a.model AND b.ix <= (SELECT max(n) FROM rn r WHERE r.owner = b.owner) - 4), "
    "lt AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY owner ORDER BY ix DESC) = 1), "
    "sw AS (SELECT lt.owner, before_model, after_model, least(lt.ix, greatest(coalesce((SELECT max(pos) FROM rn r WHERE r.owner = lt.owner AND r.pos < lt.ix AND r.model <> lt.after_model), 0) + 1, 2)) AS pos FROM lt)"
)
query("w4_major_transition", "owner:l pos:l before_model:s after_model:s when_ms:l",
      "SELECT sw.*, rn.start_ms AS when_ms FROM sw JOIN rn ON rn.owner = sw.owner AND rn.pos = sw.pos", ["order_sessions"], [RN, MODES])(
    lambda s, d: trends.transitions(m.order_sessions(s, d), ["owner"]))
query("w5_before_after", "owner:l basis:s before_n:l after_n:l before_cost:d after_cost:d cost_pct:d errors_pct:d insufficient:l cost_headline:l errors_headline:l",
      "SELECT *, CASE WHEN NOT ins AND abs(cost_pct) > 15 THEN 1 ELSE 0 END AS cost_headline, CASE WHEN NOT ins AND abs(errors_pct) > 20 THEN 1 ELSE 0 END AS errors_headline, CASE WHEN ins THEN 1 ELSE 0 END AS insufficient FROM (SELECT *, before_n < 20 OR after_n < 20 AS ins, "
      + PCT.format(a="after_cost", b="before_cost") + " AS cost_pct, " + PCT.format(a="ae", b="be") + " AS errors_pct FROM ("
      f"SELECT owner, basis, count(*) FILTER (side = 'b') AS before_n, count(*) FILTER (side = 'a') AS after_n, {mean('cost', chr(39).join(['side = ', 'b', '']))} AS before_cost, {mean('cost', chr(39).join(['side = ', 'a', '']))} AS after_cost, "
      f"{mean('errors', chr(39).join(['side = ', 'b', '']))} AS be, {mean('errors', chr(39).join(['side = ', 'a', '']))} AS ae FROM ("
      "SELECT rn.*, 'model_switch' AS basis, CASE WHEN rn.pos < sw.pos THEN 'b' ELSE 'a' END AS side FROM rn JOIN sw ON rn.owner = sw.owner AND rn.pos BETWEEN sw.pos - 20 AND sw.pos + 19 "
      "UNION ALL SELECT rn.*, 'week_over_week', CASE WHEN now_ms - start_ms < 604800000 THEN 'a' ELSE 'b' END FROM rn JOIN (SELECT owner, max(start_ms) AS now_ms FROM rn GROUP BY 1) USING (owner) WHERE now_ms - start_ms < 1209600000 AND owner NOT IN (SELECT owner FROM sw)"
      ") GROUP BY owner, basis) WHERE before_n > 0 AND after_n > 0)", ["order_sessions"], [RN, MODES])(
    lambda s, d: trends.deltas(m.order_sessions(s, d), ["owner"]))
query("w7_staleness", "owner:l staleness_pct:d",
      f"SELECT owner, CASE WHEN flat > 0 THEN abs((rc - flat) / flat * 100) ELSE 0 END AS staleness_pct FROM (SELECT owner, {dec('cost')} / count(*) AS flat, {mean('cost', 'pos > n - 10')} AS rc FROM rn GROUP BY 1)",
      ["order_sessions"], [RN])(lambda s, d: trends.staleness(m.order_sessions(s, d), ["owner"]))

STATUS_SQL = [
    FRICTION, "lts AS (SELECT user_id, max(start_ms) AS latest_ms FROM fr GROUP BY 1)",
    "sd AS (SELECT fr.*, start_ms >= latest_ms - 604800000 AS recent FROM fr JOIN lts USING (user_id))",
    normal("sd", ["user_id", "recent", "session_id"], "n", "s1"), "sm AS (SELECT user_id, recent, key, sum(n) AS n FROM s1 GROUP BY ALL)", normal("sm", ["user_id", "recent"], "n", "s2"),
    "sw2 AS (SELECT user_id, key, coalesce(sum(n) FILTER (recent), 0) AS recent_n, coalesce(sum(n) FILTER (NOT recent), 0) AS older_n FROM s2 GROUP BY ALL)",
    "cur AS (SELECT DISTINCT user_id, key FROM fr WHERE n > 0 AND key = 'wrong approach')",
]


def friction_status(spark, d):
    counts = friction(spark, d)
    latest = counts.groupBy("user_id").agg(F.max("start_ms").alias("latest_ms"))
    current = counts.where("key = 'wrong approach'").select("user_id", F.lit("wrong_approach").alias("key"), "n").groupBy("user_id", "key").agg(F.sum("n").alias("n"))
    return labels.friction_status(counts.drop("dim"), latest, current, ["user_id"], since_days=14)


query("w6_resolved_and_ongoing", "user_id:l key:s recent_n:d older_n:d status:s",
      "SELECT s.*, CASE WHEN recent_n > 0 THEN 'ongoing' ELSE 'resolved' END AS status FROM sw2 s WHERE recent_n > 0 OR NOT (key = 'wrong_approach' AND user_id IN (SELECT user_id FROM cur))",
      ["facet_counts"], STATUS_SQL)(friction_status)
query("w6_capped_status", "user_id:l key:s status:s rank:l",
      "SELECT *, row_number() OVER (PARTITION BY user_id, status ORDER BY recent_n DESC, key) AS rank FROM (SELECT s.*, CASE WHEN recent_n > 0 THEN 'ongoing' ELSE 'resolved' END AS status FROM sw2 s "
      "WHERE recent_n > 0 OR NOT (key = 'wrong_approach' AND user_id IN (SELECT user_id FROM cur))) QUALIFY rank <= CASE status WHEN 'resolved' THEN 5 ELSE 8 END",
      ["facet_counts"], STATUS_SQL)(lambda s, d: labels.capped_friction(friction_status(s, d), ["user_id"]))

# --- facts ----------------------------------------------------------------------------


def user_totals(spark, d):
    return corpus.interruption_rate(corpus.corpus_totals(sessions(spark, d), ["user_id"]))


def all_facts(spark, d):
    """Facts per user: totals, activity, outcomes, projects."""
    totals = user_totals(spark, d)
    total = facts.total_facts(totals, ["user_id"])
    named = facts.named_facts(
        ["user_id"], hours=hours(spark, d).join(totals.select("user_id", "sessions"), "user_id"), outcomes=labels.outcome_counts(m.facets(spark, d), ["user_id"]),
    )
    return total.unionByName(named)


ONE = "floor(({x}) * 10 + 0.5) / 10"
TWO = "floor(({x}) * 100 + 0.5) / 100"
FACTS = (
    "fin AS (SELECT *, aborted_generations - aborted_at_session_end + steering_messages AS intr FROM totals), "
    "facts AS (SELECT user_id, 'sessions' AS fact_id, sessions::DOUBLE AS value, 'count' AS unit, sessions AS n FROM fin "
    "UNION ALL SELECT user_id, 'messages', user_message_count, 'count', sessions FROM fin "
    "UNION ALL SELECT user_id, 'interruptions', intr, 'count', user_message_count FROM fin "
    "UNION ALL SELECT user_id, 'interruptions.aborted', aborted_generations - aborted_at_session_end, 'count', user_message_count FROM fin "
    "UNION ALL SELECT user_id, 'interruptions.steered', steering_messages, 'count', user_message_count FROM fin "
    "UNION ALL SELECT user_id, 'interruption_rate', " + ONE.format(x="CASE WHEN user_message_count > 0 THEN intr::DOUBLE / user_message_count ELSE 0 END * 100") + ", 'pct', user_message_count FROM fin "
    "UNION ALL SELECT user_id, 'cache_hit_ratio', " + ONE.format(x="CASE WHEN input_tokens + cache_read_tokens > 0 THEN cache_read_tokens / (input_tokens + cache_read_tokens) ELSE 0 END * 100") + ", 'pct', sessions FROM fin "
    "UNION ALL SELECT user_id, 'total_cost', " + TWO.format(x="total_cost") + ", 'usd', sessions FROM fin "
    "UNION ALL SELECT user_id, 'cost_per_session', " + TWO.format(x="total_cost / sessions") + ", 'usd', sessions FROM fin "
    "UNION ALL SELECT user_id, concat('outcome_share.', outcome), " + ONE.format(x="share * 100") + ", 'pct', whole FROM (SELECT user_id, outcome, (sum(count(*)) OVER (PARTITION BY user_id))::BIGINT AS whole, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id) AS share FROM facets GROUP BY user_id, outcome) "
    "UNION ALL SELECT user_id, 'success_rate', " + ONE.format(x="count(*) FILTER (outcome IN ('fully_achieved', 'mostly_achieved'))::DOUBLE / count(*) * 100") + ", 'pct', count(*) FROM facets GROUP BY user_id "
    "UNION ALL SELECT user_id, 'active_hours', " + ONE.format(x="h") + ", 'hours', sessions FROM (SELECT user_id, sum(hours) AS h FROM hours GROUP BY 1) JOIN fin USING (user_id) "
    "UNION ALL SELECT user_id, 'active_hours_per_day', " + ONE.format(x="h / c") + ", 'hours', c FROM (SELECT user_id, sum(hours) AS h, count(*) AS c FROM hours GROUP BY 1))"
)
FACT_TABLES = ["messages", "facets"]
FACT_CTES = [SESSIONS, TOTAL_CTE, RUNS.format(gap=GAP), DAYS, FACTS]
query("a38_facts", "user_id:l fact_id:s value:d unit:s n:l", "SELECT * FROM facts", FACT_TABLES, FACT_CTES)(all_facts)

# Texts with figures made from the row keys, checked against the facts of one user each.
PROSE = "concat(text, ' up ', doc_id % 90, '.', doc_id % 10, '% to ', doc_id % 7, '-', doc_id % 40, '% and $', doc_id % 1000 + 1, '.', doc_id % 10, CASE WHEN doc_id % 5 = 0 THEN 'k' ELSE '' END, ' spent $', doc_id % 30)"


def prose(spark, d):
    users = 150
    return table(spark, d, "documents").select((F.col("doc_id") % users).alias("user_id"), "doc_id", F.expr(PROSE).alias("text"))


NUM = r"(\d[\d,]*(?:\.\d+)?)"
QUOTES = (
    f"prose AS (SELECT doc_id % 150 AS user_id, doc_id, {PROSE} AS text FROM documents), "
    f"pm AS (SELECT user_id, doc_id, unnest(regexp_extract_all(text, '{NUM}(?:\\s*(?:-|to)\\s*{NUM})?\\s*%', 1)) AS a, unnest(regexp_extract_all(text, '{NUM}(?:\\s*(?:-|to)\\s*{NUM})?\\s*%', 2)) AS b FROM prose), "
    f"um AS (SELECT user_id, doc_id, unnest(regexp_extract_all(text, '\\$\\s?{NUM}\\s*([kKmM]\\b)?', 1)) AS a, unnest(regexp_extract_all(text, '\\$\\s?{NUM}\\s*([kKmM]\\b)?', 2)) AS b FROM prose), "
    "quotes AS (SELECT user_id, doc_id, 'pct' AS unit, CAST(replace(x, ',', '') AS DOUBLE) AS value, 0.0::DOUBLE AS slack FROM (SELECT user_id, doc_id, unnest([a, b]) AS x FROM pm) WHERE x <> '' "
    "UNION ALL SELECT user_id, doc_id, 'usd', CAST(replace(a, ',', '') AS DOUBLE) * sc, 0.5 * pow(10.0, -length(regexp_extract(a, '\\.(\\d+)$', 1))) * sc FROM (SELECT *, CASE lower(b) WHEN 'k' THEN 1000.0::DOUBLE WHEN 'm' THEN 1000000.0::DOUBLE ELSE 1.0::DOUBLE END AS sc FROM um))"
)
query("j18_quoted_figures", "doc_id:l unit:s value:d slack:d", "SELECT * FROM quotes", [], [QUOTES])(lambda s, d: facts.quoted_figures(prose(s, d), ["user_id", "doc_id"]))
query("j18_unbacked_figures", "user_id:l doc_id:l unit:s value:d",
      "SELECT * FROM quotes q WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.user_id = q.user_id AND f.unit = q.unit AND abs(abs(f.value) - q.value) <= CASE WHEN q.unit = 'pct' THEN 1 ELSE greatest(abs(f.value) * 0.01, slack) END)",
      FACT_TABLES, [*FACT_CTES, QUOTES])(
    lambda s, d: facts.unbacked_figures(facts.quoted_figures(prose(s, d), ["user_id", "doc_id"]), materialise(all_facts(s, d)), ["user_id"]))
