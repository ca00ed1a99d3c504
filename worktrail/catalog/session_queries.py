"""Queries over single sessions: pairing, usage, tools, turns, activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.catalog import mapping as m
from worktrail.catalog.mapping import dec, table
from worktrail.catalog.registry import query
from worktrail.functions import numeric
from worktrail.operators import activity, pairing, tools, turns, usage
from worktrail.operators.scan import SEQ_CHUNK, by_width

# --- pairing -------------------------------------------------------------------

STARTS_AND_RESULTS = (
    "u AS (SELECT session_id, call_id, seq, 1 AS is_start, started_ms, tool, CAST(NULL AS BIGINT) AS ts_ms FROM tool_starts "
    "UNION ALL SELECT session_id, call_id, seq, 0, NULL, NULL, ts_ms FROM results WHERE call_id <> ''), "
    "l AS (SELECT *, lag(is_start) OVER w AS p, lag(started_ms) OVER w AS ps, lag(tool) OVER w AS pt FROM u "
    "WINDOW w AS (PARTITION BY session_id, call_id ORDER BY seq)), "
    "timed AS (SELECT session_id, call_id, seq, pt AS tool, ps AS started_ms, ts_ms, greatest(0, (ts_ms - ps) / 1000.0) AS duration_sec "
    "FROM l WHERE is_start = 0 AND p = 1)"
)


def timed_calls(spark, d):
    return pairing.timed_calls(m.tool_starts(spark, d), m.results(spark, d))


query("j01_start_result_pairing", "session_id:s call_id:s seq:l tool:s started_ms:l ts_ms:l duration_sec:d",
      "SELECT * FROM timed", ["tool_starts", "results"], [STARTS_AND_RESULTS])(timed_calls)


def calls_with_use(spark, d):
    """Calls by id with whether the code drives a browser."""
    return m.tool_calls(spark, d).withColumn("drives_browser", (F.col("tool") == "eval") & F.col("code").contains("browser."))


def outcomes(spark, d):
    return pairing.call_outcomes(calls_with_use(spark, d), m.results(spark, d))


TITLE = "CASE tool WHEN 'bash' THEN 'Shell Failed' WHEN 'read' THEN 'Read Failed' WHEN 'eval' THEN 'Eval Failed' WHEN 'wait' THEN 'Wait Failed' WHEN 'mcp__srv_x' THEN 'MCP: srv' END"
OUTCOMES = (
    "first_call AS (SELECT session_id, call_id, min(seq) AS call_seq, arg_min(CASE WHEN tool = 'eval' AND contains(code, 'browser.') THEN 1 ELSE 0 END, (seq, idx)) AS br "
    "FROM tool_calls GROUP BY 1, 2), "
    "known AS (SELECT r.session_id, r.tool, r.is_error, r.text, c.br FROM results r JOIN first_call c USING (session_id, call_id) "
    "WHERE c.call_seq < r.seq QUALIFY row_number() OVER (PARTITION BY r.session_id, r.call_id ORDER BY r.seq DESC) = 1), "
    "free AS (SELECT session_id, tool, is_error, text, 0 AS br FROM results WHERE call_id = ''), "
    "both_ AS (SELECT * FROM known UNION ALL SELECT * FROM free), "
    "outcomes AS (SELECT session_id, CASE WHEN is_error AND starts_with(text, 'Tool xd_') THEN split_part(text, ' ', 2) "
    "WHEN tool = 'eval' AND br = 1 THEN 'browser' ELSE tool END AS rate_key, "
    "CASE WHEN NOT is_error THEN 'ok' WHEN starts_with(text, 'Tool xd_') THEN 'not_found' ELSE 'error' END AS outcome, "
    f"CASE WHEN is_error AND NOT starts_with(text, 'Tool xd_') THEN CASE WHEN tool = 'eval' AND br = 1 THEN 'Browser Failed' ELSE {TITLE} END END AS category FROM both_)"
)
query("j02_latest_outcome_wins", "session_id:s rate_key:s outcome:s category:s n:l",
      "SELECT session_id, rate_key, outcome, category, count(*) AS n FROM outcomes GROUP BY ALL", ["tool_calls", "results"], [OUTCOMES])(
    lambda s, d: outcomes(s, d).groupBy("session_id", "rate_key", "outcome", "category").agg(F.count("*").alias("n")))

DELIVERED = (
    "u AS (SELECT session_id, call_id, seq, 1 AS is_start, started_ms, tool, CAST(NULL AS BIGINT) AS ts_ms, '' AS text FROM tool_starts "
    "UNION ALL SELECT session_id, call_id, seq, 0, NULL, NULL, ts_ms, text FROM results WHERE call_id <> ''), "
    "s1 AS (SELECT *, last_value(CASE WHEN is_start = 1 THEN seq END IGNORE NULLS) OVER w AS start_seq, "
    "last_value(CASE WHEN is_start = 0 AND NOT contains(text, 'Backgrounded as job') THEN seq END IGNORE NULLS) OVER w AS closed FROM u "
    "WINDOW w AS (PARTITION BY session_id, call_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "live AS (SELECT * FROM s1 WHERE is_start = 0 AND start_seq IS NOT NULL AND (closed IS NULL OR closed < start_seq)), "
    "delivered AS (SELECT v.session_id, v.call_id, t.tool, t.started_ms, v.ts_ms, v.seq, v.text FROM live v "
    "JOIN tool_starts t ON t.session_id = v.session_id AND t.call_id = v.call_id AND t.seq = v.start_seq "
    "QUALIFY row_number() OVER (PARTITION BY v.session_id, v.call_id, v.start_seq ORDER BY v.seq DESC) = 1)"
)
query("j03_replaceable_delivery", "session_id:s call_id:s tool:s started_ms:l ts_ms:l seq:l",
      "SELECT * FROM delivered", ["tool_starts", "results"], [DELIVERED])(
    lambda s, d: pairing.delivered_calls(m.tool_starts(s, d), m.results(s, d)))

# --- usage ----------------------------------------------------------------------

query("a01_usage_totals", "session_id:s input:d output:d cache_read:d cache_write:d cost:d cost_input:d cost_output:d utility_cost:d",
      "SELECT session_id, " + ", ".join(f"{dec(c)} AS {c}" for c in usage.SUMS)
      + f", {dec('CASE WHEN utility THEN cost ELSE 0 END')} AS utility_cost FROM usage_events GROUP BY 1", ["usage_events"])(
    lambda s, d: usage.usage_totals(m.usage_events(s, d), ["session_id"]))

MODEL_USAGE = (
    "model_usage AS (SELECT model, " + ", ".join(f"{dec(c)} AS {a}" for c, a in (
        ("input", "input_tokens"), ("output", "output_tokens"), ("cost", "cost"), ("cost_input", "cost_input"), ("cost_output", "cost_output")))
    + ", count(*) AS message_count, count(DISTINCT session_id) AS sessions FROM usage_events GROUP BY 1)"
)
query("a02_usage_by_model", "model:s input_tokens:d output_tokens:d cost:d message_count:l cost_input:d cost_output:d sessions:l",
      "SELECT * FROM model_usage", ["usage_events"], [MODEL_USAGE])(lambda s, d: usage.usage_by_model(m.usage_events(s, d)))


def credentials(spark, d):
    """Nations as credential rows: four providers, many rows each, the last wins."""
    return table(spark, d, "nation").select(
        F.expr(CRED_PROVIDER).alias("provider"), F.expr(CRED_TYPE).alias("credential_type"), F.col("n_nationkey").alias("row_no"))


CRED_PROVIDER = "CASE WHEN n_nationkey % 7 = 6 THEN 'mcp_oauth:x' ELSE " + m.pick("n_nationkey % 3", m.PROVIDERS[:3]) + " END"
CRED_TYPE = m.pick("n_nationkey % 5", ["OAuth", "api_key", "apikey", "session", "my-KEY-2"])
BASIS = (
    f"cred AS (SELECT {CRED_PROVIDER} AS provider, lower({CRED_TYPE}) AS t, n_nationkey AS row_no FROM nation), "
    "basis AS (SELECT provider, arg_max(CASE WHEN t = 'oauth' THEN 'subscription' ELSE 'api_key' END, row_no) AS basis FROM cred "
    "WHERE NOT starts_with(provider, 'mcp_oauth:') AND (t = 'oauth' OR contains(t, 'key')) GROUP BY 1)"
)
query("s11_provider_basis", "provider:s basis:s", "SELECT * FROM basis", [], [BASIS])(lambda s, d: usage.provider_basis(credentials(s, d)))


def provider_cost(spark, d, by=()):
    return usage.cost_by_provider(m.usage_events(spark, d), usage.provider_basis(credentials(spark, d)), by)


PROVIDER_COST = BASIS + (
    f", pc AS (SELECT user_id, provider, {dec('cost')} AS cost FROM usage_events GROUP BY 1, 2), "
    "provider_cost AS (SELECT user_id, provider, cost, coalesce(basis, 'unknown') AS basis FROM pc LEFT JOIN basis USING (provider))"
)
query("j10_provider_basis_join", "user_id:l provider:s cost:d basis:s", "SELECT * FROM provider_cost", ["usage_events"], [PROVIDER_COST])(
    lambda s, d: provider_cost(s, d, ["user_id"]))
query("a03_cost_by_provider", "user_id:l billed_cost:d subscription_cost:d unknown_cost:d",
      "SELECT user_id, " + ", ".join(f"{dec(f'CASE WHEN basis = {b!r} THEN cost ELSE 0 END')} AS {n}" for b, n in (
          ("api_key", "billed_cost"), ("subscription", "subscription_cost"), ("unknown", "unknown_cost")))
      + " FROM provider_cost GROUP BY 1", ["usage_events"], [PROVIDER_COST])(
    lambda s, d: usage.billed_split(provider_cost(s, d, ["user_id"]), ["user_id"]))

FOLD = ["cost_primary", "cost_advisor", "cost_subagent"]
query("j07_sidecar_fold", "session_id:s cost_primary:d cost_advisor:d cost_subagent:d total_cost:d input:d cache_read:d utility_cost:d",
      "SELECT session_id, " + ", ".join(f"{dec(f'CASE WHEN kind = {c[5:]!r} THEN cost ELSE 0 END')} AS {c}" for c in FOLD)
      + f", {dec('cost')} AS total_cost, {dec('input')} AS input, {dec('cache_read')} AS cache_read, "
      f"{dec('CASE WHEN utility THEN cost ELSE 0 END')} AS utility_cost FROM usage_events GROUP BY 1", ["usage_events"])(
    lambda s, d: usage.fold_sidecars(m.usage_events(s, d)))

query("a15_cache_hit_ratio", "session_id:s ratio:d",
      "SELECT session_id, CASE WHEN i + c > 0 THEN c / (i + c) ELSE 0 END AS ratio FROM "
      "(SELECT session_id, sum(input) AS i, sum(cache_read) AS c FROM usage_events WHERE kind = 'primary' GROUP BY 1)", ["usage_events"])(
    lambda s, d: usage.usage_totals(m.usage_events(s, d).where("kind = 'primary'"), ["session_id"]).select(
        "session_id", usage.cache_hit_ratio(F.col("cache_read"), F.col("input")).alias("ratio")))

# --- tools ----------------------------------------------------------------------

FIRST_CALLS = "first_calls AS (SELECT * FROM tool_calls QUALIFY row_number() OVER (PARTITION BY session_id, call_id ORDER BY seq, idx) = 1)"
COUNTED = (
    "counted AS (SELECT *, CASE WHEN tool = 'write' AND starts_with(path, 'xd://') "
    "THEN concat('xd://', split_part(substr(path, 6), '/', 1)) ELSE tool END AS counted FROM first_calls)"
)


def first_calls(spark, d):
    return pairing.first_calls(m.tool_calls(spark, d))


query("a04_tool_counts", "session_id:s tool:s n:l",
      "SELECT session_id, counted AS tool, count(*) AS n FROM counted GROUP BY ALL", ["tool_calls"], [FIRST_CALLS, COUNTED])(
    lambda s, d: tools.tool_counts(first_calls(s, d)))
query("a04_tool_flags", "session_id:s uses_subagent:l uses_mcp:l",
      "SELECT session_id, max(CASE WHEN counted = 'task' THEN 1 ELSE 0 END) AS uses_subagent, "
      "max(CASE WHEN starts_with(counted, 'xd://mcp__') OR starts_with(counted, 'mcp__') THEN 1 ELSE 0 END) AS uses_mcp FROM counted GROUP BY 1",
      ["tool_calls"], [FIRST_CALLS, COUNTED])(lambda s, d: tools.tool_flags(tools.tool_counts(first_calls(s, d))))

LANG = ("CASE WHEN ends_with({p}, '.py') THEN 'Python' WHEN ends_with({p}, '.ts') THEN 'TypeScript' WHEN ends_with({p}, '.md') THEN 'Markdown' END")
query("a05_language_counts", "session_id:s language:s n:l",
      "SELECT session_id, language, count(*) AS n FROM (SELECT session_id, " + LANG.format(p="path") + " AS language FROM counted "
      "WHERE counted IN ('read', 'write') UNION ALL SELECT session_id, 'Python' FROM counted WHERE counted = 'edit') "
      "WHERE language IS NOT NULL GROUP BY ALL", ["tool_calls"], [FIRST_CALLS, COUNTED])(
    lambda s, d: tools.language_counts(first_calls(s, d)))

EDITS = (
    "edit_rows AS (SELECT session_id, path, 3 AS added, 0 AS removed FROM counted WHERE counted = 'write' "
    "UNION ALL SELECT session_id, regexp_extract(input, '^\\[([^\\]]+)#', 1), 2, 8 FROM counted WHERE counted = 'edit')"
)


def edit_rows(spark, d):
    return tools.edit_rows(first_calls(spark, d))


query("a06_edit_accounting", "session_id:s lines_added:l lines_removed:l files_modified:l",
      "SELECT session_id, sum(added) AS lines_added, sum(removed) AS lines_removed, count(DISTINCT path) AS files_modified FROM edit_rows GROUP BY 1",
      ["tool_calls"], [FIRST_CALLS, COUNTED, EDITS])(lambda s, d: tools.edit_totals(edit_rows(s, d)))
query("a06_top_files", "session_id:s path:s edits:l rank:l",
      "SELECT session_id, path, edits, row_number() OVER (PARTITION BY session_id ORDER BY edits DESC, path) AS rank FROM "
      "(SELECT session_id, path, count(*) AS edits FROM edit_rows GROUP BY ALL) QUALIFY rank <= 20",
      ["tool_calls"], [FIRST_CALLS, COUNTED, EDITS])(lambda s, d: tools.top_files(tools.edits_by_file(edit_rows(s, d))))
query("a07_git_counts", "session_id:s git_commits:l git_pushes:l",
      "SELECT session_id, count(*) FILTER (contains(command, 'git commit')) AS git_commits, count(*) FILTER (contains(command, 'git push')) AS git_pushes "
      "FROM first_calls WHERE tool = 'bash' GROUP BY 1", ["tool_calls"], [FIRST_CALLS])(lambda s, d: tools.git_counts(first_calls(s, d)))
query("a08_tool_outcomes", "session_id:s tool:s calls:l errors:l not_found:l",
      "SELECT session_id, rate_key AS tool, count(*) FILTER (outcome <> 'not_found') AS calls, count(*) FILTER (outcome = 'error') AS errors, "
      "count(*) FILTER (outcome = 'not_found') AS not_found FROM outcomes GROUP BY ALL", ["tool_calls", "results"], [OUTCOMES])(
    lambda s, d: pairing.tool_outcomes(outcomes(s, d), ["session_id"]))
query("a08_error_categories", "category:s n:l", "SELECT category, count(*) AS n FROM outcomes WHERE category IS NOT NULL GROUP BY 1",
      ["tool_calls", "results"], [OUTCOMES])(
    lambda s, d: outcomes(s, d).where("category is not null").groupBy("category").agg(F.count("*").alias("n")))

CLASS = ("CASE WHEN stop_reason = 'error' THEN CASE WHEN contains(error_message, '429') THEN 'rate_limit' WHEN contains(error_message, 'quota') THEN 'quota' "
         "WHEN contains(error_message, '401') THEN 'auth' ELSE 'other' END END")
query("a09_failure_classes", "session_id:s class:s n:l",
      f"SELECT a.session_id, c.class, count(*) FILTER (a.cls = c.class) AS n FROM (SELECT session_id, {CLASS} AS cls FROM messages WHERE role = 'assistant') a, "
      "(VALUES ('rate_limit'), ('quota'), ('auth'), ('other')) c(class) GROUP BY ALL", ["messages"])(
    lambda s, d: tools.failure_classes(m.messages(s, d)))

MARKERS = [("thinking_level_change", "thinking_escalations"), ("model_change", "model_switches"), ("compaction", "compactions"),
           ("ttsr_injection", "injections"), ("reset_boundary", "reset_boundaries")]
query("a11_marker_counts", "session_id:s " + " ".join(f"{n}:l" for _, n in MARKERS),
      "SELECT session_id, " + ", ".join(f"count(*) FILTER (marker = '{k}') AS {n}" for k, n in MARKERS) + " FROM markers GROUP BY 1", ["markers"])(
    lambda s, d: tools.marker_counts(m.markers(s, d)))
query("a11_rule_counts", "session_id:s rule:s n:l",
      "SELECT session_id, rule, count(*) AS n FROM (SELECT session_id, unnest([rule_a, rule_b]) AS rule FROM markers WHERE marker = 'ttsr_injection') GROUP BY ALL",
      ["markers"])(lambda s, d: tools.rule_counts(m.markers(s, d)))
query("a11_steering_and_intent", "session_id:s steering:l intents:l",
      "SELECT session_id, sum(a) AS steering, sum(b) AS intents FROM (SELECT session_id, CASE WHEN is_human AND steering THEN 1 ELSE 0 END AS a, 0 AS b FROM messages "
      "UNION ALL SELECT session_id, 0, CASE WHEN has_intent THEN 1 ELSE 0 END FROM tool_starts) GROUP BY 1", ["messages", "tool_starts"])(
    lambda s, d: m.messages(s, d).select("session_id", (F.col("is_human") & F.col("steering")).cast("int").alias("a"), F.lit(0).alias("b")).unionByName(
        m.tool_starts(s, d).select("session_id", F.lit(0).alias("a"), F.col("has_intent").cast("int").alias("b"))
    ).groupBy("session_id").agg(F.sum("a").alias("steering"), F.sum("b").alias("intents")))

NEAREST = "list_extract(list_sort(list({v})), least(count(*), CAST(floor({p} * count(*)) AS BIGINT) + 1))"
TOOL_DURATIONS = (
    "tool_durations AS (SELECT session_id, tool, count(*) AS calls, " + dec("duration_sec") + " AS total_sec, "
    + NEAREST.format(v="duration_sec", p="0.5::DOUBLE") + " AS p50_sec, " + NEAREST.format(v="duration_sec", p="0.9::DOUBLE") + " AS p90_sec FROM timed GROUP BY ALL)"
)
query("a14_tool_durations", "session_id:s tool:s calls:l total_sec:d p50_sec:d p90_sec:d share:d",
      "SELECT *, total_sec / nullif(sum(total_sec) OVER (PARTITION BY session_id), 0) AS share FROM tool_durations",
      ["tool_starts", "results"], [STARTS_AND_RESULTS, TOOL_DURATIONS])(
    lambda s, d: tools.tool_durations(timed_calls(s, d)))
query("a19_nearest_rank", "event_type:s p10:d p50:d p90:d p100:d",
      "SELECT event_type, " + ", ".join(NEAREST.format(v="value", p=f"{p / 100}::DOUBLE") + f" AS p{p}" for p in (10, 50, 90, 100))
      + " FROM events GROUP BY 1")(
    lambda s, d: numeric.percentiles(table(s, d, "events"), ["event_type"], "value", {f"p{p}": p for p in (10, 50, 90, 100)}))

# --- turns ----------------------------------------------------------------------

TURNS = (
    "numbered AS (SELECT *, sum(CASE WHEN is_human THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS turn_no FROM messages), "
    "tn AS (SELECT *, min(CASE WHEN tool IN ('edit', 'write') THEN seq END) OVER (PARTITION BY session_id, turn_no) AS mut FROM numbered WHERE turn_no > 0), "
    "turns AS (SELECT session_id, turn_no, max(CASE WHEN is_human THEN ts_ms END) AS start_ms, max(CASE WHEN is_human THEN text END) AS prompt, "
    "count(*) FILTER (role = 'assistant') AS round_trips, count(*) FILTER (role = 'toolResult') AS tool_calls, "
    "count(*) FILTER (tool IN ('read', 'grep', 'glob', 'task') AND (mut IS NULL OR seq < mut)) AS exploration, "
    "max(CASE WHEN mut IS NOT NULL THEN 1 ELSE 0 END) AS mutated, " + dec("CASE WHEN role = 'assistant' THEN cost END") + " AS cost, "
    "coalesce(arg_max(CASE WHEN stop_reason = 'aborted' THEN 1 ELSE 0 END, seq) FILTER (role = 'assistant'), 0) AS aborted, "
    "greatest(0, coalesce((CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN arg_max(coalesce(completed_ms, ts_ms), seq) FILTER (role = 'assistant') "
    "ELSE arg_max(ts_ms, seq) FILTER (role = 'toolResult') END - max(CASE WHEN is_human THEN ts_ms END)) / 1000.0, 0)) AS wall_sec FROM tn GROUP BY ALL)"
)
TURN_SPEC = "session_id:s turn_no:l start_ms:l prompt:s round_trips:l tool_calls:l exploration:l mutated:l cost:d aborted:l wall_sec:d"


def turn_rows(spark, d):
    return turns.turn_rollup(m.messages(spark, d))


query("a12_turn_rollup", TURN_SPEC, "SELECT * FROM turns", ["messages"], [TURNS])(turn_rows)
TURN_PCT = (
    "turn_long AS (SELECT session_id, unnest(['round_trips', 'tool_calls', 'exploration', 'wall_sec']) AS metric, "
    "unnest([round_trips::DOUBLE, tool_calls::DOUBLE, exploration::DOUBLE, wall_sec::DOUBLE]) AS v FROM turns), "
    "turn_pct AS (SELECT session_id, metric, " + NEAREST.format(v="v", p="0.5::DOUBLE") + " AS p50, " + NEAREST.format(v="v", p="0.9::DOUBLE")
    + " AS p90, count(*) AS n FROM turn_long GROUP BY ALL)"
)
query("a13_turn_percentiles", "session_id:s metric:s p50:d p90:d", "SELECT * FROM turn_pct", ["messages"], [TURNS, TURN_PCT])(
    lambda s, d: turns.turn_percentiles(turn_rows(s, d)))
query("a13_worst_turns", "session_id:s turn_no:l tool_calls:l rank:l",
      "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tool_calls DESC, turn_no) AS rank FROM turns QUALIFY rank <= 5", ["messages"], [TURNS])(
    lambda s, d: turns.worst_turns(turn_rows(s, d)))

query("j13_abort_to_next_human", "session_id:s seq:l next_seq:l gap_sec:d",
      "SELECT a.session_id, a.seq, h.seq AS next_seq, (h.ts_ms - a.ts_ms) / 1000.0 AS gap_sec FROM (SELECT * FROM messages WHERE stop_reason = 'aborted') a "
      "LEFT JOIN LATERAL (SELECT seq, ts_ms FROM messages h WHERE h.session_id = a.session_id AND h.is_human AND h.seq > a.seq ORDER BY seq LIMIT 1) h ON true",
      ["messages"])(lambda s, d: turns.abort_resolution(m.messages(s, d)))
query("j14_reply_time", "session_id:s seq:l reply_sec:d",
      "SELECT * FROM (SELECT session_id, seq, is_human, (ts_ms - last_value(CASE WHEN role = 'assistant' THEN ts_ms END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq "
      "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1000.0 AS reply_sec FROM messages) WHERE is_human AND reply_sec > 2 AND reply_sec < 3600",
      ["messages"])(lambda s, d: turns.reply_times(m.messages(s, d)))
query("a16_medians", "session_id:s median_ttft_ms:d",
      "SELECT session_id, median(ttft_ms) AS median_ttft_ms FROM messages WHERE ttft_ms > 0 GROUP BY 1", ["messages"])(
    lambda s, d: numeric.medians(m.messages(s, d).where("ttft_ms > 0"), ["session_id"], "ttft_ms", "median_ttft_ms"))

WORDS = "list_distinct(regexp_extract_all(lower({x}), '([A-Za-z0-9_]+)', 1))"
ABORTS = (
    FIRST_CALLS + ", "
    "fc AS (SELECT session_id, seq FROM first_calls), "
    "ab AS (SELECT * FROM messages WHERE stop_reason = 'aborted'), "
    "ctx AS (SELECT a.session_id, a.seq, a.ts_ms, a.text, p.seq AS pseq, p.ts_ms AS pts, p.text AS ptext, n.ts_ms AS nts, n.text AS ntext FROM ab a "
    "LEFT JOIN LATERAL (SELECT seq, ts_ms, text FROM messages h WHERE h.session_id = a.session_id AND h.is_human AND h.seq < a.seq ORDER BY seq DESC LIMIT 1) p ON true "
    "LEFT JOIN LATERAL (SELECT seq, ts_ms, text FROM messages h WHERE h.session_id = a.session_id AND h.is_human AND h.seq > a.seq ORDER BY seq LIMIT 1) n ON true), "
    "cnt AS (SELECT c.session_id, c.seq, count(f.seq) AS calls FROM ctx c LEFT JOIN fc f ON f.session_id = c.session_id AND f.seq < c.seq AND f.seq > coalesce(c.pseq, -1) GROUP BY ALL), "
    "ab2 AS (SELECT c.session_id, c.seq, c.ts_ms, k.calls AS tool_calls_before, coalesce((c.ts_ms - c.pts) / 1000.0, 0) AS elapsed_sec, c.text AS partial_text, "
    "c.ntext AS next_text, (c.nts - c.ts_ms) / 1000.0 AS gap_sec, "
    "len(list_intersect(" + WORDS.format(x="coalesce(ptext, '')") + ", " + WORDS.format(x="ntext") + ")) AS ni, "
    "len(list_distinct(list_concat(" + WORDS.format(x="coalesce(ptext, '')") + ", " + WORDS.format(x="ntext") + "))) AS nu FROM ctx c JOIN cnt k USING (session_id, seq)), "
    "aborts AS (SELECT *, CASE WHEN regexp_matches(next_text, '(?i)^(no|nope|wait|stop|not that|instead|actually|hold on)\\b') THEN 'course_correction' "
    "WHEN tool_calls_before = 0 AND gap_sec < 60 AND nu > 0 AND ni::DOUBLE / nu >= 0.5 THEN 'user_rephrased' "
    "WHEN gap_sec IS NULL OR gap_sec > 300 THEN 'abandoned' ELSE 'unknown' END AS label FROM ab2)"
)
ABORT_SPEC = "session_id:s seq:l ts_ms:l tool_calls_before:l elapsed_sec:d partial_text:s next_text:s gap_sec:d label:s abort_no:l"


def abort_rows(spark, d):
    return turns.abort_events(m.messages(spark, d), first_calls(spark, d))


query("a10_abort_events", ABORT_SPEC, "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS abort_no FROM aborts QUALIFY abort_no <= 10", ["messages", "tool_calls"], [ABORTS])(
    lambda s, d: turns.first_aborts(abort_rows(s, d)))
query("a10_ends_aborted", "session_id:s ends_aborted:l",
      "SELECT session_id, arg_max(CASE WHEN stop_reason = 'aborted' THEN 1 ELSE 0 END, seq) AS ends_aborted FROM messages GROUP BY 1", ["messages"])(
    lambda s, d: turns.ends_aborted(m.messages(s, d)))

SPAN = (
    "st AS (SELECT session_id, max(seq) AS start_seq, arg_max(ts_ms, seq) AS start_ms FROM messages WHERE is_human GROUP BY 1), "
    "pv AS (SELECT *, lag(stop_reason) OVER (PARTITION BY session_id ORDER BY seq) AS prev FROM messages), "
    "sp AS (SELECT p.*, s.start_seq, s.start_ms, p.is_human AND (regexp_matches(text, '^no\\b') OR contains(text, 'again') OR contains(text, 'wrong') OR contains(text, 'stop ')) "
    "AND NOT contains(text, 'stop on green') AS phrase FROM pv p JOIN st s USING (session_id) WHERE seq >= start_seq), "
    "cn AS (SELECT session_id, start_seq, start_ms, count(*) FILTER (is_error) AS tool_errors, count(*) FILTER (phrase) AS phrase_corrections, "
    "count(*) FILTER (is_human AND NOT phrase AND prev = 'aborted') AS abort_corrections, "
    "arg_min(text, seq) FILTER (phrase OR (is_human AND prev = 'aborted')) AS quote FROM sp GROUP BY ALL), "
    "fl AS (SELECT session_id, string_agg(concat(tool, ': ', text), chr(10) ORDER BY seq) AS failed_lines FROM (SELECT * FROM sp WHERE is_error "
    "QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) <= 5) GROUP BY 1), "
    "nc AS (SELECT c.session_id, count(*) AS tool_calls FROM tool_calls c JOIN st s USING (session_id) WHERE c.seq >= s.start_seq GROUP BY 1)"
)
query("a39_request_span", "session_id:s start_seq:l start_ms:l tool_errors:l phrase_corrections:l abort_corrections:l quote:s tool_calls:l failed_lines:s",
      "SELECT cn.*, coalesce(tool_calls, 0) AS tool_calls, coalesce(failed_lines, '') AS failed_lines FROM cn LEFT JOIN nc USING (session_id) LEFT JOIN fl USING (session_id)",
      ["messages", "tool_calls"], [SPAN])(lambda s, d: turns.request_spans(m.messages(s, d), m.tool_calls(s, d)))

# --- activity -------------------------------------------------------------------

RUNS = (
    "pt AS (SELECT DISTINCT user_id, session_id, ts_ms FROM messages), "
    "fl_ AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms) > {gap} THEN 1 ELSE 0 END AS brk FROM pt), "
    "isl AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY ts_ms) AS run FROM fl_), "
    "runs AS (SELECT user_id, session_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS records FROM isl GROUP BY user_id, session_id, run)"
)
GAP = 6 * 3_600_000  # the test events are hours apart


def runs(spark, d, gap_ms=GAP, keys=("user_id", "session_id")):
    return activity.activity_runs(m.messages(spark, d), keys, gap_ms)


query("a17_activity_runs", "session_id:s start_ms:l end_ms:l records:l", "SELECT * FROM runs", ["messages"], [RUNS.format(gap=GAP)])(runs)
DAYS = (
    "dd AS (SELECT user_id, session_id, start_ms, end_ms, unnest(range(start_ms // 86400000, end_ms // 86400000 + 1)) AS day FROM runs WHERE end_ms > start_ms), "
    "cl AS (SELECT user_id, day, greatest(start_ms, day * 86400000) AS s, least(end_ms, (day + 1) * 86400000) AS e FROM dd), "
    "mx AS (SELECT *, max(e) OVER (PARTITION BY user_id, day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM cl WHERE e > s), "
    "hours AS (SELECT user_id, day, sum(greatest(0, e - greatest(s, coalesce(pe, s)))) / 3600000.0 AS hours FROM mx GROUP BY ALL)"
)


def hours(spark, d, by=("user_id",)):
    return activity.active_hours_by_day(runs(spark, d), list(by))


query("a18_active_hours_by_day", "user_id:l day:l hours:d", "SELECT * FROM hours", ["messages"], [RUNS.format(gap=GAP), DAYS])(
    lambda s, d: hours(s, d).withColumn("day", F.datediff("local_day", F.lit("1970-01-01").cast("date"))))

# Sessions of two users share a corpus; messages within ten hours interleave.
TEAM = "user_id % 10"
WINDOW = 10 * 3_600_000
OVERLAPS = (
    f"hm AS (SELECT {TEAM} AS team, session_id, seq, ts_ms FROM messages WHERE is_human), "
    "nx AS (SELECT *, lead(ts_ms) OVER (PARTITION BY team, session_id ORDER BY ts_ms, seq) AS own_ms, lead(seq) OVER (PARTITION BY team, session_id ORDER BY ts_ms, seq) AS own_seq FROM hm), "
    "hit AS (SELECT a.team, a.session_id, a.ts_ms AS from_ms, a.own_ms AS to_ms, b.session_id AS other_id, b.ts_ms AS other_ms FROM nx a "
    "JOIN LATERAL (SELECT session_id, ts_ms FROM hm b WHERE b.team = a.team AND b.session_id <> a.session_id AND b.seq > a.seq AND b.seq < a.own_seq ORDER BY b.seq LIMIT 1) b ON true "
    f"WHERE a.own_ms - a.ts_ms <= {WINDOW})"
)


def team_messages(spark, d):
    return m.messages(spark, d).withColumn("team", F.expr(TEAM))


def team_interleavings(spark, d):
    """In order of arrival: event ids count the messages of all sessions."""
    return activity.interleavings(team_messages(spark, d), ["team"], WINDOW, order=["seq"], chunk=by_width("seq", SEQ_CHUNK))


query("j12_interleavings", "team:l session_id:s from_ms:l to_ms:l other_id:s other_ms:l", "SELECT * FROM hit", ["messages"], [OVERLAPS])(
    lambda s, d: team_interleavings(s, d))
query("j12_overlap_summary", "team:l overlap_events:l sessions_involved:l user_messages_during:l",
      "SELECT team, count(DISTINCT CASE WHEN k = 0 THEN v END) AS overlap_events, count(DISTINCT CASE WHEN k = 1 THEN v END) AS sessions_involved, "
      "count(DISTINCT CASE WHEN k = 2 THEN v END) AS user_messages_during FROM (SELECT team, 0 AS k, concat(least(session_id, other_id), ':', greatest(session_id, other_id)) AS v FROM hit "
      "UNION ALL SELECT team, 1, session_id FROM hit UNION ALL SELECT team, 1, other_id FROM hit UNION ALL SELECT team, 2, concat(from_ms, ':', session_id) FROM hit "
      "UNION ALL SELECT team, 2, concat(to_ms, ':', session_id) FROM hit UNION ALL SELECT team, 2, concat(other_ms, ':', other_id) FROM hit) GROUP BY 1", ["messages"], [OVERLAPS])(
    lambda s, d: activity.overlap_summary(team_interleavings(s, d), ["team"]))
query("a37_hour_histogram", "user_id:l hour:l n:l",
      "SELECT u.user_id, h.hour, count(x.h) AS n FROM (SELECT DISTINCT user_id FROM messages WHERE is_human) u CROSS JOIN (SELECT unnest(range(24)) AS hour) h "
      "LEFT JOIN (SELECT user_id, (ts_ms // 3600000) % 24 AS h FROM messages WHERE is_human) x ON x.user_id = u.user_id AND x.h = h.hour GROUP BY ALL", ["messages"])(
    lambda s, d: activity.hour_histogram(m.messages(s, d), ["user_id"]))
query("a37_reply_histogram", "band:s n:l",
      "SELECT b.band, count(r.reply_sec) AS n FROM (VALUES ('2-10s', 0, 10), ('10-30s', 10, 30), ('30s-1m', 30, 60), ('1-2m', 60, 120), ('2-5m', 120, 300), ('5-15m', 300, 900), "
      "('>15m', 900, 1e9)) b(band, lo, hi) LEFT JOIN (SELECT * FROM (SELECT is_human, (ts_ms - last_value(CASE WHEN role = 'assistant' THEN ts_ms END IGNORE NULLS) OVER "
      "(PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1000.0 AS reply_sec FROM messages) WHERE is_human AND reply_sec > 2 AND reply_sec < 3600) r "
      "ON r.reply_sec >= b.lo AND r.reply_sec < b.hi GROUP BY 1", ["messages"])(
    lambda s, d: activity.reply_histogram(turns.reply_times(m.messages(s, d))))
