"""Queries over raw logs: JSON lines and file listings made from the tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.catalog import mapping as m
from worktrail.catalog.log_files import new_folder, write_logs, written_logs
from worktrail.catalog.mapping import dec, table
from worktrail.catalog.registry import query
from worktrail.functions import numeric
from worktrail.operators import forks, tools, usage
from worktrail.plans import build, refresh, store
from worktrail.session import materialise
from worktrail.sources import dialect_a, dialect_b, logs

# --- files ---------------------------------------------------------------------------

ROOT = "/logs"
PATH = (
    "CASE doc_id % 8 WHEN 0 THEN concat('/logs/p', doc_id % 5, '/2024_', doc_id // 16, '.jsonl') WHEN 1 THEN concat('/logs/p', doc_id % 5, '/plain', doc_id, '.jsonl') "
    "WHEN 2 THEN concat('/logs/loose', doc_id, '.jsonl') WHEN 3 THEN concat('/logs/p', (doc_id - 3) % 5, '/2024_', (doc_id - 3) // 16, '/__advisor.jsonl') "
    "WHEN 4 THEN concat('/logs/p', (doc_id - 4) % 5, '/2024_', (doc_id - 4) // 16, '/x', doc_id, '.jsonl') WHEN 5 THEN concat('/logs/p', (doc_id - 5) % 5, '/2024_', (doc_id - 5) // 16, '/x/x.nested', doc_id, '.jsonl') "
    "ELSE concat('/logs/p', doc_id % 5, '/2024_', doc_id // 16, '/7.bash.log') END"
)


def listing(spark, d) -> DataFrame:
    """Documents as a file listing (path, size, mtime)."""
    return table(spark, d, "documents").select(
        F.expr(PATH.replace(" // 16", " div 16")).alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 1000).alias("mtime_ms"))


FILES = f"files AS (SELECT {PATH} AS path, n_chars AS size, doc_id * 1000 AS mtime_ms FROM documents)"
PRIMARY = (
    FILES + ", prim AS (SELECT *, regexp_extract(path, '^/logs/([^/]+)/', 1) AS project_dir, regexp_extract(path, '([^/]+)[.]jsonl$', 1) AS base FROM files WHERE regexp_matches(path, '^/logs/[^/]+/[^/]+[.]jsonl$')), "
    "prim2 AS (SELECT *, CASE WHEN contains(base, '_') THEN substr(base, strpos(base, '_') + 1) ELSE base END AS session_id FROM prim), "
    "side AS (SELECT *, regexp_extract(path, '^/logs/([^/]+)/', 1) AS project_dir, regexp_extract(path, '^/logs/[^/]+/([^/]+)/', 1) AS base, regexp_extract(path, '^/logs/[^/]+/[^/]+/(.+)[.]jsonl$', 1) AS sidecar_name, "
    "CASE WHEN ends_with(path, '/__advisor.jsonl') THEN 'advisor' ELSE 'subagent' END AS kind FROM files WHERE regexp_matches(path, '^/logs/[^/]+/[^/]+/.+[.]jsonl$'))"
)
query("s02_primary_logs", "path:s project_dir:s session_id:s", "SELECT * FROM prim2", [], [PRIMARY])(lambda s, d: logs.primary_logs(listing(s, d), ROOT))
query("s03_sidecar_logs", "path:s project_dir:s base:s sidecar_name:s kind:s", "SELECT * FROM side", [], [PRIMARY])(lambda s, d: logs.sidecar_logs(listing(s, d), ROOT))
SIGNED = PRIMARY + (
    ", ss AS (SELECT project_dir, base, string_agg(concat(sidecar_name, '=', size, ':', mtime_ms), '|' ORDER BY concat(sidecar_name, '=', size, ':', mtime_ms) COLLATE \"binary\") AS sig, count(*) FILTER (kind = 'advisor') AS advisor_logs, count(*) FILTER (kind = 'subagent') AS subagent_logs FROM side GROUP BY 1, 2), "
    "signed AS (SELECT p.*, concat_ws('|', concat(size, ':', mtime_ms), sig) AS signature, coalesce(advisor_logs, 0) AS advisor_logs, coalesce(subagent_logs, 0) AS subagent_logs FROM prim2 p LEFT JOIN ss USING (project_dir, base))"
).replace(' COLLATE "binary"', "")


def signed(spark, d):
    files = listing(spark, d)
    return logs.with_signatures(logs.primary_logs(files, ROOT), logs.sidecar_logs(files, ROOT))


query("s04_signatures", "path:s session_id:s signature:s advisor_logs:l subagent_logs:l", "SELECT * FROM signed", [], [SIGNED])(signed)
query("s05_duplicate_logs", "session_id:s path:s size:l", "SELECT * FROM prim2 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY size DESC, path) = 1", [], [PRIMARY])(
    lambda s, d: logs.drop_duplicate_logs(logs.primary_logs(listing(s, d), ROOT)))
PREVIOUS = "CASE WHEN size % 3 = 0 THEN concat(signature, '|old') ELSE signature END"
VERSION = "CASE WHEN size % 5 = 0 THEN 0 ELSE 1 END"


def previous(spark, d):
    kept = logs.drop_duplicate_logs(signed(spark, d))
    return kept.where("size % 7 <> 0").select("session_id", F.expr(PREVIOUS).alias("signature"), F.expr(VERSION).alias("schema_version"))


KEPT = SIGNED + ", kept AS (SELECT * FROM signed QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY size DESC, path) = 1)"
query("s12_stale_logs", "session_id:s signature:s", "SELECT * FROM kept WHERE size % 7 = 0 OR size % 3 = 0 OR size % 5 = 0", [], [KEPT])(
    lambda s, d: refresh.stale_logs(logs.drop_duplicate_logs(signed(s, d)), previous(s, d)))
query("s12_refreshed_table", "session_id:s signature:s recomputed:l",
      "SELECT session_id, signature, CASE WHEN size % 7 = 0 OR size % 3 = 0 OR size % 5 = 0 THEN 1 ELSE 0 END AS recomputed FROM kept", [], [KEPT])(
    lambda s, d: refresh.refreshed(previous(s, d).withColumn("recomputed", F.lit(0)), refresh.stale_logs(logs.drop_duplicate_logs(signed(s, d)), previous(s, d)).select(
        "session_id", "signature", F.lit(1).alias("recomputed")), logs.drop_duplicate_logs(signed(s, d))))
EXCLUDED = "CASE WHEN size % 4 = 0 THEN 'not_substantive' WHEN size % 5 = 0 THEN 'by_since' END"
query("s14_scan_summary", "measure:s n:l",
      f"SELECT coalesce('excluded_' || x, 'included') AS measure, count(*) AS n FROM (SELECT {EXCLUDED} AS x FROM kept) GROUP BY 1 UNION ALL SELECT 'primary_logs', count(*) FROM kept UNION ALL SELECT 'advisor_logs', sum(advisor_logs) FROM kept UNION ALL SELECT 'subagent_logs', sum(subagent_logs) FROM kept", [], [KEPT])(
    lambda s, d: logs.scan_summary(logs.drop_duplicate_logs(signed(s, d)), logs.drop_duplicate_logs(signed(s, d)).withColumn("exclusion", F.expr(EXCLUDED))))
query("s13_manifest", "session_id:s path:s total_cost:d sidecars:l",
      "SELECT k.session_id, k.path, k.size / 100.0 AS total_cost, coalesce(n, 0) AS sidecars FROM kept k LEFT JOIN (SELECT project_dir, base, count(*) AS n FROM side GROUP BY 1, 2) USING (project_dir, base)", [], [KEPT])(
    lambda s, d: manifest_rows(s, d))


def manifest_rows(spark, d):
    kept = logs.drop_duplicate_logs(signed(spark, d))
    rows = kept.select("session_id", F.col("mtime_ms").alias("start_ms"), (F.col("size") / 100.0).alias("total_cost"), F.lit(0.0).alias("cost_primary"), F.lit(0.0).alias("cost_advisor"), F.lit(0.0).alias("cost_subagent"))
    side = logs.sidecar_logs(listing(spark, d), ROOT).join(kept.select("project_dir", "base", "session_id"), ["project_dir", "base"])
    return refresh.manifest(rows, kept, side)


query("j24_changed_sizes", "session_id:s recorded_size:l size:l",
      "SELECT session_id, size AS recorded_size, CASE WHEN size % 6 = 0 THEN NULL ELSE size + CASE WHEN size % 2 = 0 THEN 1 ELSE 0 END END AS size FROM kept WHERE size % 2 = 0", [], [KEPT])(
    lambda s, d: refresh.changed_sizes(logs.drop_duplicate_logs(signed(s, d)).select("session_id", "path", "signature"),
                                       logs.drop_duplicate_logs(signed(s, d)).where("size % 6 <> 0").select("path", F.expr("size + CASE WHEN size % 2 = 0 THEN 1 ELSE 0 END").alias("size"))))

# --- records -------------------------------------------------------------------------

LINE = m.pick("doc_id % 4", ["A", "B", "C", "D"])


def broken_lines(spark, d):
    """Documents as log lines: whole, cut off, padded, not JSON."""
    whole = F.to_json(F.struct("doc_id", "text"))
    kind = F.col("doc_id") % 4
    return table(spark, d, "documents").select("doc_id", F.when(kind == 0, whole).when(kind == 1, F.substr(whole, F.lit(1), F.length(whole) - 3)).when(kind == 2, F.concat(F.lit(" "), whole)).otherwise(F.col("text")).alias("line"))


query("s01_valid_lines", "doc_id:l", "SELECT doc_id FROM documents WHERE doc_id % 4 = 0")(lambda s, d: logs.records_of_lines(broken_lines(s, d)))


def a_lines(spark, d) -> DataFrame:
    """The mapped messages written as dialect A lines, with bad usage and headers."""
    x = m.messages(spark, d)
    number = lambda c: F.col(c).cast("bigint")
    usage_ = F.when(F.col("role") == "assistant", F.struct(
        number("input").alias("input"), number("output").alias("output"), number("cache_read").alias("cacheRead"), number("cache_write").alias("cacheWrite"),
        F.struct(F.col("cost").alias("total"), F.col("cost_input").alias("input"), F.col("cost_output").alias("output")).alias("cost")))
    text_block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text"))))
    message = F.struct(
        "role", F.when(F.col("role") == "user", "user").alias("attribution"), F.when(F.col("is_human"), F.col("steering")).alias("steering"),
        "model", "provider", F.col("ts_ms").alias("timestamp"), F.col("completed_ms").alias("completedAt"), F.col("ttft_ms").alias("ttft"), F.col("duration_ms").alias("duration"),
        F.col("stop_reason").alias("stopReason"), F.col("error_message").alias("errorMessage"), F.col("tool").alias("toolName"), F.col("call_id").alias("toolCallId"), F.col("is_error").alias("isError"),
        usage_.alias("usage"), F.col("text").alias("content"))
    line = F.to_json(F.struct(F.lit("message").alias("type"), F.concat(F.lit("r"), "seq").alias("id"), F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), message.alias("message")))
    # Content as a list of blocks on every third line, as text starting with a bracket on others.
    blocks = F.when(F.col("seq") % 3 == 0, F.regexp_replace(line, r'"content":"((?:[^"\\]++|\\.)*+)"', '"content":[{"type":"text","text":"$1"}]')).otherwise(line)
    # A number given as text reads as zero.
    bad = F.when(F.col("seq") % 5 == 0, F.regexp_replace(blocks, r'"usage":\{"input":(\d+)', '"usage":{"input":"$1"')).otherwise(blocks)
    owner = [F.lit("a").alias("source"), F.col("session_id"), F.lit("primary").alias("kind"), F.lit("").alias("sidecar_name")]
    body = x.select(*owner, "seq", bad.alias("line"))
    heads = x.groupBy("session_id").agg(F.min("ts_ms").alias("ts_ms"), F.min("user_id").alias("user_id")).select(
        *owner, F.lit(-1).cast("bigint").alias("seq"),
        F.to_json(F.struct(F.lit("session").alias("type"), F.col("session_id").alias("id"), F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.concat(F.lit("/home/p"), F.col("user_id")).alias("cwd"))).alias("line"))
    return body.unionByName(heads)


def a_tables(spark, d):
    return dialect_a.normalise(a_lines(spark, d))


query("s07_dialect_a_messages", "session_id:s seq:l ts_ms:l role:s text:s is_human:l steering:l model:s input:d cost:d completed_ms:l tool:s call_id:s is_error:l",
      "SELECT session_id, seq, ts_ms, role, text, is_human, coalesce(steering, false) AS steering, model, CASE WHEN seq % 5 = 0 THEN 0 ELSE input END AS input, cost, completed_ms, tool, call_id, is_error FROM messages", ["messages"])(
    lambda s, d: a_tables(s, d).messages)
query("s07_dialect_a_usage", "session_id:s input:d output:d cost:d utility_cost:d",
      f"SELECT session_id, {dec('CASE WHEN seq % 5 = 0 THEN 0 ELSE input END')} AS input, {dec('output')} AS output, {dec('cost')} AS cost, 0 AS utility_cost FROM messages WHERE role = 'assistant' GROUP BY 1", ["messages"])(
    lambda s, d: usage.usage_totals(a_tables(s, d).usage_events, ["session_id"]))
query("s09_dialect_a_header", "session_id:s record_session_id:s cwd:s first_ms:l end_ms:l",
      "SELECT session_id, session_id AS record_session_id, concat('/home/p', min(user_id)) AS cwd, min(ts_ms) AS first_ms, max(ts_ms) AS end_ms FROM messages GROUP BY 1", ["messages"])(
    lambda s, d: a_tables(s, d).header)

# Dialect B: views are answers (several lines per request), clicks are tool calls.
B_TYPE = "CASE event_type WHEN 'view' THEN 'assistant' WHEN 'click' THEN 'assistant' WHEN 'purchase' THEN 'cost-state' ELSE 'user' END"


def b_lines(spark, d) -> DataFrame:
    e = m.events(spark, d).withColumn("type", F.expr(B_TYPE))
    block = F.when(F.col("event_type") == "click", F.array(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("c"), F.col("k") % 7).alias("id"), F.expr(m.pick("k % 3", ["Bash", "Read", "Task"])).alias("name"),
                                                     F.struct(F.lit("npm test").alias("command")).alias("input")))).when(
        F.col("event_type") == "error", F.array(F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("id"), F.concat(F.lit("c"), F.col("k") % 7).alias("name"), F.lit(None).cast("struct<command:string>").alias("input"))))
    content = F.when(block.isNotNull(), F.to_json(block)).otherwise(F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("say "), F.col("k")).alias("text")))))
    content = F.when(F.col("event_type") == "error", F.replace(content, F.lit('"name"'), F.lit('"tool_use_id"'))).otherwise(content)
    use = F.when(F.col("event_type") == "view", F.struct(F.col("k").alias("input_tokens"), (F.col("k") * 2).alias("output_tokens"), F.lit(1).alias("cache_read_input_tokens")))
    head = F.to_json(F.struct("type", F.col("session_id").alias("sessionId"), F.concat(F.lit("/b/"), "user_id").alias("cwd"), F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
                              F.when((F.col("k") % 3 != 0) & (F.col("event_type") == "view"), F.concat(F.lit("q"), F.col("k") % 4)).alias("requestId"), (F.col("k") % 9 == 0).alias("isSidechain"), (F.col("k") % 10 == 5).alias("isMeta"),
                              F.when((F.col("type") == "cost-state") & (F.col("k") % 4 != 0), F.col("value")).alias("totalCostUSD"),
                              F.when(F.col("type") == "cost-state", F.col("k") - 50).alias("totalLinesAdded"),
                              F.when((F.col("type") == "cost-state") & (F.col("k") % 2 == 0), F.create_map(F.lit("big"), F.struct(F.col("k").alias("inputTokens"), F.col("value").alias("costUSD")), F.lit("small"), F.struct(F.lit(5).alias("inputTokens"), F.lit(0.0).alias("costUSD")))).alias("modelUsage")))
    role = F.when(F.col("type") == "assistant", "assistant").otherwise("user")
    message = F.concat(F.lit(',"message":{"role":"'), role, F.lit('","usage":'), F.coalesce(F.to_json(use), F.lit("null")), F.lit(',"content":'), content, F.lit("}}"))
    line = F.when(F.col("type") == "cost-state", head).otherwise(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), message))
    return e.select("session_id", F.col("event_id").alias("seq"), line.alias("line"))


def b_tables(spark, d):
    return dialect_b.normalise(materialise(b_lines(spark, d)))


B_HUMAN = "event_type = 'signup' AND k % 9 <> 0 AND k % 10 <> 5"
query("s08_dialect_b_messages", "session_id:s seq:l role:s is_human:l has_results:l input:d",
      f"SELECT session_id, event_id AS seq, {B_TYPE} AS role, {B_HUMAN} AS is_human, event_type = 'error' AS has_results, CASE WHEN event_type = 'view' THEN k ELSE 0 END AS input FROM ev WHERE event_type <> 'purchase'", ["ev"])(
    lambda s, d: b_tables(s, d).messages)
query("s08_session_identity", "session_id:s record_session_id:s cwd:s start_ms:l stop_ms:l uses_subagent:l",
      "SELECT session_id, session_id AS record_session_id, concat('/b/', min(user_id)) AS cwd, min(ts_ms) AS start_ms, max(ts_ms) AS stop_ms, max(CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END) AS uses_subagent FROM ev GROUP BY 1", ["ev"])(
    lambda s, d: dialect_b.session_identity(b_tables(s, d).records))
ANCHORS = "am AS (SELECT session_id, event_id AS seq, ts_ms, event_type, max(CASE WHEN " + B_HUMAN + " OR event_type = 'error' THEN ts_ms END) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start_ms FROM ev)"
query("j15_model_anchor", "session_id:s seq:l start_ms:l end_ms:l", "SELECT session_id, seq, start_ms, ts_ms AS end_ms FROM am WHERE event_type IN ('view', 'click') AND ts_ms > start_ms", ["ev"], [ANCHORS])(
    lambda s, d: dialect_b.model_intervals(b_tables(s, d).messages))
COUNTED = (
    "ans AS (SELECT session_id, event_id, k, event_type, CASE WHEN event_type = 'view' AND k % 3 <> 0 THEN concat('q', k % 4) ELSE '' END AS rq FROM ev WHERE event_type IN ('view', 'click')), "
    "cnt AS (SELECT * FROM ans WHERE rq = '' UNION ALL (SELECT * FROM ans WHERE rq <> '' QUALIFY row_number() OVER (PARTITION BY session_id, rq ORDER BY event_id) = 1))"
)
query("j17_counted_responses", "session_id:s seq:l", "SELECT session_id, event_id AS seq FROM cnt", ["ev"], [COUNTED])(lambda s, d: dialect_b.counted_responses(b_tables(s, d).messages))
query("j16_superseding_cost", "session_id:s input:d output:d cost:d cost_recorded:l state_lines_added:l",
      "SELECT s.session_id, CASE WHEN l.k % 2 = 0 THEN l.k + 5 ELSE coalesce(c.i, 0) END AS input, CASE WHEN l.k % 2 = 0 THEN 0 ELSE coalesce(c.o, 0) END AS output, CASE WHEN l.k % 4 <> 0 THEN l.value ELSE 0 END AS cost, CASE WHEN l.k % 4 <> 0 THEN 1 ELSE 0 END AS cost_recorded, "
      "CASE WHEN l.k > 50 THEN l.k - 50 END AS state_lines_added FROM (SELECT DISTINCT session_id FROM ev) s LEFT JOIN (SELECT session_id, k, value FROM ev WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) = 1) l USING (session_id) "
      "LEFT JOIN (SELECT session_id, sum(CASE WHEN event_type = 'view' THEN k ELSE 0 END) AS i, sum(CASE WHEN event_type = 'view' THEN 2 * k ELSE 0 END) AS o FROM cnt GROUP BY 1) c USING (session_id)", ["ev"], [COUNTED])(
    lambda s, d: b_usage(b_tables(s, d)))


def b_usage(tables):
    return dialect_b.session_usage(tables.messages, tables.cost_states)


def flat_tables(spark, d):
    return dialect_b.log_tables(b_lines(spark, d))


def both_sources(spark, d):
    """Sessions and records per source, through both dialects."""
    of = lambda t: t.header.select("source", F.lit(1).alias("sessions"), F.lit(0).alias("records")).unionByName(
        t.messages.groupBy("source").agg(F.lit(0).alias("sessions"), F.count("*").cast("int").alias("records")).select("source", "sessions", "records"))
    return of(a_tables(spark, d)).unionByName(of(flat_tables(spark, d))).groupBy("source").agg(F.sum("sessions").alias("sessions"), F.sum("records").alias("records"))


query("s06_sources_apart", "source:s sessions:l records:l",
      "SELECT 'a' AS source, count(DISTINCT session_id) AS sessions, count(*) AS records FROM messages UNION ALL SELECT 'b', count(DISTINCT session_id), count(*) FILTER (event_type <> 'purchase') FROM ev", ["messages", "ev"])(both_sources)
FLAT_CALLS = (
    "fcalls AS (SELECT session_id, concat('c', k % 7) AS call_id, event_id AS seq, ts_ms, CASE k % 3 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' ELSE 'Task' END AS tool FROM ev WHERE event_type = 'click' "
    "QUALIFY row_number() OVER (PARTITION BY session_id, k % 7 ORDER BY event_id) = 1)"
)
query("a04_flat_tool_counts", "session_id:s tool:s n:l", "SELECT session_id, tool, count(*) AS n FROM fcalls GROUP BY ALL", ["ev"], [FLAT_CALLS])(lambda s, d: tools.tool_counts(flat_tables(s, d).tool_calls))
LAST_STATE = (
    "st AS (SELECT session_id, k, value FROM ev WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) = 1), "
    "fuse AS (SELECT session_id, 'big' AS model, k::DOUBLE AS input, value AS cost FROM st WHERE k % 2 = 0 UNION ALL SELECT session_id, 'small', 5, 0 FROM st WHERE k % 2 = 0 "
    "UNION ALL SELECT session_id, 'unknown', 0, CASE WHEN k % 4 <> 0 THEN value ELSE 0 END - CASE WHEN k % 2 = 0 THEN value ELSE 0 END FROM st "
    "UNION ALL SELECT session_id, 'unknown', CASE WHEN event_type = 'view' THEN k ELSE 0 END, 0 FROM cnt WHERE session_id NOT IN (SELECT session_id FROM st WHERE k % 2 = 0))"
)
query("a02_flat_models", "model:s input:d cost:d", f"SELECT model, {dec('input')} AS input, {dec('cost')} AS cost FROM fuse GROUP BY 1", ["ev"], [COUNTED, LAST_STATE])(
    lambda s, d: usage.usage_by_model(flat_tables(s, d).usage_events).select("model", F.col("input_tokens").alias("input"), "cost"))

# --- forks ---------------------------------------------------------------------------

# Week w of a user forks week w-1 unless w % 3 = 0, and copies its even records.
WEEK = "CAST(split_part(session_id, '-w', 2) AS BIGINT)"


def fork_header(spark, d):
    # Stored: filters on the parent would move below the distinct and run their patterns for each event.
    own = materialise(m.events(spark, d).select("session_id", "user_id").distinct()).withColumn("w", F.expr(WEEK))
    parent = F.concat(F.lit("u"), "user_id", F.lit("-w"), F.col("w") - 1)
    path = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("/logs/p/2024_"), parent, F.lit(".jsonl"))).otherwise(parent)
    return own.withColumn("parent_session", F.when(F.col("w") % 3 != 0, path))


def fork_records(spark, d):
    """Own records, and copies of the parent's (and grandparent's) even ones."""
    e = m.events(spark, d).select("session_id", "user_id", "event_id", "value", "event_type").withColumn("w", F.expr(WEEK))
    name = F.when(F.col("event_type") == "view", "x/y").otherwise("")
    base = e.select("session_id", "user_id", "w", F.concat(F.lit("r"), "event_id").alias("rec_id"), name.alias("sidecar_name"), "value")
    copy = lambda k: base.where(F.col("rec_id").rlike("[02468]$")).withColumn("session_id", F.concat(F.lit("u"), "user_id", F.lit("-w"), F.col("w") + k))
    return base.unionByName(copy(1)).unionByName(copy(2)).drop("user_id", "w").join(base.select("session_id").distinct(), "session_id", "left_semi")


FORKS = (
    "ses AS (SELECT DISTINCT session_id, user_id, " + WEEK + " AS w FROM ev), "
    "links AS (SELECT s.session_id, p.session_id AS parent FROM ses s JOIN ses p ON p.user_id = s.user_id AND p.w = s.w - 1 WHERE s.w % 3 <> 0), "
    "walk AS (SELECT session_id, parent AS ancestor FROM links UNION SELECT w.session_id, l.parent FROM walk w JOIN links l ON l.session_id = w.ancestor)"
)
BASE = (
    ", base AS (SELECT session_id, user_id, " + WEEK + " AS w, concat('r', event_id) AS rec_id, event_id, CASE WHEN event_type = 'view' THEN 'x/y' ELSE '' END AS sidecar_name, value FROM ev), "
    "recs AS (SELECT * FROM (SELECT session_id, rec_id, sidecar_name, value FROM base UNION ALL SELECT concat('u', user_id, '-w', w + 1), rec_id, sidecar_name, value FROM base WHERE event_id % 2 = 0 "
    "UNION ALL SELECT concat('u', user_id, '-w', w + 2), rec_id, sidecar_name, value FROM base WHERE event_id % 2 = 0) WHERE session_id IN (SELECT session_id FROM ses))"
)


def fork_links(spark, d):
    return materialise(forks.parent_links(fork_header(spark, d)))


query("j05_fork_ancestors", "session_id:s ancestor:s", "SELECT * FROM walk", ["ev"], ["walk_dummy AS (SELECT 1)", FORKS])(lambda s, d: forks.ancestors(fork_links(s, d)))
KEEP = "SELECT r.* FROM recs r WHERE NOT EXISTS (SELECT 1 FROM walk w JOIN recs a ON a.session_id = w.ancestor WHERE w.session_id = r.session_id AND a.rec_id = r.rec_id AND a.sidecar_name = r.sidecar_name)"
query("j05_fork_exclusion", "session_id:s rec_id:s value:d", KEEP + " AND r.sidecar_name = ''", ["ev"], ["walk_dummy AS (SELECT 1)", FORKS + BASE])(
    lambda s, d: forks.drop_copied(materialise(fork_records(s, d).where("sidecar_name = ''")), forks.fork_trees(fork_links(s, d))))
query("j06_sidecar_fork_exclusion", "session_id:s sidecar_name:s records:l cost:d", f"SELECT session_id, sidecar_name, count(*) AS records, {dec('value')} AS cost FROM ({KEEP}) GROUP BY 1, 2", ["ev"], ["walk_dummy AS (SELECT 1)", FORKS + BASE])(
    lambda s, d: forks.drop_copied(materialise(fork_records(s, d)), forks.fork_trees(fork_links(s, d))).groupBy("session_id", "sidecar_name").agg(F.count("*").alias("records"), numeric.exact_sum(F.col("value")).alias("cost")))


# --- log files -----------------------------------------------------------------------

# Records of a session go to its log and two sidecars by seq; a user's weeks are
# a chain of forks, each with a copy of the records of the week before.
LOG_OF = "CASE seq % 5 WHEN 3 THEN 'advisor' WHEN 4 THEN 'subagent' ELSE 'primary' END"


SLICE_RECORDS = 6_000_000  # fixed value: messages whose logs lie on disk at a time


def tree_lines(spark, d, k: int = 0, slices: int = 1) -> DataFrame:
    """(path, session_id, kind, seq, line): the mapped messages as a tree of logs with forks and sidecars.

    Of several slices the k-th: all logs of its users, so whole fork trees.
    """
    own = a_lines(spark, d).where("seq >= 0").where(F.pmod(F.xxhash64(F.split("session_id", "-w")[0]), F.lit(slices)) == k)
    own = own.select("session_id", "seq", "line").withColumn("kind", F.expr(LOG_OF))
    own = materialise(own.withColumn("user", F.split("session_id", "-w")[0]).withColumn("w", F.expr(WEEK)))
    copies = own.where("w % 3 <> 2 and kind <> 'advisor'").withColumn("w", F.col("w") + 1).withColumn("session_id", F.concat_ws("-w", "user", "w")).withColumn("copy", F.lit(0))
    copies = copies.join(own.select("session_id").distinct(), "session_id", "left_semi")
    body = own.withColumn("copy", F.lit(1)).unionByName(copies)
    heads = own.groupBy("session_id", "user", "w").agg(F.min(F.get_json_object("line", "$.timestamp")).alias("at")).withColumn("line", F.to_json(F.struct(
        F.lit("session").alias("type"), F.col("session_id").alias("id"), F.col("at").alias("timestamp"), F.concat(F.lit("/home/"), "user").alias("cwd"),
        F.when(F.col("w") % 3 != 0, F.concat_ws("-w", "user", F.col("w") - 1)).alias("parentSession")))).select(
        "session_id", F.lit("primary").alias("kind"), F.lit(-1).cast("bigint").alias("seq"), F.lit(0).alias("copy"), "line")
    rows = body.select("session_id", "kind", "seq", "copy", "line").unionByName(heads)
    log = F.concat(F.lit("p/2024_"), "session_id")
    path = F.when(F.col("kind") == "primary", F.concat(log, F.lit(".jsonl"))).when(F.col("kind") == "advisor", F.concat(log, F.lit("/__advisor.jsonl"))).otherwise(F.concat(log, F.lit("/x/x.Sub.jsonl")))
    # Copies come first, as in a fork; seq alone orders a log's lines.
    return rows.select("session_id", "kind", path.alias("path"), (F.col("copy") * (1 << 40) + F.col("seq")).alias("seq"), "line")


def tree_slices(spark, d) -> Iterator[DataFrame]:
    """The lines of all logs in slices of bounded size, each with whole fork trees."""
    slices = max(1, -(-m.messages(spark, d).count() // SLICE_RECORDS))
    for k in range(slices):
        lines = tree_lines(spark, d, k, slices)
        if slices == 1 or not lines.isEmpty():  # few users may leave a slice empty
            yield lines


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def of_logs(spark, d, *work: Callable[[str], DataFrame | tuple[DataFrame, ...]]) -> list[DataFrame]:
    """What each work makes of a log folder, united over the slices.

    Only one slice's logs lie on disk at a time, so the results must be stored.
    """
    found = []
    for lines in tree_slices(spark, d):
        with written_logs(lines) as root:
            made = [w(root) for w in work]
            found.append([x for y in made for x in (y if isinstance(y, tuple) else (y,))])
    return [united(list(parts)) for parts in zip(*found)]


def parsed(spark) -> Callable[[str], tuple[DataFrame, DataFrame]]:
    return lambda root: build.parsed_logs(spark, root)


TREE = (
    f"owned AS (SELECT session_id, split_part(session_id, '-w', 1) AS usr, {WEEK} AS w, seq, role, is_error, cost, {LOG_OF} AS kind FROM messages), "
    "copied AS (SELECT o.*, concat(usr, '-w', w + 1) AS fork FROM owned o WHERE w % 3 <> 2 AND kind <> 'advisor'), "
    "held AS (SELECT session_id, kind, role, cost FROM owned UNION ALL SELECT fork, kind, role, cost FROM copied WHERE fork IN (SELECT session_id FROM owned)), "
    # A copy of week w - 1 in week w is dropped where that week is the parent; it always is, as copies follow links.
    "clean AS (SELECT * FROM owned)"
)
query("s01_log_scan", "session_id:s kind:s records:l", "SELECT session_id, kind, count(*) AS records FROM (SELECT session_id, kind FROM held UNION ALL SELECT DISTINCT session_id, 'primary' FROM owned) GROUP BY ALL", ["messages"], [TREE])(
    lambda s, d: of_logs(s, d, lambda root: materialise(logs.read_corpus(s, root, "a")[1].groupBy("session_id", "kind").agg(F.count("*").alias("records"))))[0])


def session_costs(files, tables, dialect):
    """The tables that the store query keeps: cost by class of each session."""
    return {"sessions": usage.fold_sidecars(tables.usage_events), "files": files}


def refreshed_store(spark, d) -> DataFrame:
    """Costs after two refreshes: every seventh user's logs lack their last third at first.

    A store for each slice, as a store holds what its log folder holds.
    """
    return united([refreshed_slice(spark, lines) for lines in tree_slices(spark, d)])


def refreshed_slice(spark, lines: DataFrame) -> DataFrame:
    place = new_folder(spark, "store")
    lines = materialise(lines)
    late = (F.crc32(F.split("session_id", "-w")[0].cast("binary")) % 7 == 0) & (F.col("seq") % 3 == 2)
    with written_logs(lines.where(~late)) as root:
        store.refresh(spark, root, place, tables_of_sessions=session_costs)
        again = lines.join(lines.where(late).select("path").distinct(), "path", "left_semi")
        write_logs(again, root)
        version = store.refresh(spark, root, place, tables_of_sessions=session_costs)
    return version.parts["sessions"]


CLASSES = ", ".join(f"coalesce({dec(f'CASE WHEN kind = {chr(39)}{k}{chr(39)} THEN cost ELSE 0 END')}, 0) AS cost_{k}" for k in ("primary", "advisor", "subagent"))
query("s12_incremental_build", "session_id:s cost_primary:d cost_advisor:d cost_subagent:d total_cost:d",
      f"SELECT session_id, {CLASSES}, {dec('cost')} AS total_cost FROM clean WHERE role = 'assistant' GROUP BY 1", ["messages"], [TREE])(refreshed_store)


def raw_lines(spark, root) -> DataFrame:
    """(session_id, kind, line) of all logs, stored."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root)
    hidden = logs.read_logs(logs.find_logs(logs.list_files(spark, root), root, "a")[1].where("kind = 'advisor'"))
    name = F.regexp_extract("path", r"/2024_([^/]+?)(?:\.jsonl|/)", 1)
    seen = text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).select(
        name.alias("session_id"), F.when(F.col("path").contains("/x/"), "subagent").otherwise("primary").alias("kind"), "line")
    return materialise(seen.unionByName(hidden.select("session_id", "kind", "line")))


def raw_costs(seen: DataFrame) -> DataFrame:
    """Cost by class summed straight from the files' lines, copies left out by the parents' lines.

    Reads the text itself and shares neither scan, parser nor fork labels with
    the build: one level of parents is looked up at a time.
    """
    field = lambda c, p: F.get_json_object(c, "$." + p)
    parents = seen.where(field("line", "type") == "session").select("session_id", field("line", "parentSession").alias("parent")).where("parent is not null")
    costs = seen.where(field("line", "message.role") == "assistant").select("session_id", "kind", field("line", "id").alias("rec"), F.coalesce(field("line", "message.usage.cost.total").cast("double"), F.lit(0.0)).alias("cost"))
    all_ids = seen.select(F.col("session_id").alias("parent"), "kind", field("line", "id").alias("rec")).where("rec is not null").distinct()
    up = parents
    for _ in range(3):  # chains of the mapping have three weeks
        costs = costs.join(up.join(all_ids, "parent").select("session_id", "kind", "rec").distinct(), ["session_id", "kind", "rec"], "left_anti")
        up = up.join(parents.select(F.col("session_id").alias("parent"), F.col("parent").alias("next")), "parent").select("session_id", F.col("next").alias("parent"))
    return costs


def reconciled(spark, d) -> DataFrame:
    files, records, lines = of_logs(spark, d, parsed(spark), lambda root: raw_lines(spark, root))
    _, tables = build.tables_of_records(files, records)
    return refresh.reconcile(raw_costs(lines), usage.fold_sidecars(tables.usage_events))


query("j24_reconciliation", "class:s reported:d recomputed:d matches:l",
      f"SELECT kind AS class, {dec('cost')} AS reported, {dec('cost')} AS recomputed, CASE WHEN abs({dec('cost')} - {dec('cost')}) < 1e-6 THEN 1 ELSE 0 END AS matches FROM clean WHERE role = 'assistant' GROUP BY 1", ["messages"], [TREE])(reconciled)


# What sidecars did: failed results, and active time by the partition of each
# log of its own: covered stretches and the first quarter of an hour of gaps.
SIDE_TIME = (
    "sm AS (SELECT session_id, kind, ts_ms, is_human, coalesce(completed_ms, ts_ms) AS end_ms, coalesce(completed_ms, ts_ms) - CAST(coalesce(ttft_ms, 0) + coalesce(duration_ms, 0) AS BIGINT) AS start_ms, role, is_error "
    f"FROM (SELECT *, {LOG_OF} AS kind FROM messages) WHERE kind <> 'primary'), "
    "si AS (SELECT session_id, kind, start_ms, end_ms FROM sm WHERE role = 'assistant' AND end_ms > start_ms), "
    "sr AS (SELECT session_id, kind, coalesce(min(CASE WHEN is_human THEN ts_ms END), min(first_ms)) AS lo, max(last_ms) AS hi, count(*) FILTER (role = 'toolResult' AND is_error) AS errors FROM "
    "(SELECT session_id, kind, ts_ms, is_human, role, is_error, CASE WHEN role = 'assistant' AND end_ms > start_ms THEN least(ts_ms, end_ms) ELSE ts_ms END AS first_ms, CASE WHEN role = 'assistant' AND end_ms > start_ms THEN greatest(ts_ms, end_ms) ELSE ts_ms END AS last_ms FROM sm) GROUP BY 1, 2), "
    "sc AS (SELECT i.session_id, i.kind, greatest(start_ms, lo) AS a, least(end_ms, greatest(hi, lo)) AS b FROM si i JOIN sr USING (session_id, kind) WHERE greatest(start_ms, lo) < least(end_ms, greatest(hi, lo))), "
    "so AS (SELECT session_id, kind, a, b, max(b) OVER (PARTITION BY session_id, kind ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sc), "
    # Gaps: before each covered stretch, and after the last one.
    "sg AS (SELECT session_id, kind, greatest(b - greatest(a, coalesce(before, a)), 0) AS covered, greatest(a - coalesce(before, lo), 0) AS gap FROM so JOIN sr USING (session_id, kind) "
    "UNION ALL SELECT session_id, kind, 0, greatest(hi, lo) - coalesce((SELECT max(b) FROM sc WHERE sc.session_id = sr.session_id AND sc.kind = sr.kind), lo) FROM sr), "
    "sa AS (SELECT session_id, sum(covered + least(gap, 900000)) / 1000.0 AS busy_sec FROM sg GROUP BY 1)"
)
query("j07_sidecar_activity", "session_id:s sidecar_tool_calls:l sidecar_tool_errors:l busy_sec:d",
      "SELECT session_id, 0 AS sidecar_tool_calls, errors AS sidecar_tool_errors, busy_sec FROM (SELECT session_id, sum(errors) AS errors FROM sr GROUP BY 1) JOIN sa USING (session_id)", ["messages"], [SIDE_TIME])(
    lambda s, d: build.sidecar_activity(build.tables_of_records(*of_logs(s, d, parsed(s)))[1], build.DialectA()))


def report_counts(spark, d) -> DataFrame:
    """Scan accounting and totals of a whole report over written logs."""
    from worktrail.operators.usage import provider_basis

    basis = provider_basis(spark.createDataFrame([("none", "api_key", 1)], "provider string, credential_type string, row_no int"))
    parts = build.session_tables(*build.tables_of_records(*of_logs(spark, d, parsed(spark))))
    report = build.corpus_tables(parts, basis, now_ms=2_000_000_000_000)
    return report["scan"].join(report["totals"].select("corpus", "total_cost"), "corpus", "left")


HEADS = (
    "hd AS (SELECT session_id, min(ts_ms) AS first_ms, max(CASE WHEN kind = 'primary' THEN ts_ms END) AS last_ms, count(*) FILTER (kind = 'primary' AND is_human) AS humans, "
    "max(CASE WHEN kind = 'advisor' THEN 1 ELSE 0 END) AS adv, " + dec("CASE WHEN role = 'assistant' THEN cost ELSE 0 END") + " AS cost FROM (SELECT *, " + LOG_OF + " AS kind FROM messages) GROUP BY 1), "
    "subs AS (SELECT session_id FROM owned WHERE kind = 'subagent' UNION SELECT fork FROM copied WHERE kind = 'subagent' AND fork IN (SELECT session_id FROM owned)), "
    "ok AS (SELECT *, humans >= 2 AND floor((greatest(last_ms, first_ms) - first_ms) / 60000.0 + 0.5) >= 1 AS good FROM hd)"
)
query("s15_report_counts", "primary_logs:l duplicate_logs:l advisor_logs:l subagent_logs:l excluded_meta:l excluded_unparsed:l sessions_scanned:l excluded_not_substantive:l included:l excluded_tooling:l facet_failures:l total_cost:d",
      f"SELECT count(*) AS primary_logs, 0 AS duplicate_logs, sum(adv) AS advisor_logs, (SELECT count(*) FROM subs) AS subagent_logs, 0 AS excluded_meta, 0 AS excluded_unparsed, count(*) AS sessions_scanned, count(*) FILTER (NOT good) AS excluded_not_substantive, "
      f"count(*) FILTER (good) AS included, 0 AS excluded_tooling, 0 AS facet_failures, {dec('CASE WHEN good THEN cost ELSE 0 END')} AS total_cost FROM ok", ["messages"], [TREE, HEADS])(report_counts)
