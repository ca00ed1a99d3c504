"""Queries on time accounting: intervals, partition, rollup, levers."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.catalog import mapping as m
from worktrail.catalog.mapping import dec
from worktrail.catalog.registry import query
from worktrail.catalog.session_queries import DELIVERED
from worktrail.functions.text import names_review
from worktrail.functions.waits import command_family, is_heavy_model, wait_kind
from worktrail.operators import activity, timerollup, timesplit
from worktrail.session import materialise

# --- T1, T2, J4: where intervals come from ----------------------------------------

query("t1_model_intervals", "session_id:s start_ms:l end_ms:l",
      "SELECT session_id, coalesce(completed_ms, ts_ms) - CAST(ttft_ms + duration_ms AS BIGINT) AS start_ms, coalesce(completed_ms, ts_ms) AS end_ms "
      "FROM messages WHERE role = 'assistant' AND ttft_ms + duration_ms > 0", ["messages"])(
    lambda s, d: timesplit.model_intervals(m.messages(s, d)))

# The mapped commands, with the answer the classifier must give for each.
FAMILY_OF_COMMAND = m.pick("k % 10", ["git commit", "git push", "npm test", "polling: ci", "polling: orca", "pytest", "tsc", "polling: generic", "ruff check", "polling: ci"])
KIND_OF_COMMAND = "CASE k % 10 WHEN 3 THEN 'ci' WHEN 4 THEN 'agents' WHEN 7 THEN 'polling' WHEN 9 THEN 'ci' END"
FAMILY_OF_CODE = "CASE k % 5 WHEN 0 THEN CASE k % 3 WHEN 1 THEN 'eval: js' ELSE 'eval: python' END WHEN 1 THEN 'eval: browser' WHEN 2 THEN 'npm test' WHEN 3 THEN 'polling: review' ELSE CASE k % 3 WHEN 0 THEN 'eval: python' ELSE 'eval: js' END END"
CALLS_PLUS = (
    f"calls_plus AS (SELECT session_id, concat('c', k % 7) AS call_id, event_id AS seq, k, {m.TOOL} AS tool, "
    f"CASE {m.TOOL} WHEN 'bash' THEN {FAMILY_OF_COMMAND} WHEN 'eval' THEN {FAMILY_OF_CODE} ELSE {m.TOOL} END AS family, "
    f"CASE {m.TOOL} WHEN 'bash' THEN {KIND_OF_COMMAND} WHEN 'eval' THEN CASE k % 5 WHEN 3 THEN 'review' END WHEN 'task' THEN 'agents' WHEN 'wait' THEN 'agents' END AS kind "
    "FROM ev WHERE event_type = 'view')"
)
query("c1_wait_kind", "session_id:s seq:l kind:s", "SELECT session_id, seq, kind FROM calls_plus", ["ev"], [CALLS_PLUS])(
    lambda s, d: m.tool_calls(s, d).withColumn("kind", wait_kind(F.col("tool"), F.coalesce(F.when(F.col("tool") == "bash", F.col("command")).otherwise(F.col("code")), F.lit("")))))
query("c3_command_family", "session_id:s seq:l family:s", "SELECT session_id, seq, family FROM calls_plus", ["ev"], [CALLS_PLUS])(
    lambda s, d: m.tool_calls(s, d).withColumn(
        "family", command_family(F.col("tool"), F.when(F.col("tool") == "bash", F.col("command")).when(F.col("tool") == "eval", F.col("code")).otherwise(""), F.col("language"))))
query("c2_whole_word_review", "doc_id:l n:l",
      "SELECT doc_id, CASE WHEN list_has_any(regexp_extract_all(concat(text, ' ', tag), '([A-Z]*[a-z]+|[A-Z]+|[0-9]+)', 1), ['review', 'Review', 'reviewer', 'approve', 'Approve']) THEN 1 ELSE 0 END AS n "
      "FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'PreviewPane' WHEN 1 THEN 'ReviewMR188' WHEN 2 THEN 'auto_approve' ELSE 'x' END AS tag FROM documents)")(
    lambda s, d: m.table(s, d, "documents").select("doc_id", names_review(F.concat_ws(" ", "text", F.expr(
        "CASE doc_id % 4 WHEN 0 THEN 'PreviewPane' WHEN 1 THEN 'ReviewMR188' WHEN 2 THEN 'auto_approve' ELSE 'x' END"))).alias("n")))
query("c4_heavy_model", "model:s heavy:l n:l",
      "SELECT model, CASE WHEN model IN ('alpha-opus', 'gamma-large', 'delta-pro') THEN 1 ELSE 0 END AS heavy, count(*) AS n FROM usage_events GROUP BY 1", ["usage_events"])(
    lambda s, d: m.usage_events(s, d).groupBy("model").agg(F.count("*").alias("n")).withColumn("heavy", is_heavy_model(F.col("model"))))

# Latest details per call id, and the bucket each call must get.
TIMED = DELIVERED + ", " + CALLS_PLUS + (
    ", det AS (SELECT session_id, call_id, arg_max(tool, seq) AS dtool, arg_max(k, seq) AS dk FROM calls_plus GROUP BY 1, 2), "
    "det2 AS (SELECT d.*, c.family AS dfamily, c.kind AS dkind FROM det d JOIN calls_plus c ON c.session_id = d.session_id AND c.call_id = d.call_id AND c.k = d.dk "
    "QUALIFY row_number() OVER (PARTITION BY d.session_id, d.call_id ORDER BY c.seq DESC) = 1), "
    # A start keeps its tool; command text comes from the latest call of the id.
    "tcalls AS (SELECT v.session_id, v.call_id, v.tool, v.started_ms, v.ts_ms, v.seq, v.text, "
    "CASE WHEN v.tool = 'ask' THEN 'you' WHEN v.tool = 'wait' THEN 'agents' "
    "WHEN v.tool = 'task' THEN CASE WHEN dk % 4 = 0 OR dk % 3 = 0 THEN 'review' ELSE 'agents' END "
    "WHEN v.tool IN ('bash', 'eval') AND dtool IN ('bash', 'eval') AND dkind IN ('ci', 'review', 'agents') THEN dkind ELSE 'tools' END AS bucket, "
    "CASE WHEN v.tool IN ('bash', 'eval') THEN CASE WHEN dtool = v.tool THEN dfamily END ELSE v.tool END AS family, "
    "greatest(0, v.ts_ms - v.started_ms) / 1000.0 AS busy_sec, "
    "CASE WHEN contains(v.text, 'Backgrounded as job') THEN regexp_extract(v.text, '(bg_[0-9]+)', 1) ELSE '' END AS job_id FROM delivered v JOIN det2 USING (session_id, call_id))"
)


def tool_intervals(spark, d):
    return timesplit.tool_intervals(m.tool_starts(spark, d), m.results(spark, d), m.tool_calls(spark, d))


query("t2_tool_intervals", "session_id:s call_id:s tool:s started_ms:l ts_ms:l bucket:s busy_sec:d", "SELECT * FROM tcalls", ["tool_starts", "results", "tool_calls"], [TIMED])(tool_intervals)

query("j04_background_jobs", "session_id:s start_ms:l end_ms:l bucket:s job_type:s",
      "SELECT j.session_id, delivery_ms - duration_ms AS start_ms, delivery_ms AS end_ms, job_type, "
      "CASE WHEN job_type = 'task' THEN CASE WHEN coalesce(a.agent, concat(j.job_id, ' ', label)) = 'CodeReviewer' OR (a.session_id IS NULL AND label = 'approve release') THEN 'review' ELSE 'agents' END ELSE 'tools' END AS bucket "
      "FROM async_jobs j LEFT JOIN (SELECT session_id, task_name AS job_id, arg_max(coalesce(task_agent, 'task'), seq) AS agent FROM tool_calls WHERE tool = 'task' GROUP BY ALL) a USING (session_id, job_id) "
      "WHERE job_type = 'task'", ["async_jobs", "tool_calls"])(
    lambda s, d: timesplit.job_intervals(m.async_jobs(s, d), tool_intervals(s, d), m.tool_calls(s, d)).where("job_type = 'task'"))

# Both kinds of job: a shell job waits for what the latest details of the call that was moved to it say, else for what its label says (nothing, as mapped).
JOB_OWNERS = (
    "moved AS (SELECT session_id, call_id, start_seq, max(seq) AS seq, max(CASE WHEN contains(text, 'Backgrounded as job') THEN regexp_extract(text, '(bg_[0-9]+)', 1) END) AS job_id FROM live GROUP BY ALL), "
    "job_owners AS (SELECT session_id, job_id, arg_max(call_id, seq) AS call_id FROM moved WHERE job_id IS NOT NULL GROUP BY ALL), "
    "job_agents AS (SELECT session_id, task_name AS job_id, arg_max(coalesce(task_agent, 'task'), seq) AS agent FROM tool_calls WHERE tool = 'task' GROUP BY ALL)"
)
query("j04_all_background_jobs", "session_id:s start_ms:l end_ms:l bucket:s job_type:s",
      "SELECT j.session_id, delivery_ms - duration_ms AS start_ms, delivery_ms AS end_ms, job_type, "
      "CASE WHEN job_type = 'task' THEN CASE WHEN a.agent = 'CodeReviewer' OR (a.agent IS NULL AND label = 'approve release') THEN 'review' ELSE 'agents' END "
      "WHEN dtool IN ('bash', 'eval') AND dkind IN ('ci', 'review', 'agents') THEN dkind ELSE 'tools' END AS bucket "
      "FROM async_jobs j LEFT JOIN job_agents a USING (session_id, job_id) LEFT JOIN job_owners o USING (session_id, job_id) "
      "LEFT JOIN det2 c ON c.session_id = j.session_id AND c.call_id = o.call_id", ["async_jobs", "tool_starts", "results", "tool_calls"], [TIMED, JOB_OWNERS])(
    lambda s, d: timesplit.job_intervals(m.async_jobs(s, d), tool_intervals(s, d), m.tool_calls(s, d)))


def busy_calls(spark, d):
    """Calls after job replacement, with their own user."""
    timed = tool_intervals(spark, d)
    return timesplit.effective_calls(timed, timesplit.job_intervals(m.async_jobs(spark, d), timed, m.tool_calls(spark, d)))


query("t5_busy_by_tool", "session_id:s tool:s busy_sec:d", f"SELECT session_id, tool, {dec('busy_sec')} AS busy_sec FROM tcalls GROUP BY ALL",
      ["tool_starts", "results", "tool_calls"], [TIMED])(
    lambda s, d: timesplit.busy_by(tool_intervals(s, d), "tool"))
# The first shell job that comes before its call is closed takes the call's place.
# Code that ran as a shell job reads as a command.
CODE_AS_COMMAND = m.pick("dk % 5", ["import os", "await browser.goto(1)", 'subprocess.run("npm test")', "polling: review", "console.log(1)"])
AFTER_JOBS = (
    "owner_rows AS (SELECT session_id, job_id, arg_max(call_id, seq) AS call_id, max(seq) AS seq FROM moved WHERE job_id IS NOT NULL GROUP BY ALL), "
    "job_rows AS (SELECT j.session_id, j.seq, j.job_type, j.duration_ms / 1000.0 AS busy_sec, j.label, o.call_id, CASE WHEN t.job_id = '' THEN t.seq END AS closed_seq, c.dtool, c.dk, c.dfamily, c.dkind "
    "FROM async_jobs j LEFT JOIN owner_rows o USING (session_id, job_id) LEFT JOIN tcalls t ON t.session_id = o.session_id AND t.call_id = o.call_id AND t.seq = o.seq "
    "LEFT JOIN det2 c ON c.session_id = j.session_id AND c.call_id = o.call_id), "
    "replaced AS (SELECT DISTINCT session_id, call_id FROM job_rows WHERE job_type = 'bash' AND call_id IS NOT NULL AND (closed_seq IS NULL OR seq < closed_seq)), "
    # A shell or code call whose latest details are another tool's has no text.
    f"after_jobs AS (SELECT coalesce(family, CASE t.tool WHEN 'bash' THEN CASE dtool WHEN 'eval' THEN {CODE_AS_COMMAND} ELSE 'bash' END WHEN 'eval' THEN CASE dk % 3 WHEN 0 THEN 'eval: python' ELSE 'eval: js' END END) AS family, busy_sec "
    "FROM tcalls t JOIN det2 USING (session_id, call_id) WHERE bucket = 'tools' AND (session_id, call_id) NOT IN (SELECT (session_id, call_id) FROM replaced) "
    f"UNION ALL SELECT CASE dtool WHEN 'bash' THEN dfamily WHEN 'eval' THEN {CODE_AS_COMMAND} ELSE label END, busy_sec FROM job_rows WHERE job_type = 'bash' AND NOT (coalesce(dtool, '') IN ('bash', 'eval') AND coalesce(dkind, '') IN ('ci', 'review', 'agents')))"
)
query("t5_busy_after_jobs", "family:s busy_sec:d", f"SELECT family, {dec('busy_sec')} AS busy_sec FROM after_jobs WHERE family IS NOT NULL GROUP BY 1",
      ["async_jobs", "tool_starts", "results", "tool_calls"], [TIMED, JOB_OWNERS, AFTER_JOBS])(
    lambda s, d: timesplit.busy_by(busy_calls(s, d), "family", ()))

# --- T3, T4, T6: the partition ------------------------------------------------------

BUCKET = ("CASE event_type WHEN 'view' THEN 'model' WHEN 'click' THEN 'tools' "
          "WHEN 'purchase' THEN CASE k % 3 WHEN 0 THEN 'ci' WHEN 1 THEN 'review' ELSE 'agents' END ELSE CASE k % 2 WHEN 0 THEN 'you' ELSE 'agents' END END")
INTERVAL_COLUMNS = {
    "user_id": "user_id", "session_id": "session_id", "start_ms": "ts_ms - CAST(floor(value * 60000) AS BIGINT)", "end_ms": "ts_ms",
    "bucket": BUCKET, "background": "k % 7 = 0 AND event_type IN ('click', 'purchase')",
}
FAMILY_COLUMN = f"CASE WHEN event_type = 'click' THEN {FAMILY_OF_COMMAND} END"
IV = ("iv AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in INTERVAL_COLUMNS.items()) + f", {FAMILY_COLUMN} AS family FROM ev WHERE event_type <> 'signup')")


def intervals(spark, d):
    return m.events(spark, d).where("event_type <> 'signup'").select(
        *[F.expr(e).alias(n) for n, e in INTERVAL_COLUMNS.items()], F.expr(FAMILY_COLUMN).alias("family"))


def humans(spark, d):
    return m.messages(spark, d).where("is_human")


def split(spark, d):
    """(segments, gaps) of the mapped intervals."""
    ranges = timesplit.session_ranges(m.messages(spark, d), humans(spark, d))
    segments = timesplit.time_segments(intervals(spark, d), ranges, humans(spark, d))
    return segments, materialise(timesplit.gap_pieces(segments))


PRIO = ("CASE WHEN background THEN CASE bucket WHEN 'ci' THEN 0.505 WHEN 'review' THEN 0.504 WHEN 'agents' THEN 0.503 ELSE 0.502 END ELSE "
        "CASE bucket WHEN 'ci' THEN 5 WHEN 'review' THEN 4 WHEN 'agents' THEN 3 WHEN 'tools' THEN 2 WHEN 'model' THEN 1 ELSE 0 END END")
CELLS = IV + (
    ", hum AS (SELECT session_id, seq, ts_ms, text FROM messages WHERE is_human), "
    "rng AS (SELECT m.session_id, coalesce(h.lo, min(m.ts_ms)) AS lo, max(m.ts_ms) AS hi FROM messages m LEFT JOIN "
    "(SELECT session_id, min(ts_ms) AS lo FROM hum GROUP BY 1) h USING (session_id) GROUP BY m.session_id, h.lo), "
    "pts AS (SELECT session_id, lo AS t FROM rng UNION SELECT session_id, hi FROM rng UNION SELECT session_id, ts_ms FROM hum "
    "UNION SELECT i.session_id, least(greatest(i.start_ms, lo), hi) FROM iv i JOIN rng USING (session_id) UNION SELECT i.session_id, least(greatest(i.end_ms, lo), hi) FROM iv i JOIN rng USING (session_id)), "
    "cell AS (SELECT * FROM (SELECT session_id, t, lead(t) OVER (PARTITION BY session_id ORDER BY t) AS t2 FROM pts) WHERE t2 IS NOT NULL), "
    f"own AS (SELECT c.session_id, c.t, c.t2, arg_max(i.bucket, {PRIO}) AS owner FROM cell c LEFT JOIN iv i ON i.session_id = c.session_id AND i.start_ms <= c.t AND i.end_ms >= c.t2 GROUP BY ALL), "
    "req AS (SELECT o.*, (SELECT count(DISTINCT ts_ms) FROM hum h WHERE h.session_id = o.session_id AND h.ts_ms <= o.t) AS request_no FROM own o), "
    "gap0 AS (SELECT *, CASE WHEN lag(t2) OVER w = t THEN 0 ELSE 1 END AS brk, CASE WHEN lag(t2) OVER w = t AND lag(request_no) OVER w = request_no THEN 0 ELSE 1 END AS rbrk FROM req WHERE owner IS NULL WINDOW w AS (PARTITION BY session_id ORDER BY t)), "
    "gap1 AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY t) AS g, sum(rbrk) OVER (PARTITION BY session_id ORDER BY t) AS rg FROM gap0), "
    "gaps AS (SELECT session_id, min(t) AS s, max(t2) AS e FROM gap1 GROUP BY session_id, g), "
    "rgaps AS (SELECT session_id, request_no, min(t) AS s, max(t2) AS e FROM gap1 GROUP BY session_id, request_no, rg)"
)
WIDE = ", ".join(f"coalesce(sum(ms) FILTER (bucket = '{b}'), 0) / 1000.0 AS {b}" for b in ("model", "tools", "agents", "review", "ci", "you", "idle"))
SPLIT = CELLS + (
    ", parts AS (SELECT session_id, owner AS bucket, t2 - t AS ms FROM own WHERE owner IS NOT NULL UNION ALL SELECT session_id, 'you', least(e - s, 900000) FROM gaps "
    "UNION ALL SELECT session_id, 'idle', greatest(e - s - 900000, 0) FROM gaps), "
    f"split AS (SELECT *, model + tools + agents + review + ci + you AS active_sec FROM (SELECT session_id, {WIDE} FROM parts GROUP BY 1)), "
    "rparts AS (SELECT session_id, request_no, owner AS bucket, t2 - t AS ms FROM req WHERE owner IS NOT NULL UNION ALL SELECT session_id, request_no, 'you', least(e - s, 900000) FROM rgaps "
    "UNION ALL SELECT session_id, request_no, 'idle', greatest(e - s - 900000, 0) FROM rgaps), "
    f"rsplit AS (SELECT session_id, request_no, {WIDE} FROM rparts WHERE request_no > 0 GROUP BY ALL), "
    "rtimes AS (SELECT *, model + tools + agents + review + ci + you + idle AS wall_sec, model + tools + agents + review + ci + you AS active_sec, "
    "CASE greatest(model, tools, agents, review, ci, you) WHEN model THEN 'model' WHEN tools THEN 'tools' WHEN agents THEN 'agents' WHEN review THEN 'review' WHEN ci THEN 'ci' ELSE 'you' END AS dominant FROM rsplit)"
)
SPLIT_SPEC = "session_id:s model:d tools:d agents:d review:d ci:d you:d idle:d active_sec:d"
query("t3_priority_partition", "session_id:s owner:s ms:l",
      "SELECT session_id, coalesce(owner, 'gap') AS owner, sum(t2 - t) AS ms FROM own GROUP BY ALL", ["messages"], [CELLS])(
    lambda s, d: split(s, d)[0].where("inside").groupBy("session_id", F.coalesce("owner", F.lit("gap")).alias("owner")).agg(F.sum(F.col("t2") - F.col("t")).alias("ms")))
query("t4_gap_split", SPLIT_SPEC, "SELECT * FROM split", ["messages"], [SPLIT])(lambda s, d: timesplit.session_time(*split(s, d)))
query("t6_slowest_requests", "session_id:s request_no:l wall_sec:d active_sec:d dominant:s rank:l",
      "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY active_sec DESC, request_no) AS rank FROM rtimes QUALIFY rank <= 5", ["messages"], [SPLIT])(
    lambda s, d: timesplit.slowest_requests(timesplit.request_times(*split(s, d)), by=timesplit.active_sum()))  # unrounded, as in the SQL
YG = (
    ", yseg AS (SELECT session_id, t AS s, t2 AS e FROM own WHERE owner = 'you' UNION ALL SELECT session_id, s, least(e, s + 900000) FROM gaps), "
    "y0 AS (SELECT *, max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM yseg), "
    "y1 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY s, e) AS g FROM y0), "
    "ygaps AS (SELECT session_id, min(s) AS start_ms, max(e) AS end_ms FROM y1 GROUP BY session_id, g)"
)
query("t4_you_gaps", "session_id:s start_ms:l end_ms:l", "SELECT * FROM ygaps", ["messages"], [CELLS + YG])(lambda s, d: timesplit.you_gaps(*split(s, d)))

# --- J11, T7, T8, T9: the corpus ---------------------------------------------------

TEAM = "team"


def with_team(df):
    return df.withColumn(TEAM, F.regexp_extract("session_id", r"^u(\d+)-", 1).cast("bigint") % 10)


def elsewhere(spark, d, segments, gaps):
    return activity.busy_elsewhere(with_team(timesplit.you_gaps(segments, gaps)), with_team(m.messages(spark, d)), [TEAM])


ELSE = YG + (
    ", team_h AS (SELECT user_id % 10 AS team, session_id, ts_ms FROM messages WHERE is_human), "
    "yt AS (SELECT CAST(regexp_extract(session_id, '^u([0-9]+)-', 1) AS BIGINT) % 10 AS team, * FROM ygaps), "
    "elsewhere AS (SELECT * FROM yt y WHERE EXISTS (SELECT 1 FROM team_h h WHERE h.team = y.team AND h.session_id <> y.session_id AND h.ts_ms >= y.start_ms AND h.ts_ms < y.end_ms))"
)


def j11(spark, d):
    return elsewhere(spark, d, *split(spark, d))


query("j11_busy_elsewhere", "team:l session_id:s start_ms:l end_ms:l", "SELECT * FROM elsewhere", ["messages"], [CELLS + ELSE])(j11)


def moved_time(spark, d):
    segments, gaps = split(spark, d)
    return with_team(timerollup.elsewhere_seconds(timesplit.session_time(segments, gaps), elsewhere(spark, d, segments, gaps)))


MOVED = SPLIT + ELSE + (
    ", mv AS (SELECT session_id, sum(end_ms - start_ms) / 1000.0 AS moved FROM elsewhere GROUP BY 1), "
    "st AS (SELECT CAST(regexp_extract(session_id, '^u([0-9]+)-', 1) AS BIGINT) % 10 AS team, session_id, model, tools, agents, review, ci, "
    "you - least(coalesce(moved, 0), you) AS you, least(coalesce(moved, 0), you) AS elsewhere, idle FROM split LEFT JOIN mv USING (session_id)), "
    "tot AS (SELECT team, " + ", ".join(f"{dec(b)} AS {b}" for b in timesplit.BUCKETS) + ", count(*) AS sessions FROM st GROUP BY 1), "
    "tot2 AS (SELECT *, model + tools + agents + review + ci + you + elsewhere AS active_sec FROM tot), "
    "rollup_ AS (UNPIVOT (SELECT team, sessions, active_sec, idle AS idle_sec, " + ", ".join(timesplit.BUCKETS) + " FROM tot2) ON "
    + ", ".join(timesplit.BUCKETS) + " INTO NAME bucket VALUE seconds), "
    "rollup2 AS (SELECT *, CASE WHEN bucket = 'idle' THEN seconds / nullif(active_sec + idle_sec, 0) ELSE seconds / nullif(active_sec, 0) END AS share FROM rollup_)"
)


def rollup(spark, d, moved=None):
    return timerollup.time_rollup(moved_time(spark, d) if moved is None else moved, [TEAM])


query("t7_corpus_rollup", "team:l bucket:s seconds:d share:d sessions:l active_sec:d", "SELECT team, bucket, seconds, coalesce(share, 0) AS share, sessions, active_sec FROM rollup2",
      ["messages"], [MOVED])(rollup)


def families(spark, d, keys=(TEAM,)):
    rows = with_team(intervals(spark, d)).where("bucket = 'tools'").withColumn("busy_sec", (F.col("end_ms") - F.col("start_ms")) / 1000.0)
    return timesplit.busy_by(rows, "family", list(keys))


FAM = f", fam AS (SELECT user_id % 10 AS team, family, {dec('(end_ms - start_ms) / 1000.0')} AS busy_sec FROM iv WHERE bucket = 'tools' GROUP BY ALL)"
query("t5_busy_by_family", "team:l family:s busy_sec:d", "SELECT * FROM fam", ["messages"], [IV + FAM])(families)
query("t9_unrecognised_waiting", "team:l unrecognised_sec:d share:d",
      "SELECT f.team, u AS unrecognised_sec, CASE WHEN tools > 0 THEN u / tools ELSE 0 END AS share FROM (SELECT team, " + dec("CASE WHEN family = 'polling: generic' THEN busy_sec END")
      + " AS u FROM fam GROUP BY 1) f LEFT JOIN tot2 USING (team)", ["messages"], [MOVED + FAM])(
    lambda s, d: timerollup.unrecognised_waiting(families(s, d), rollup(s, d), [TEAM]))


def team_levers(spark, d, moved=None):
    cost = with_team(m.usage_events(spark, d)).groupBy(TEAM, "model").agg(F.sum("cost").alias("cost"))
    sub = with_team(intervals(spark, d)).where("background").groupBy(TEAM).agg(F.sum((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("busy_sec"))
    return timerollup.levers(rollup(spark, d, moved), families(spark, d), cost, sub, [TEAM])


LEVERS = MOVED + FAM + (
    ", topf AS (SELECT team, arg_max(family, busy_sec) AS family, max(busy_sec) AS fsec FROM fam WHERE family NOT LIKE 'polling: generic' GROUP BY 1), "
    "topm AS (SELECT user_id % 10 AS team, model, sum(cost) AS c FROM usage_events GROUP BY user_id % 10, model QUALIFY row_number() OVER (PARTITION BY user_id % 10 ORDER BY sum(cost) DESC, model) = 1), "
    "sub AS (SELECT user_id % 10 AS team, sum((end_ms - start_ms) / 1000.0) AS ssec FROM iv WHERE background GROUP BY 1), "
    "al AS (SELECT t.*, f.family, f.fsec, m.model AS mname, s.ssec FROM tot2 t LEFT JOIN topf f USING (team) LEFT JOIN topm m USING (team) LEFT JOIN sub s USING (team)), "
    "levers AS (SELECT team, 'command_family' AS lever, family AS subject, fsec AS seconds, fsec / active_sec AS share FROM al WHERE tools > 0 AND fsec / tools > 0.2 "
    "UNION ALL SELECT team, 'waiting_on_you', NULL, you, you / active_sec FROM al WHERE you / active_sec > 0.3 "
    "UNION ALL SELECT team, 'slow_model', mname, model, model / active_sec FROM al WHERE model > 0 AND model = greatest(model, tools, agents, review, ci, you, elsewhere) AND mname IN ('alpha-opus', 'gamma-large', 'delta-pro') "
    "UNION ALL SELECT team, 'serial_agent_waits', NULL, agents, agents / active_sec FROM al WHERE agents / active_sec > 0.2 AND coalesce(ssec, 0) < agents * 1.2 "
    "UNION ALL SELECT team, 'review_waits', NULL, review, review / active_sec FROM al WHERE review / active_sec > 0.15)"
)
query("t8_levers", "team:l lever:s subject:s seconds:d share:d", "SELECT * FROM levers", ["messages", "usage_events"], [LEVERS])(team_levers)
def lever_sessions(spark, d):
    moved = materialise(moved_time(spark, d))
    return timerollup.lever_evidence(team_levers(spark, d, moved), moved, families(spark, d, (TEAM, "session_id")), [TEAM])


query("t8_lever_evidence", "team:l lever:s session_id:s value:d rank:l",
      "SELECT team, lever, session_id, value, row_number() OVER (PARTITION BY team, lever ORDER BY value DESC, session_id) AS rank FROM ("
      "SELECT s.team, l.lever, s.session_id, CASE l.lever WHEN 'waiting_on_you' THEN you WHEN 'slow_model' THEN model WHEN 'serial_agent_waits' THEN agents ELSE review END AS value "
      "FROM st s JOIN levers l USING (team) WHERE l.lever <> 'command_family' UNION ALL "
      f"SELECT user_id % 10, 'command_family', session_id, {dec('(end_ms - start_ms) / 1000.0')} FROM iv JOIN levers l ON l.team = user_id % 10 AND l.lever = 'command_family' AND l.subject = iv.family "
      "WHERE bucket = 'tools' GROUP BY user_id % 10, session_id) WHERE value > 0 QUALIFY rank <= 3", ["messages", "usage_events"], [LEVERS])(
    lever_sessions)
