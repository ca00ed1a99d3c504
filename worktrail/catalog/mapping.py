"""Log tables derived from the star-schema test tables.

The test tables hold no session logs, so each log table is a deterministic
projection of them (no joins, no shuffles). Expressions are SQL text that both
Spark and the checking engine read, so only the operators differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEEK_MS = 604_800_000


def pick(index: str, values: list[str]) -> str:
    """CASE that picks the index-th text."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


PHRASES = [
    "no, use the other file", "please continue", "that is wrong again", "add a test for this",
    "stop on green", "wait for the pipeline", "fix the parser now", "thanks, fix the parser",
]
MODELS = ["alpha-opus", "beta-mini", "gamma-large", "delta-pro", "eps-sonnet", "zeta"]
PROVIDERS = ["north", "south", "east", "west"]
CALL_TOOLS = ["read", "write", "edit", "bash", "eval", "task", "ask", "wait"]
COMMANDS = [
    "cd /repo && git commit -m x", "git push origin main", "npm test", "gh run watch 12",
    "while true; do sleep 5; orca orchestration check --wait; done",
    "for f in a b; do pytest $f; done", "FOO=1 npx tsc -p .",
    "until curl localhost; do sleep 3; done", "uv run ruff check", "kubectl rollout status deploy/x",
]
CODE = [
    "import os", "await browser.goto(1)", "subprocess.run(\"npm test\")",
    "poll3(action=\"review MR\")", "console.log(1)",
]

TOOL = pick("k % 8", CALL_TOOLS)
MESSAGE_COLUMNS = {
    "user_id": "user_id", "session_id": "session_id", "seq": "event_id", "ts_ms": "ts_ms", "entry_ms": "ts_ms",
    "role": "CASE event_type WHEN 'signup' THEN 'user' WHEN 'view' THEN 'assistant' ELSE 'toolResult' END",
    "text": (
        f"CASE event_type WHEN 'signup' THEN concat({pick('k % 8', PHRASES)}, ' ', k) "
        "WHEN 'view' THEN concat('working on step ', k) "
        "WHEN 'error' THEN CASE WHEN k % 4 = 0 THEN concat('Tool xd_', k % 3, ' not found') ELSE concat('failed with code ', k) END "
        "ELSE CASE WHEN k % 10 = 1 THEN concat('Backgrounded as job bg_', k % 7) ELSE concat('done ', k) END END"
    ),
    "is_human": "event_type = 'signup'",
    "steering": "event_type = 'signup' AND k % 10 = 0",
    "stop_reason": "CASE WHEN event_type <> 'view' THEN '' WHEN k % 10 = 3 THEN 'aborted' WHEN k % 10 = 4 THEN 'error' ELSE 'stop' END",
    "error_message": (
        "CASE WHEN event_type = 'view' AND k % 10 = 4 THEN CASE k % 40 WHEN 4 THEN 'HTTP 429' "
        "WHEN 14 THEN 'quota exceeded' WHEN 24 THEN '401 unauthorized' ELSE 'boom' END END"
    ),
    "model": pick("k % 6", MODELS),
    "provider": pick("k % 4", PROVIDERS),
    "ttft_ms": "CASE WHEN event_type = 'view' THEN CAST(k * 10 AS DOUBLE) END",
    "duration_ms": "CASE WHEN event_type = 'view' THEN CAST(floor(value * 1000) AS DOUBLE) END",
    "completed_ms": "CASE WHEN event_type = 'view' AND k % 5 <> 0 THEN ts_ms + 500 END",
    "input": "CASE WHEN event_type = 'view' THEN CAST(k * 10 AS DOUBLE) ELSE 0.0 END",
    "output": "CASE WHEN event_type = 'view' THEN CAST(k * 3 AS DOUBLE) ELSE 0.0 END",
    "cache_read": "CASE WHEN event_type = 'view' THEN CAST(k * (k % 7) AS DOUBLE) ELSE 0.0 END",
    "cache_write": "CASE WHEN event_type = 'view' THEN CAST(k % 5 AS DOUBLE) ELSE 0.0 END",
    "cost": "CASE WHEN event_type = 'view' THEN value / 100 ELSE 0.0 END",
    "cost_input": "CASE WHEN event_type = 'view' AND k % 6 <> 5 THEN value / 200 ELSE 0.0 END",
    "cost_output": "CASE WHEN event_type = 'view' AND k % 6 <> 5 THEN value / 400 ELSE 0.0 END",
    "tool": (
        f"CASE event_type WHEN 'click' THEN {pick('k % 5', ['read', 'grep', 'glob', 'eval', 'task'])} "
        f"WHEN 'purchase' THEN {pick('k % 2', ['edit', 'write'])} "
        f"WHEN 'error' THEN {pick('k % 5', ['bash', 'read', 'eval', 'mcp__srv_x', 'wait'])} ELSE '' END"
    ),
    "call_id": "CASE WHEN event_type IN ('signup', 'view') OR k % 11 = 0 THEN '' ELSE concat('c', k % 7) END",
    "is_error": "event_type = 'error'",
}
CALL_COLUMNS = {
    "user_id": "user_id", "session_id": "session_id", "seq": "event_id", "ts_ms": "ts_ms", "idx": "0",
    "call_id": "concat('c', k % 7)", "tool": TOOL,
    "path": (
        "CASE WHEN k % 8 = 1 AND k % 9 = 0 THEN concat('xd://mcp__dev', k % 3, '/x') "
        f"ELSE concat('/src/m', k % 5, '/f', k % 13, {pick('k % 4', ['.py', '.ts', '.md', '.zz'])}) END"
    ),
    "content": "concat('l1', chr(10), 'l2', chr(10), k)",
    "input": (
        "concat('[/src/m', k % 5, '/p', k % 4, '.py#0A1b]', chr(10), 'PUT 3.=9', chr(10), '+new', chr(10), "
        "'-old', chr(10), '---', chr(10), '+x')"
    ),
    "command": pick("k % 10", COMMANDS),
    "code": pick("k % 5", CODE),
    "language": "CASE k % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'js' END",
    "agent": "CASE k % 4 WHEN 0 THEN 'reviewer' WHEN 1 THEN 'scout' END",
    "task_name": "concat('t', k % 5)",
    "task_agent": "CASE k % 3 WHEN 0 THEN 'CodeReviewer' WHEN 1 THEN 'task' END",
}
START_COLUMNS = {
    "user_id": "user_id", "session_id": "session_id", "seq": "event_id", "call_id": "concat('c', k % 7)", "tool": TOOL,
    "started_ms": "ts_ms + 100", "has_intent": "k % 2 = 0",
}
MARKER_COLUMNS = {
    "user_id": "user_id", "session_id": "session_id", "seq": "event_id",
    "marker": pick("k % 5", ["thinking_level_change", "model_change", "compaction", "ttsr_injection", "reset_boundary"]),
    "rule_a": "concat('r', k % 3)", "rule_b": "concat('r', k % 2)",
}
JOB_COLUMNS = {
    "user_id": "user_id", "session_id": "session_id", "seq": "event_id", "job_no": "0", "delivery_ms": "ts_ms",
    "job_id": "CASE WHEN k % 6 = 0 THEN concat('bg_', k % 7) ELSE concat('t', k % 5) END",
    "job_type": "CASE WHEN k % 6 = 0 THEN 'bash' ELSE 'task' END",
    "duration_ms": "CAST(floor(value) * 1000 AS BIGINT)",
    "label": "CASE WHEN k % 4 = 0 THEN 'npm test' ELSE 'approve release' END",
}
JOB_FILTER = "event_type = 'purchase' AND k % 6 <= 1 AND value >= 1"


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


# --- Spark side --------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts_ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        "event_id", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"), ts_ms.alias("ts_ms"),
        F.concat(F.lit("u"), F.col("user_id"), F.lit("-w"), F.floor(ts_ms / WEEK_MS)).alias("session_id"),
    )


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def messages(spark, sf_dir):
    return _project(events(spark, sf_dir), MESSAGE_COLUMNS)


def tool_calls(spark, sf_dir):
    calls = _project(events(spark, sf_dir).where("event_type = 'view'"), CALL_COLUMNS)
    task = F.array(F.struct(F.col("task_name").alias("name"), F.col("task_agent").alias("agent")))
    return calls.withColumn("tasks", task)


def tool_starts(spark, sf_dir):
    return _project(events(spark, sf_dir).where("event_type = 'view'"), START_COLUMNS)


def results(spark, sf_dir):
    return messages(spark, sf_dir).where("role = 'toolResult'")


def markers(spark, sf_dir):
    rows = _project(events(spark, sf_dir).where("event_type = 'click'"), MARKER_COLUMNS)
    return rows.withColumn("rules", F.array("rule_a", "rule_b"))


def async_jobs(spark, sf_dir):
    return _project(events(spark, sf_dir).where(JOB_FILTER), JOB_COLUMNS)


def usage_events(spark, sf_dir):
    """Usage of answers, plus clicks as out-of-band calls; the user id gives the class."""
    kind = "CASE user_id % 5 WHEN 0 THEN 'advisor' WHEN 1 THEN 'subagent' ELSE 'primary' END"
    e = events(spark, sf_dir).where("event_type IN ('view', 'click')")
    return e.select(*[F.expr(x).alias(n) for n, x in usage_columns(kind).items()])


def usage_columns(kind: str) -> dict[str, str]:
    return {
        "user_id": "user_id", "session_id": "session_id", "seq": "event_id", "kind": kind,
        "model": MESSAGE_COLUMNS["model"], "provider": MESSAGE_COLUMNS["provider"],
        "utility": "event_type = 'click'",
        "input": "CAST(k * 10 AS DOUBLE)", "output": "CAST(k * 3 AS DOUBLE)",
        "cache_read": "CAST(k * (k % 7) AS DOUBLE)", "cache_write": "CAST(k % 5 AS DOUBLE)",
        "cost": "CASE WHEN k % 6 = 4 THEN 0.0 ELSE value / 100 END",
        "cost_input": "CASE WHEN k % 6 IN (4, 5) THEN 0.0 ELSE value * (k % 6 + 1) / 200 END",
        "cost_output": "CASE WHEN k % 6 IN (4, 5) THEN 0.0 ELSE value / 400 END",
    }


FACET_COLUMNS = {
    "session_id": "session_id", "user_id": "user_id", "start_ms": "start_ms",
    "outcome": pick("h % 5", ["fully_achieved", "mostly_achieved", "partially_achieved", "not_achieved", "unclear_from_transcript"]),
    "session_type": pick("h % 4", ["single_task", "multi_task", "quick_question", "exploration"]),
    "helpfulness": pick("h % 3", ["very_helpful", "unhelpful", "essential"]),
    "primary_success": pick("h % 3", ["none", "good_debugging", "fast_accurate_search"]),
    "brief_summary": "CASE WHEN h % 9 = 0 THEN '' ELSE concat('did ', h) END",
    "friction_detail": "CASE WHEN h % 4 = 0 THEN ' ' ELSE concat('slow part ', h) END",
}
FRICTION_KEYS = [
    "tool_failures", "Tool Failure", "wrong approach", "approach_wrong", "issue_resolved", "slow_or_verbose",
    "communication unclear", "unclear-communication", "Direction agent wrong",
]
GOAL_KEYS = ["fix_bug", "write_tests", "warmup_minimal"]


def facet_base(spark, sf_dir) -> DataFrame:
    """One facet row per session: h is a number derived from user and week."""
    e = events(spark, sf_dir)
    return e.groupBy("session_id", "user_id").agg(F.min("ts_ms").alias("start_ms")).withColumn(
        "h", ((F.col("user_id") * 31 + F.floor(F.col("start_ms") / WEEK_MS) * 7) % 90).cast("int")
    )


def facets(spark, sf_dir) -> DataFrame:
    return _project(facet_base(spark, sf_dir), FACET_COLUMNS)


def facet_counts(spark, sf_dir) -> DataFrame:
    """(session_id, user_id, start_ms, dim, key, n): friction and goal counts."""
    base = facet_base(spark, sf_dir)
    parts = [
        base.select("session_id", "user_id", "start_ms", F.lit(d).alias("dim"), F.expr(k).alias("key"), F.expr(n).cast("double").alias("n"))
        for d, k, n in facet_count_parts()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def facet_count_parts() -> list[tuple[str, str, str]]:
    return [
        ("friction", pick("h % 9", FRICTION_KEYS), "h % 3"),
        ("friction", pick("(h + 4) % 9", FRICTION_KEYS), "1"),
        ("goal", pick("h % 3", GOAL_KEYS), "1"),
        ("goal", pick("(h + 1) % 3", GOAL_KEYS), "h % 2"),
        ("satisfaction", pick("h % 2", ["satisfied", "frustrated"]), "2"),
    ]


def order_sessions(spark, sf_dir) -> DataFrame:
    """Orders as a long series of sessions: owner, start, cost, errors, model."""
    o = table(spark, sf_dir, "orders")
    cols = {
        "owner": "o_custkey % 50", "session_id": "o_orderkey", "start_ms": "",
        "cost": "o_totalprice / 1000", "errors": "o_orderkey % 37", "model": "o_orderpriority",
    }
    cols["start_ms"] = "unix_millis(CAST(o_orderdate AS timestamp))"
    return o.select(*[F.expr(e).alias(n) for n, e in cols.items()])


# --- SQL side ----------------------------------------------------------------

def _cte(name: str, body: str) -> str:
    return f"{name} AS ({body})"


SQL = {
    "ev": _cte("ev", (
        "SELECT *, concat('u', user_id, '-w', CAST(floor(ts_ms / 604800000) AS BIGINT)) AS session_id FROM ("
        "SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k, "
        "epoch_us(ts) // 1000 AS ts_ms FROM events)"
    )),
    "messages": _cte("messages", f"SELECT {_select(MESSAGE_COLUMNS)} FROM ev"),
    "tool_calls": _cte("tool_calls", f"SELECT {_select(CALL_COLUMNS)} FROM ev WHERE event_type = 'view'"),
    "tool_starts": _cte("tool_starts", f"SELECT {_select(START_COLUMNS)} FROM ev WHERE event_type = 'view'"),
    "results": _cte("results", "SELECT * FROM messages WHERE role = 'toolResult'"),
    "markers": _cte("markers", f"SELECT {_select(MARKER_COLUMNS)} FROM ev WHERE event_type = 'click'"),
    "async_jobs": _cte("async_jobs", f"SELECT {_select(JOB_COLUMNS)} FROM ev WHERE {JOB_FILTER}"),
    "usage_events": _cte("usage_events", (
        "SELECT " + _select(usage_columns("CASE user_id % 5 WHEN 0 THEN 'advisor' WHEN 1 THEN 'subagent' ELSE 'primary' END"))
        + " FROM ev WHERE event_type IN ('view', 'click')"
    )),
    "facet_base": _cte("facet_base", (
        "SELECT session_id, user_id, start_ms, CAST((user_id * 31 + CAST(floor(start_ms / 604800000) AS BIGINT) * 7) % 90 AS INTEGER) AS h "
        "FROM (SELECT session_id, user_id, min(ts_ms) AS start_ms FROM ev GROUP BY 1, 2)"
    )),
    "facets": _cte("facets", f"SELECT {_select(FACET_COLUMNS)} FROM facet_base"),
    "facet_counts": _cte("facet_counts", " UNION ALL ".join(
        f"SELECT session_id, user_id, start_ms, '{d}' AS dim, {k} AS key, CAST({n} AS DOUBLE) AS n FROM facet_base"
        for d, k, n in facet_count_parts()
    )),
    "order_sessions": _cte("order_sessions", (
        "SELECT o_custkey % 50 AS owner, o_orderkey AS session_id, epoch_us(o_orderdate) // 1000 AS start_ms, "
        "o_totalprice / 1000 AS cost, o_orderkey % 37 AS errors, o_orderpriority AS model FROM orders"
    )),
}
NEEDS = {
    "messages": ["ev"], "tool_calls": ["ev"], "tool_starts": ["ev"], "results": ["messages"], "markers": ["ev"],
    "async_jobs": ["ev"], "usage_events": ["ev"], "facet_base": ["ev"], "facets": ["facet_base"],
    "facet_counts": ["facet_base"],
}


def with_tables(names: list[str], *ctes: str) -> str:
    """WITH clause holding the named tables and further CTEs."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    recursive = any(c.startswith("walk") for c in ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*(SQL[n] for n in wanted), *ctes]) + "\n"


def r4(x: str) -> str:
    """Half-up rounding at 4 decimals, the same in both engines."""
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def dec(x: str) -> str:
    """Exact sum as double."""
    return f"CAST(coalesce(sum(CAST({x} AS DECIMAL(18,6))), 0) AS DOUBLE)"
