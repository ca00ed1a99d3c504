"""Where the wall-clock time of a session went.

Intervals of model, tool, agent, review and build time overlap. A sweep over
their end points keeps one running counter per bucket; the highest bucket
with a positive counter owns the stretch to the next point. The range of the
session and the starts of its requests are points of the same sweep, so
neither clipping nor splitting needs a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.functions.numeric import exact_sum, round_half_up
from worktrail.functions.text import names_review, trimmed
from worktrail.functions.waits import bucket_of_wait, command_family, wait_kind
from worktrail.operators.pairing import CALL, delivered_calls
from worktrail.operators.scan import DAY_MS, by_width, merged_intervals, ordered_scan
from worktrail.operators.usage import top_rows
from worktrail.session import materialise

IDLE_CAP_MS = 900_000  # fixed value: more than this without a sign of work is idle
BUCKETS = ["model", "tools", "agents", "review", "ci", "you", "elsewhere", "idle"]
ACTIVE = BUCKETS[:-1]

# Who owns a covered stretch, highest first (bucket, background).
PRIORITY = [
    ("ci", False), ("review", False), ("agents", False), ("tools", False), ("model", False),
    ("ci", True), ("review", True), ("agents", True), ("tools", True), ("you", False),
]


def model_intervals(messages: DataFrame) -> DataFrame:
    """[end - (time to first token + duration), end] of each answer."""
    took = F.coalesce("ttft_ms", F.lit(0.0)) + F.coalesce("duration_ms", F.lit(0.0))
    end = F.coalesce("completed_ms", "ts_ms")
    return messages.where("role = 'assistant'").where((took > 0) & end.isNotNull()).select(
        "session_id", (end - took).cast("bigint").alias("start_ms"), end.alias("end_ms"),
        F.lit("model").alias("bucket"), F.lit(False).alias("background"),
    )


def wait_returned_review(text: Column) -> Column:
    """A wait result names a review job: by agent type, else by tag or label line."""
    tags = F.regexp_extract_all(text, F.lit(r"(?i)(<task-result\b[^>]*>)"), 1)
    agent = lambda tag: F.regexp_extract(tag, r"(?i)\bagent\s*=\s*[\"']([^\"']*)[\"']", 1)
    has_agent = lambda tag: tag.rlike(r"(?i)\bagent\s*=\s*[\"']")
    lines = F.regexp_extract_all(text, F.lit(r"(?im)^(.*\blabel\s*:.*)$"), 1)
    by_tag = F.exists(tags, lambda t: names_review(F.when(has_agent(t), agent(t)).otherwise(t)))
    return by_tag | F.exists(lines, names_review)


def call_bucket(tool: Column, text: Column, agents: Column, result: Column) -> Column:
    """Bucket of a call; `agents` are the agent types a task call names."""
    reviewing = F.exists(F.coalesce(agents, F.array().cast("array<string>")), names_review)
    return (
        F.when(tool == "ask", "you")
        .when(tool == "wait", F.when(wait_returned_review(result), "review").otherwise("agents"))
        .when(tool == "task", F.when(reviewing, "review").otherwise("agents"))
        .otherwise(bucket_of_wait(wait_kind(tool, text)))
    )


def call_details(calls: DataFrame) -> DataFrame:
    """Text, language and agent types of the latest call per id."""
    text = F.when(F.col("tool") == "bash", F.coalesce("command", F.lit(""))).when(
        F.col("tool") == "eval", F.coalesce("code", F.lit(""))
    ).otherwise("")
    agents = F.array_compact(F.array_append(
        F.transform(F.coalesce("tasks", F.array().cast("array<struct<name:string,agent:string>>")), lambda t: t["agent"]),
        F.col("agent"),
    ))
    body = F.struct(text.alias("command_text"), F.col("language"), agents.alias("agents"))
    return calls.groupBy(*CALL).agg(F.max_by(body, F.struct("seq", "idx")).alias("d")).select(*CALL, "d.*")


def tool_intervals(starts: DataFrame, results: DataFrame, calls: DataFrame) -> DataFrame:
    """Final interval of each call with its bucket, busy seconds and family."""
    rows = delivered_calls(starts, results).join(call_details(calls), CALL, "left")
    text = F.coalesce("command_text", F.lit(""))
    bucket = call_bucket(F.col("tool"), text, F.col("agents"), trimmed(F.col("text")))
    return materialise(rows.withColumn("bucket", bucket)).select(
        *CALL, "tool", "seq", "started_ms", "ts_ms", "bucket", "job_id", "moved_to",
        text.alias("command_text"), "language",
        (F.greatest(F.lit(0), F.col("ts_ms") - F.col("started_ms")) / 1000.0).alias("busy_sec"),
        F.when(F.col("bucket") == "tools", command_family(F.col("tool"), text, F.col("language"))).alias("family"),
    )


def job_intervals(jobs: DataFrame, timed: DataFrame, calls: DataFrame) -> DataFrame:
    """Background spans [delivery - duration, delivery] of finished jobs.

    A shell job belongs to the call whose notice named it; the first such job
    before the call closed replaces the call's interval (`replaces`).
    """
    agents = (
        calls.where("tool = 'task'").select("session_id", "seq", F.explode("tasks").alias("t"))
        .where("t.name <> ''").groupBy("session_id", F.col("t.name").alias("job_id"))
        .agg(F.max_by(F.coalesce("t.agent", F.lit("task")), "seq").alias("agent"))
    )
    owners = timed.where("moved_to is not null").groupBy("session_id", F.col("moved_to").alias("job_id")).agg(
        F.max_by(F.struct("call_id", "command_text", "language",
                          F.when(F.col("job_id") == "", F.col("seq")).alias("closed_seq")), "seq").alias("o")
    )
    joined = jobs.where("job_type in ('task', 'bash')").join(agents, ["session_id", "job_id"], "left").join(
        owners, ["session_id", "job_id"], "left"
    )
    command = F.when(F.coalesce("o.command_text", F.lit("")) != "", F.col("o.command_text")).otherwise(F.col("label"))
    named = F.coalesce("agent", F.concat_ws(" ", "job_id", "label"))
    bucket = F.when(
        F.col("job_type") == "task", F.when(names_review(named), "review").otherwise("agents")
    ).otherwise(bucket_of_wait(wait_kind(F.lit("bash"), command)))
    in_time = F.col("o.closed_seq").isNull() | (F.col("seq") < F.col("o.closed_seq"))
    eligible = (F.col("job_type") == "bash") & F.col("o.call_id").isNotNull() & in_time
    rows = materialise(joined.withColumn("bucket", bucket).withColumn("eligible", eligible))
    first = rows.where("eligible").groupBy("session_id", F.col("o.call_id").alias("call_id")).agg(
        F.min(F.struct("seq", "job_no")).alias("first")
    )
    call = F.when(F.col("eligible"), F.col("o.call_id"))
    return rows.withColumn("call_id", call).join(first, CALL, "left").select(
        "session_id", F.when(F.struct("seq", "job_no") == F.col("first"), F.col("call_id")).alias("replaces"),
        (F.col("delivery_ms") - F.col("duration_ms")).alias("start_ms"), F.col("delivery_ms").alias("end_ms"),
        "bucket", F.lit(True).alias("background"), "job_type",
        (F.col("duration_ms") / 1000.0).alias("busy_sec"),
        F.when((F.col("job_type") == "bash") & (F.col("bucket") == "tools"),
               command_family(F.lit("bash"), command, F.col("o.language"))).alias("family"),
    )


def effective_calls(timed: DataFrame, jobs: DataFrame) -> DataFrame:
    """Calls and jobs after replacement: the rows busy time and buckets count."""
    replaced = jobs.where("replaces is not null").select("session_id", F.col("replaces").alias("call_id"))
    own = timed.join(replaced, CALL, "left_anti").select(
        "session_id", "tool", F.col("started_ms").alias("start_ms"), F.col("ts_ms").alias("end_ms"),
        "bucket", F.lit(False).alias("background"), "busy_sec", "family",
    )
    other = jobs.select(
        "session_id", F.when(F.col("job_type") == "bash", F.lit("bash")).alias("tool"),
        "start_ms", "end_ms", "bucket", "background", "busy_sec", "family",
    )
    return own.unionByName(other)


def session_ranges(times: DataFrame, humans: DataFrame) -> DataFrame:
    """[first human message, else first time; last time] per session."""
    ends = times.groupBy("session_id").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("stop_ms"))
    first = humans.groupBy("session_id").agg(F.min("ts_ms").alias("human_ms"))
    return ends.join(first, "session_id", "left").select(
        "session_id", F.coalesce("human_ms", "first_ms").alias("lo_ms"),
        F.greatest("stop_ms", F.coalesce("human_ms", "first_ms")).alias("hi_ms"),
    )


def _counter(bucket: str, background: bool) -> str:
    return f"c_{bucket}{'_bg' if background else ''}"


COUNTERS = [_counter(b, g) for b, g in PRIORITY]


def _points(intervals: DataFrame, ranges: DataFrame, humans: DataFrame) -> DataFrame:
    """One row per (session, time) with the change of every counter."""
    none = [F.lit(0).alias(c) for c in COUNTERS]
    no_mark = F.lit(None).cast("bigint").alias("mark")
    live = intervals.where("end_ms > start_ms").select(
        "session_id", "bucket", "background",
        F.explode(F.array(
            F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")),
            F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d")),
        )).alias("p"),
    )
    work = live.select(
        "session_id", F.col("p.t").alias("t"), F.lit(0).alias("open"), no_mark,
        *[
            F.expr(f"CASE WHEN bucket = '{b}' AND background = {str(g).lower()} THEN p.d ELSE 0 END").alias(_counter(b, g))
            for b, g in PRIORITY
        ],
    )
    edges = ranges.where("hi_ms > lo_ms").select(
        "session_id", F.explode(F.array(
            F.struct(F.col("lo_ms").alias("t"), F.lit(1).alias("d")),
            F.struct(F.col("hi_ms").alias("t"), F.lit(-1).alias("d")),
        )).alias("p"),
    ).select("session_id", "p.t", F.col("p.d").alias("open"), no_mark, *none)
    marks = humans.select(
        "session_id", F.col("ts_ms").alias("t"), F.lit(0).alias("open"),
        F.col("seq").alias("mark"), *none,
    )
    return work.unionByName(edges).unionByName(marks).groupBy("session_id", "t").agg(
        F.sum("open").alias("d_open"), F.max("mark").alias("mark"), *[F.sum(c).alias(f"d_{c}") for c in COUNTERS]
    )


def _owner(counter: str) -> Column:
    """First bucket by priority whose counter is positive; `{c}` stands for its column."""
    arms = " ".join(f"WHEN {counter.format(c=_counter(b, g))} > 0 THEN '{b}'" for b, g in PRIORITY)
    return F.expr(f"CASE {arms} END")


def time_segments(intervals: DataFrame, ranges: DataFrame, humans: DataFrame) -> DataFrame:
    """Stretches [t, t2) with their owner (NULL: nobody), state before, request number.

    `mark` is the seq of the human message that opens a request at t. Points
    hold numbers alone, so they combine in hash aggregates.
    """
    points = materialise(_points(intervals, ranges, humans))
    rows = ordered_scan(
        points, ["session_id"], ["t"], by_width("t", DAY_MS),
        sums={
            "inside": F.col("d_open"), "request_no": F.col("mark").isNotNull().cast("int"),
            **{c: F.col(f"d_{c}") for c in COUNTERS},
        },
        next_={"t2": F.col("t")},
    )
    owner, before = _owner("{c}"), _owner("({c} - d_{c})")
    was_inside = F.col("inside") - F.col("d_open") > 0
    return materialise(rows.select(
        "session_id", "t", "t2", "request_no", "mark", (F.col("inside") > 0).alias("inside"),
        owner.alias("owner"), was_inside.alias("was_inside"), before.alias("owner_before"),
    ))


def gap_pieces(segments: DataFrame) -> DataFrame:
    """Stretches nobody owns, whole and cut at request starts.

    Rows: session_id, request_no, start_ms, stop_ms (NULL unless the gap
    starts here), cut_ms.
    """
    gap = F.col("inside") & F.col("owner").isNull()
    was_gap = F.col("was_inside") & F.col("owner_before").isNull()
    rows = segments.withColumn("gap", gap).withColumn("opens", gap & ~was_gap).withColumn(
        "closes", ~gap & was_gap
    ).withColumn("cuts", gap & F.col("mark").isNotNull())
    turns = rows.where("opens or closes or cuts")
    found = ordered_scan(
        turns, ["session_id"], ["t"], by_width("t", DAY_MS),
        next_={
            "stop": F.when(F.col("closes"), F.col("t")),
            "cut": F.when(F.col("closes") | F.col("cuts"), F.col("t")),
        },
    )
    return found.where("gap").select(
        "session_id", "request_no", F.col("t").alias("start_ms"),
        F.when(F.col("opens"), F.col("stop")).alias("stop_ms"), F.col("cut").alias("cut_ms"),
    )


def _shares(segments: DataFrame, gaps: DataFrame, keys: Sequence[str], end: str, cap_ms: int) -> DataFrame:
    """Milliseconds per bucket: owned stretches, gap heads to you, tails to idle."""
    owned = segments.where("inside and owner is not null").select(
        *keys, F.col("owner").alias("bucket"), (F.col("t2") - F.col("t")).alias("ms")
    )
    length = F.col(end) - F.col("start_ms")
    open_ = gaps.where(F.col(end).isNotNull()).select(
        *keys, F.explode(F.array(
            F.struct(F.lit("you").alias("bucket"), F.least(length, F.lit(cap_ms)).alias("ms")),
            F.struct(F.lit("idle").alias("bucket"), F.greatest(length - cap_ms, F.lit(0)).alias("ms")),
        )).alias("x"),
    ).select(*keys, "x.bucket", "x.ms")
    parts = owned.unionByName(open_)
    sec = lambda b: (F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("ms"))), F.lit(0)) / 1000.0).alias(b)
    return parts.groupBy(*keys).agg(*[sec(b) for b in BUCKETS if b != "elsewhere"])


def session_time(segments: DataFrame, gaps: DataFrame, cap_ms: int = IDLE_CAP_MS) -> DataFrame:
    """Seconds per bucket and active seconds (all but idle) per session."""
    wide = _shares(segments, gaps, ["session_id"], "stop_ms", cap_ms)
    active = sum((F.col(b) for b in ACTIVE if b != "elsewhere"), F.lit(0.0))
    return wide.withColumn("active_sec", round_half_up(active, 3))


def you_gaps(segments: DataFrame, gaps: DataFrame, cap_ms: int = IDLE_CAP_MS) -> DataFrame:
    """Stretches that wait for the user: asked time and gap heads, merged."""
    asked = segments.where("inside and owner = 'you'").select(
        "session_id", F.col("t").alias("start_ms"), F.col("t2").alias("end_ms")
    )
    heads = gaps.where("stop_ms is not null").select(
        "session_id", "start_ms", F.least("stop_ms", F.col("start_ms") + cap_ms).alias("end_ms")
    )
    return merged_intervals(asked.unionByName(heads), ["session_id"])


def request_times(
    segments: DataFrame, gaps: DataFrame, cap_ms: int = IDLE_CAP_MS, *, idle_may_dominate: bool = False
) -> DataFrame:
    """Wall time, active time and dominant bucket of every request."""
    wide = _shares(segments.where("request_no > 0"), gaps.where("request_no > 0"), ["session_id", "request_no"], "cut_ms", cap_ms)
    starts = segments.where("mark is not null").select(
        "session_id", "request_no", F.col("t").alias("start_ms"), F.col("mark").alias("seq")
    )
    names = [b for b in BUCKETS if b != "elsewhere" and (idle_may_dominate or b != "idle")]
    ranked = F.array_sort(F.array(*[F.struct((-F.col(b)).alias("v"), F.lit(i).alias("i"), F.lit(b).alias("b")) for i, b in enumerate(names)]))
    total = sum((F.col(b) for b in BUCKETS if b != "elsewhere"), F.lit(0.0))
    return (
        wide.withColumn("wall_sec", round_half_up(total, 3))
        .withColumn("active_sec", round_half_up(F.col("wall_sec") - F.col("idle"), 3))
        .withColumn("dominant", F.element_at(ranked, 1)["b"])
        .join(starts, ["session_id", "request_no"])
    )


def with_prompts(requests: DataFrame, humans: DataFrame) -> DataFrame:
    """Add the opening words of each request's message."""
    said = humans.select("session_id", "seq", F.substring(trimmed(F.col("text")), 1, 120).alias("prompt"))
    return requests.join(said, ["session_id", "seq"])


def active_sum() -> Column:
    """Active seconds as the plain sum of the buckets, before rounding."""
    return sum((F.col(b) for b in ACTIVE if b != "elsewhere"), F.lit(0.0))


def slowest_requests(requests: DataFrame, k: int = 5, by: str | Column = "active_sec") -> DataFrame:
    return top_rows(requests, ["session_id"], [F.desc(by), F.asc("request_no")], k)


def busy_by(calls: DataFrame, column: str, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Busy seconds per tool or command family; may exceed the wall clock."""
    return calls.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(
        exact_sum(F.col("busy_sec")).alias("busy_sec")
    )


def flat_call_intervals(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Dialect B: call to its first result; every bucket has a command family."""
    a = calls.where("ts_ms is not null").select(
        *CALL, "seq", F.struct("tool", "ts_ms", "input").alias("s"), F.lit(None).cast("bigint").alias("done_ms")
    )
    b = results.where("ts_ms is not null").select(
        *CALL, "seq", F.lit(None).cast(a.schema["s"].dataType).alias("s"), F.col("ts_ms").alias("done_ms")
    )
    rows = ordered_scan(
        a.unionByName(b), CALL, ["seq"], by_width("seq", 65_536), last={"p": F.struct(F.col("s").alias("s"))}
    ).where("s is null and p.s is not null")
    tool, i = F.col("p.s.tool"), F.col("p.s.input")
    text = F.when(tool == "Bash", F.coalesce(i["command"], F.lit(""))).otherwise("")
    reviewing = names_review(F.coalesce(i["subagent_type"], F.lit(""))) | names_review(F.coalesce(i["description"], F.lit("")))
    named = F.when(tool == "Bash", "bash").otherwise(tool)
    bucket = (
        F.when(tool == "AskUserQuestion", "you")
        .when(tool == "Task", F.when(reviewing, "review").otherwise("agents"))
        .otherwise(bucket_of_wait(wait_kind(named, text)))
    )
    return rows.select(
        *CALL, tool.alias("tool"), F.col("p.s.ts_ms").alias("start_ms"), F.col("done_ms").alias("end_ms"),
        bucket.alias("bucket"), F.lit(False).alias("background"),
        (F.greatest(F.lit(0), F.col("done_ms") - F.col("p.s.ts_ms")) / 1000.0).alias("busy_sec"),
        command_family(named, text, F.lit(None).cast("string")).alias("family"),
    )
