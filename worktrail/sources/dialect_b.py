"""Record normalisation, dialect B: flat logs with inline side chains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.operators.scan import SEQ_CHUNK, by_width, ordered_scan
from worktrail.operators.tools import language_of
from worktrail.session import materialise
from worktrail.sources.dialect_a import OWNER, LogTables, content_is_list, millis

RECORD = (
    "type string, sessionId string, cwd string, timestamp string, requestId string, uuid string, "
    "isSidechain boolean, isMeta boolean, totalCostUSD double, totalLinesAdded double, "
    "totalLinesRemoved double, modelUsage map<string,struct<inputTokens:double,outputTokens:double,"
    "cacheReadInputTokens:double,cacheCreationInputTokens:double,costUSD:double>>, "
    "message struct<role:string,model:string,content:string,usage:struct<input_tokens:double,"
    "output_tokens:double,cache_read_input_tokens:double,cache_creation_input_tokens:double>>"
)
BLOCKS = (
    "array<struct<type:string,text:string,id:string,name:string,tool_use_id:string,is_error:boolean,"
    "input:struct<file_path:string,path:string,command:string,content:string,old_string:string,"
    "new_string:string,subagent_type:string,description:string>>>"
)


@dataclass(frozen=True)
class FlatTables:
    records: DataFrame
    messages: DataFrame
    tool_calls: DataFrame
    tool_results: DataFrame
    cost_states: DataFrame


def parse_records(lines: DataFrame) -> DataFrame:
    """Typed record `r`, entry time, blocks and text; input session_id, seq, line."""
    parsed = lines.withColumn("r", F.from_json("line", RECORD)).withColumn(
        "ts_ms", millis(F.col("r.timestamp"))
    )
    content = F.col("r.message.content")
    is_list = content_is_list(content)
    typed = parsed.withColumn("blocks", F.when(is_list, F.from_json(content, BLOCKS)))
    texts = F.filter("blocks", lambda b: (b["type"] == "text") & b["text"].isNotNull())
    joined = F.array_join(F.transform(texts, lambda b: b["text"]), " ")
    results = F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_result"), F.lit(False))
    return typed.withColumn(
        "text", F.when(F.col("blocks").isNotNull(), joined).otherwise(F.coalesce(content, F.lit("")))
    ).withColumn("has_results", results)


def normalise(lines: DataFrame) -> FlatTables:
    # Some ten selects read the records: parse each line once.
    return flat_tables(materialise(parse_records(lines).drop("line"), wide=True))


def flat_tables(records: DataFrame) -> FlatTables:
    kind = F.col("r.type")
    is_user = (kind == "user") & F.col("r.message").isNotNull()
    side = F.coalesce(F.col("r.isSidechain"), F.lit(False))
    meta = F.coalesce(F.col("r.isMeta"), F.lit(False))
    u = F.col("r.message.usage")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    messages = records.where(kind.isin("user", "assistant") & F.col("r.message").isNotNull()).select(
        "session_id", "seq", "ts_ms", kind.alias("role"), "text", "has_results",
        side.alias("is_sidechain"),
        human_turn(is_user, F.col("has_results"), side, meta, F.col("text")).alias("is_human"),
        F.coalesce(F.col("r.requestId"), F.lit("")).alias("request_id"),
        F.coalesce(F.col("r.message.model"), F.lit("unknown")).alias("model"),
        zero(u["input_tokens"]).alias("input"), zero(u["output_tokens"]).alias("output"),
        zero(u["cache_read_input_tokens"]).alias("cache_read"),
        zero(u["cache_creation_input_tokens"]).alias("cache_write"),
    )
    blocks = records.select("session_id", "seq", "ts_ms", kind.alias("role"), F.posexplode("blocks").alias("idx", "b"))
    tool_calls = blocks.where("role = 'assistant' and b.type = 'tool_use'").select(
        "session_id", "seq", "ts_ms", "idx",
        F.coalesce("b.id", F.concat(F.lit("@"), F.col("seq"), F.lit("."), F.col("idx"))).alias("call_id"),
        F.coalesce("b.name", F.lit("")).alias("tool"), F.col("b.input").alias("input"),
    )
    tool_results = blocks.where("role = 'user' and b.type = 'tool_result'").select(
        "session_id", "seq", "ts_ms", "idx", F.coalesce("b.tool_use_id", F.lit("")).alias("call_id"),
        F.coalesce("b.is_error", F.lit(False)).alias("is_error"),
    )
    cost_states = records.where(kind == "cost-state").select(
        "session_id", "seq", F.col("r.totalCostUSD").alias("total_cost"),
        F.col("r.totalLinesAdded").alias("lines_added"), F.col("r.totalLinesRemoved").alias("lines_removed"),
        F.col("r.modelUsage").alias("model_usage"),
    )
    return FlatTables(records, messages, tool_calls, tool_results, cost_states)


def human_turn(is_user, has_results, sidechain, meta, text):
    """Typed by the person: no tool result, no side chain, no notice, not blank."""
    return is_user & ~has_results & ~sidechain & ~meta & text.rlike(r"\S")


def session_identity(records: DataFrame) -> DataFrame:
    """First session id and working folder written in each log, first and last time."""
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("seq")))
    return records.groupBy("session_id").agg(
        first(F.col("r.sessionId")).alias("record_session_id"),
        first(F.col("r.cwd")).alias("cwd"),
        first(F.col("ts_ms")).alias("start_ms"),
        F.max("ts_ms").alias("stop_ms"),
        F.max(F.coalesce(F.col("r.isSidechain"), F.lit(False))).alias("uses_subagent"),
    )


def counted_responses(messages: DataFrame) -> DataFrame:
    """One row per response: the first of each request id; blank ids all count.

    The first row is an aggregate, so many copies of one response combine
    before the shuffle.
    """
    answers = messages.where("role = 'assistant'")
    blank = answers.where("request_id = ''")
    names = [c for c in answers.columns if c not in ("session_id", "request_id")]
    first = (
        answers.where("request_id <> ''")
        .groupBy("session_id", "request_id")
        .agg(F.min_by(F.struct(*names), F.col("seq")).alias("b"))
        .select("session_id", "request_id", "b.*")
    )
    return blank.unionByName(first)


def session_usage(messages: DataFrame, cost_states: DataFrame) -> DataFrame:
    """Tokens and cost per session; the last cost record supersedes the sums.

    Tokens come from it only if it lists models; without it the cost is 0 and
    `cost_recorded` is false.
    """
    summed = counted_responses(messages).groupBy("session_id").agg(
        *[F.sum(c).alias(f"m_{c}") for c in ("input", "output", "cache_read", "cache_write")]
    )
    state = F.max_by(F.struct("total_cost", "lines_added", "lines_removed", "model_usage"), F.col("seq"))
    last = cost_states.groupBy("session_id").agg(state.alias("s"))
    sessions = messages.select("session_id").union(cost_states.select("session_id")).distinct()
    joined = sessions.join(summed, "session_id", "left").join(last, "session_id", "left")
    models = F.map_values("s.model_usage")
    has_models = F.coalesce(F.size(models) > 0, F.lit(False))

    def total(field: str):
        return F.aggregate(models, F.lit(0.0), lambda acc, v: acc + F.coalesce(v[field], F.lit(0.0)))

    pick = lambda field, own: F.when(has_models, total(field)).otherwise(F.coalesce(F.col(own), F.lit(0.0)))
    return joined.select(
        "session_id",
        pick("inputTokens", "m_input").alias("input"),
        pick("outputTokens", "m_output").alias("output"),
        pick("cacheReadInputTokens", "m_cache_read").alias("cache_read"),
        pick("cacheCreationInputTokens", "m_cache_write").alias("cache_write"),
        F.coalesce("s.total_cost", F.lit(0.0)).alias("cost"),
        F.col("s.total_cost").isNotNull().alias("cost_recorded"),
        F.when(F.col("s.lines_added") > 0, F.col("s.lines_added")).alias("state_lines_added"),
        F.when(F.col("s.lines_removed") > 0, F.col("s.lines_removed")).alias("state_lines_removed"),
    )


def model_intervals(messages: DataFrame) -> DataFrame:
    """Model time: from the latest human or result time to each later answer."""
    anchor = F.when(F.col("is_human") | F.col("has_results"), F.col("ts_ms"))
    scanned = ordered_scan(
        messages.where("ts_ms is not null"), ["session_id"], ["seq"], by_width("seq", SEQ_CHUNK),
        maxs={"start_ms": anchor},
    )
    return scanned.where("role = 'assistant' and ts_ms > start_ms").select(
        "session_id", "seq", "start_ms", F.col("ts_ms").alias("end_ms"),
        F.lit("model").alias("bucket"), F.lit(False).alias("background"),
    )


def log_tables(lines: DataFrame, source: str = "b") -> LogTables:
    return tables_of(materialise(parse_records(lines).drop("line"), wide=True), source)


def tables_of(records: DataFrame, source: str = "b") -> LogTables:
    """The typed tables of flat logs in the shape every operator reads.

    An answer's model time runs from the latest human or result time; a call
    starts with its record. The last cost record gives usage per model where it
    lists models, and the total; what its models leave of the total is booked
    on `unknown`. Repeated calls of an id count once.
    """
    flat = flat_tables(records)
    own = [F.lit(source).alias("source"), F.col("session_id"), F.lit("primary").alias("kind"), F.lit("").alias("sidecar_name")]
    none = lambda kind: F.lit(None).cast(kind)
    first = F.min_by(F.struct("seq", "ts_ms", "tool", "input"), F.struct("seq", "idx"))
    calls = materialise(flat.tool_calls.groupBy("session_id", "call_id").agg(first.alias("c"), F.min("idx").alias("idx")).select("session_id", "call_id", "idx", "c.*"))
    arg = lambda name: F.col("input")[name]
    text = lambda name: F.coalesce(arg(name), F.lit(""))
    tool_calls = calls.select(
        *own, "seq", "ts_ms", "idx", "call_id", "tool",
        F.when(text("file_path") != "", arg("file_path")).otherwise(arg("path")).alias("path"), arg("content").alias("content"), none("string").alias("input"),
        arg("command").alias("command"), none("string").alias("code"), none("string").alias("language"), arg("subagent_type").alias("agent"),
        none("array<struct<name:string,agent:string>>").alias("tasks"), F.col("input").alias("arguments"),
    )

    began = model_intervals(flat.messages).select("session_id", "seq", (F.col("end_ms") - F.col("start_ms")).cast("double").alias("duration_ms"))
    spoken = flat.messages.where("not (role = 'user' and has_results)").join(began, ["session_id", "seq"], "left").select(
        "session_id", "seq", "ts_ms", "role", "text", "is_human", "model", "duration_ms", "input", "output", "cache_read", "cache_write",
        F.lit("").alias("tool"), F.lit("").alias("call_id"), F.lit(False).alias("is_error"),
    )
    named = flat.tool_results.join(calls.select("session_id", "call_id", "tool"), ["session_id", "call_id"], "left")
    zero = F.lit(0.0)
    returned = named.select(
        "session_id", "seq", "ts_ms", F.lit("toolResult").alias("role"), F.lit("").alias("text"), F.lit(False).alias("is_human"), F.lit("unknown").alias("model"),
        none("double").alias("duration_ms"), *[zero.alias(c) for c in ("input", "output", "cache_read", "cache_write")], F.coalesce("tool", F.lit("")).alias("tool"), "call_id", "is_error",
    )
    messages = spoken.unionByName(returned).select(
        *own, "seq", none("string").alias("rec_id"), "ts_ms", F.col("ts_ms").alias("entry_ms"), "role", "text", "is_human", F.lit(False).alias("steering"),
        F.lit("").alias("stop_reason"), none("string").alias("error_message"), "model", F.lit("unknown").alias("provider"), none("double").alias("ttft_ms"), "duration_ms",
        none("bigint").alias("completed_ms"), "input", "output", "cache_read", "cache_write", zero.alias("cost"), zero.alias("cost_input"), zero.alias("cost_output"), "tool", "call_id", "is_error",
    )
    starts = calls.where("ts_ms is not null").select(*own, "seq", "call_id", "tool", F.col("ts_ms").alias("started_ms"), F.lit(False).alias("has_intent"))

    last = flat.cost_states.groupBy("session_id").agg(F.max("seq").alias("seq"), F.max_by(F.struct("total_cost", "model_usage"), F.col("seq")).alias("s"))
    listed = materialise(last.select("session_id", "seq", F.explode("s.model_usage").alias("model", "u")))
    amount = lambda c: F.coalesce(F.col(f"u.{c}"), zero)
    use = ["input", "output", "cache_read", "cache_write", "cost"]
    by_model = listed.select(
        "session_id", "seq", "model", amount("inputTokens").alias("input"), amount("outputTokens").alias("output"), amount("cacheReadInputTokens").alias("cache_read"),
        amount("cacheCreationInputTokens").alias("cache_write"), amount("costUSD").alias("cost"),
    )
    spent = by_model.groupBy("session_id").agg(F.sum("cost").alias("model_cost"))
    rest = last.join(spent, "session_id", "left").select(
        "session_id", "seq", F.lit("unknown").alias("model"), *[zero.alias(c) for c in use[:4]], (F.coalesce("s.total_cost", zero) - F.coalesce("model_cost", zero)).alias("cost"),
    ).where("cost <> 0")
    answers = counted_responses(flat.messages).join(listed.select("session_id").distinct(), "session_id", "left_anti").select("session_id", "seq", "model", *use[:4], zero.alias("cost"))
    usage_events = by_model.unionByName(rest).unionByName(answers).select(
        *own, "seq", "model", F.lit("unknown").alias("provider"), F.lit(False).alias("utility"), *use, zero.alias("cost_input"), zero.alias("cost_output"),
    )

    identity = session_identity(flat.records)
    header = identity.select(
        *own, F.col("stop_ms").alias("end_ms"), F.col("start_ms").alias("first_ms"), F.coalesce("record_session_id", "session_id").alias("record_session_id"),
        F.date_format(F.timestamp_millis("start_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("start_iso"), "cwd", none("string").alias("parent_session"), "uses_subagent",
    )
    markers = flat.records.where("false").select(*own, "seq", F.lit("").alias("marker"), none("array<string>").alias("rules"))
    jobs = flat.records.where("false").select(
        *own, "seq", none("bigint").alias("delivery_ms"), F.lit(0).alias("job_no"), F.lit("").alias("job_id"), F.lit("").alias("job_type"), none("bigint").alias("duration_ms"), F.lit("").alias("label"),
    )
    return LogTables(flat.records, header, messages, tool_calls, starts, usage_events, markers, jobs)


# Tools that read, write and change files.
READERS, WRITERS = ["Read", "Write", "Edit", "NotebookEdit"], ["Write", "Edit", "NotebookEdit"]


def edit_rows(calls: DataFrame) -> DataFrame:
    """(session_id, path or NULL, added, removed) of each call that writes a file."""
    lines = lambda c: F.length(F.coalesce(c, F.lit(""))) - F.length(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"))) + 1
    new, old = F.col("arguments.new_string"), F.col("arguments.old_string")
    added = F.when(F.col("tool") == "Write", lines(F.col("content"))).when(F.col("tool") == "Edit", lines(new)).otherwise(0)
    return calls.where(F.col("tool").isin(*WRITERS)).select(
        "session_id", F.when(F.coalesce("path", F.lit("")) != "", F.col("path")).alias("path"),
        added.cast("bigint").alias("added"), F.when(F.col("tool") == "Edit", lines(old)).otherwise(0).cast("bigint").alias("removed"),
    )


def language_counts(calls: DataFrame) -> DataFrame:
    rows = calls.where(F.col("tool").isin(*READERS)).select("session_id", language_of(F.coalesce("path", F.lit(""))).alias("language"))
    return rows.where("language is not null").groupBy("session_id", "language").agg(F.count("*").alias("n"))


def git_counts(calls: DataFrame) -> DataFrame:
    return calls.where("tool = 'Bash'").groupBy("session_id").agg(
        F.count_if(F.col("command").contains("git commit")).alias("git_commits"), F.count_if(F.col("command").contains("git push")).alias("git_pushes"),
    )


def tool_flags(counts: DataFrame, header: DataFrame) -> DataFrame:
    """Subagents by their tool or a side chain; remote tool servers by name."""
    side = header.select("session_id", F.col("uses_subagent").alias("_side"))
    used = counts.groupBy("session_id").agg(F.max(F.col("tool") == "Task").alias("_task"), F.max(F.col("tool").startswith("mcp__")).alias("uses_mcp"))
    either = F.coalesce("_side", F.lit(False)) | F.coalesce("_task", F.lit(False))
    return side.join(used, "session_id", "full_outer").select("session_id", either.alias("uses_subagent"), F.coalesce("uses_mcp", F.lit(False)).alias("uses_mcp"))


def recorded_totals(tables: LogTables) -> DataFrame:
    """Per session: whether a cost is recorded, and the line totals that supersede edits."""
    r = F.col("r")
    last = tables.records.where(r["type"] == "cost-state").groupBy("session_id").agg(
        F.max_by(F.struct(r["totalCostUSD"].alias("cost"), r["totalLinesAdded"].alias("added"), r["totalLinesRemoved"].alias("removed")), F.col("seq")).alias("s")
    )
    positive = lambda c: F.when(F.col(c) > 0, F.col(c)).cast("bigint")
    return last.select("session_id", F.col("s.cost").isNotNull().alias("cost_recorded"), positive("s.added").alias("state_added"), positive("s.removed").alias("state_removed"))
