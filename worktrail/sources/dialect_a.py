"""Record normalisation, dialect A: one typed JSON record per line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.functions.text import is_human_message
from worktrail.session import materialise

COST = "struct<input:double,output:double,cacheRead:double,cacheWrite:double,total:double>"
USAGE = f"struct<input:double,output:double,cacheRead:double,cacheWrite:double,totalTokens:double,cost:{COST}>"
RECORD = (
    "type string, customType string, id string, timestamp string, cwd string, parentSession string, "
    "model string, provider string, injectedRules array<string>, "
    f"usage {USAGE}, "
    "data struct<toolCallId:string,toolName:string,startedAt:string,intent:string>, "
    "details struct<jobs:array<struct<jobId:string,type:string,durationMs:double,label:string>>>, "
    "message struct<role:string,attribution:string,steering:boolean,model:string,provider:string,"
    f"usage:{USAGE},ttft:double,duration:double,timestamp:double,completedAt:double,stopReason:string,"
    "errorMessage:string,toolName:string,toolCallId:string,isError:boolean,content:string>"
)
BLOCKS = "array<struct<type:string,text:string,id:string,name:string,arguments:string>>"
ARGUMENTS = (
    "path string, content string, input string, command string, code string, language string, "
    "agent string, tasks array<struct<name:string,agent:string>>"
)
OWNER = ["source", "session_id", "kind", "sidecar_name"]


def millis(iso: Column) -> Column:
    """Epoch ms of an ISO text, NULL if it is not one."""
    return F.unix_millis(F.try_to_timestamp(iso))


@dataclass(frozen=True)
class LogTables:
    """Typed tables every operator reads; `records` is the parsed source."""

    records: DataFrame
    header: DataFrame
    messages: DataFrame
    tool_calls: DataFrame
    tool_starts: DataFrame
    usage_events: DataFrame
    markers: DataFrame
    async_jobs: DataFrame


def usage_columns(usage: Column) -> list[Column]:
    """Seven sums of a usage record; missing or wrong-typed numbers are 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cost = usage["cost"]
    return [
        zero(usage["input"]).alias("input"),
        zero(usage["output"]).alias("output"),
        zero(usage["cacheRead"]).alias("cache_read"),
        zero(usage["cacheWrite"]).alias("cache_write"),
        zero(cost["total"]).alias("cost"),
        zero(cost["input"]).alias("cost_input"),
        zero(cost["output"]).alias("cost_output"),
    ]


def content_is_list(content: Column) -> Column:
    """Whether `content` of the record in `line` is a list of blocks, not a text that starts with a bracket.

    Such a text is written `"[` or with an escape; only lines that hold one of
    the two are parsed once more, for the variant's type.
    """
    line = F.col("line")
    whole = F.try_variant_get(F.try_parse_json(line), "$.message.content", "variant")
    unsure = line.contains('"[') | line.contains('"\\u005')
    return F.when(~content.startswith("["), False).when(unsure, F.schema_of_variant(whole).startswith("ARRAY")).otherwise(content.isNotNull())


def parse_records(lines: DataFrame) -> DataFrame:
    """Add the typed record `r`, `entry_ms`, content blocks and text.

    Input: OWNER columns, seq, line. Content is text or a list of blocks; a
    text that merely starts with a bracket is told apart by its variant type.
    """
    parsed = lines.withColumn("r", F.from_json("line", RECORD))
    content = F.col("r.message.content")
    is_list = content_is_list(content)
    typed = parsed.withColumn("entry_ms", millis(F.col("r.timestamp"))).withColumn(
        "blocks", F.when(is_list, F.from_json(content, BLOCKS))
    )
    texts = F.filter("blocks", lambda b: (b["type"] == "text") & b["text"].isNotNull())
    joined = F.array_join(F.transform(texts, lambda b: b["text"]), " ")
    any_text = F.exists(texts, lambda b: b["text"].rlike(r"\S"))
    return typed.withColumn(
        "text", F.when(F.col("blocks").isNotNull(), joined).otherwise(F.coalesce(content, F.lit("")))
    ).withColumn("has_text", F.coalesce(any_text, F.lit(False)))


def normalise(lines: DataFrame) -> LogTables:
    """Typed tables from record lines."""
    # Some ten selects read the records: parse each line once.
    return tables_of(materialise(parse_records(lines).drop("line"), wide=True))


def tables_of(records: DataFrame) -> LogTables:
    """Typed tables from parsed records."""
    owner = [F.col(c) for c in OWNER]
    kind, custom = F.col("r.type"), F.col("r.customType")

    msg = records.where((kind == "message") & F.col("r.message").isNotNull())
    m = F.col("r.message")
    ts = F.coalesce(m["timestamp"].cast("bigint"), F.col("entry_ms"))
    messages = msg.select(
        *owner, "seq", F.col("r.id").alias("rec_id"), ts.alias("ts_ms"), "entry_ms",
        m["role"].alias("role"), "text",
        is_human_message(m["role"], m["attribution"], F.col("text")).alias("is_human"),
        F.coalesce(m["steering"], F.lit(False)).alias("steering"),
        F.coalesce(m["stopReason"], F.lit("")).alias("stop_reason"),
        m["errorMessage"].alias("error_message"),
        F.coalesce(m["model"], F.lit("unknown")).alias("model"),
        F.coalesce(m["provider"], F.lit("unknown")).alias("provider"),
        m["ttft"].alias("ttft_ms"), m["duration"].alias("duration_ms"),
        m["completedAt"].cast("bigint").alias("completed_ms"),
        *usage_columns(m["usage"]),
        F.coalesce(m["toolName"], F.lit("")).alias("tool"),
        F.coalesce(m["toolCallId"], F.lit("")).alias("call_id"),
        F.coalesce(m["isError"], F.lit(False)).alias("is_error"),
        "blocks",
    )

    block = msg.where(m["role"] == "assistant").select(
        *owner, "seq", ts.alias("ts_ms"), F.posexplode("blocks").alias("idx", "b")
    ).where("b.type = 'toolCall'")
    args = F.from_json("b.arguments", ARGUMENTS)
    tool_calls = block.select(
        *owner, "seq", "ts_ms", "idx",
        # A call without an id counts once: its place in the log is its id.
        F.coalesce(F.col("b.id"), F.concat(F.lit("@"), F.col("seq"), F.lit("."), F.col("idx"))).alias("call_id"),
        F.coalesce(F.col("b.name"), F.lit("")).alias("tool"),
        args.alias("args"),
    ).select(*OWNER, "seq", "ts_ms", "idx", "call_id", "tool", "args.*")

    started = F.col("r.data.startedAt")
    started_ms = F.coalesce(started.try_cast("double").cast("bigint"), millis(started))
    starts = records.where((kind == "custom") & (custom == "tool_execution_start"))
    tool_starts = starts.select(
        *owner, "seq", F.coalesce(F.col("r.data.toolCallId"), F.lit("")).alias("call_id"),
        F.coalesce(F.col("r.data.toolName"), F.lit("")).alias("tool"),
        started_ms.alias("started_ms"),
        (F.coalesce(F.col("r.data.intent"), F.lit("")) != "").alias("has_intent"),
    )

    utility = records.where(kind == "model_usage").select(
        *owner, "seq", F.coalesce(F.col("r.model"), F.lit("unknown")).alias("model"),
        F.coalesce(F.col("r.provider"), F.lit("unknown")).alias("provider"),
        F.lit(True).alias("utility"), *usage_columns(F.col("r.usage")),
    )
    from_messages = messages.where("role = 'assistant'").select(
        *OWNER, "seq", "model", "provider", F.lit(False).alias("utility"),
        "input", "output", "cache_read", "cache_write", "cost", "cost_input", "cost_output",
    )

    markers = records.where(
        kind.isin("thinking_level_change", "model_change", "compaction", "ttsr_injection", "reset_boundary")
    ).select(*owner, "seq", kind.alias("marker"), F.col("r.injectedRules").alias("rules"))

    jobs = (
        records.where((kind == "custom_message") & (custom == "async-result") & F.col("entry_ms").isNotNull())
        .select(*owner, "seq", F.col("entry_ms").alias("delivery_ms"), F.posexplode("r.details.jobs").alias("job_no", "j"))
        .select(
            *OWNER, "seq", "delivery_ms", "job_no", F.coalesce("j.jobId", F.lit("")).alias("job_id"),
            F.coalesce("j.type", F.lit("")).alias("job_type"),
            F.coalesce("j.durationMs", F.lit(0.0)).cast("bigint").alias("duration_ms"),
            F.coalesce("j.label", F.lit("")).alias("label"),
        )
        .where("job_id <> '' and duration_ms > 0")
    )

    session = records.where(kind == "session")
    at = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    heads = session.groupBy(*OWNER).agg(
        at(F.col("r.id")).alias("record_session_id"), at(F.col("r.timestamp")).alias("start_iso"),
        at(F.col("r.cwd")).alias("cwd"),
        F.min_by(F.col("r.parentSession"), F.col("seq")).alias("parent_session"),
    )
    ends = records.groupBy(*OWNER).agg(F.max("entry_ms").alias("end_ms"), F.min("entry_ms").alias("first_ms"))
    header = ends.join(heads, OWNER, "left")
    return LogTables(
        records, header, messages, tool_calls, tool_starts,
        utility.unionByName(from_messages), markers, jobs,
    )


def session_span(header: DataFrame, logs: DataFrame) -> DataFrame:
    """Start, end and whole minutes per session; file times stand in for gaps."""
    joined = header.join(
        logs.select("session_id", "path", F.col("mtime_ms").alias("_mtime")), "session_id", "left"
    )
    start = F.coalesce(millis(F.col("start_iso")), F.col("_mtime"))
    end = F.coalesce(F.when(F.col("end_ms") > 0, F.col("end_ms")), F.col("_mtime"))
    return span_columns(joined.withColumn("start_ms", start).withColumn("stop_ms", end)).drop("_mtime")


def span_columns(df: DataFrame) -> DataFrame:
    """duration_minutes = max(0, round((stop - start) in minutes)), halves up."""
    minutes = F.floor((F.col("stop_ms") - F.col("start_ms")) / F.lit(60000.0) + F.lit(0.5))
    return df.withColumn("duration_minutes", F.greatest(F.lit(0), minutes).cast("bigint"))
