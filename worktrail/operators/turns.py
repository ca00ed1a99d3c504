"""Requests (turns), interruptions and reply times inside a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.functions.labels import EXPLORATION_TOOLS, MUTATION_TOOLS
from worktrail.functions.numeric import exact_sum, percentiles
from worktrail.functions.text import COURSE_CORRECTION, is_correction, jaccard, trimmed
from worktrail.operators.scan import SEQ_CHUNK, by_width, ordered_scan
from worktrail.operators.usage import top_rows
from worktrail.session import materialise

KEY = ["session_id"]


def _chunk():
    return by_width("seq", SEQ_CHUNK)


def turn_rollup(messages: DataFrame) -> DataFrame:
    """One row per turn: a human message up to the next one.

    Rows before the first human message belong to no turn. Exploration counts
    only before the first change of a file in the turn.
    """
    timed_human = F.col("is_human") & F.col("ts_ms").isNotNull()
    tool = F.lower(F.trim("tool"))
    is_result, is_answer = F.col("role") == "toolResult", F.col("role") == "assistant"
    mutates = is_result & tool.isin(*MUTATION_TOOLS)
    slim = messages.select(
        *KEY, "seq", "ts_ms", "entry_ms", "completed_ms", "cost", "stop_reason",
        timed_human.alias("opens"), is_answer.alias("is_answer"), is_result.alias("is_result"),
        mutates.alias("mutates"), (is_result & tool.isin(*EXPLORATION_TOOLS)).alias("explores"),
        F.when(timed_human, F.substring(trimmed(F.col("text")), 1, 120)).alias("prompt"),
    )
    rows = ordered_scan(
        slim, KEY, ["seq"], _chunk(),
        sums={"turn_no": F.col("opens").cast("bigint")},
        last={
            "changed_at": F.when(F.col("mutates"), F.col("seq")),
            "opened_at": F.when(F.col("opens"), F.col("seq")),
        },
    ).where("turn_no > 0")
    early = F.col("changed_at").isNull() | (F.col("changed_at") < F.col("opened_at"))
    answer_seq = F.when(F.col("is_answer"), F.col("seq"))
    end_of_answer = F.coalesce("completed_ms", "entry_ms", "ts_ms")
    result_ts = F.when(F.col("is_result") & F.col("ts_ms").isNotNull(), F.col("seq"))
    turns = rows.groupBy(*KEY, "turn_no").agg(
        F.max(F.when(F.col("opens"), F.col("ts_ms"))).alias("start_ms"),
        F.max("prompt").alias("prompt"),
        F.count_if("is_answer").alias("round_trips"),
        F.count_if("is_result").alias("tool_calls"),
        F.count_if(F.col("explores") & early).alias("exploration"),
        F.max("mutates").alias("mutated"),
        exact_sum(F.when(F.col("is_answer"), F.col("cost"))).alias("cost"),
        F.coalesce(F.max_by(F.col("stop_reason") == "aborted", answer_seq), F.lit(False)).alias("aborted"),
        F.max_by(end_of_answer, answer_seq).alias("_answer_end"),
        F.max_by("ts_ms", result_ts).alias("_result_end"),
        F.max("is_answer").alias("_answered"),
    )
    end = F.when(F.col("_answered"), F.col("_answer_end")).otherwise(F.col("_result_end"))
    wall = F.coalesce(F.greatest(F.lit(0.0), (end - F.col("start_ms")) / 1000.0), F.lit(0.0))
    return turns.withColumn("wall_sec", wall).drop("_answer_end", "_result_end", "_answered")


METRICS = ["round_trips", "tool_calls", "exploration", "wall_sec"]


def turn_percentiles(turns: DataFrame) -> DataFrame:
    """(session_id, metric, p50, p90) of the four turn metrics."""
    long = turns.select(
        *KEY, F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS
        ])).alias("x"),
    ).select(*KEY, "x.metric", "x.value")
    return percentiles(long, [*KEY, "metric"], "value", {"p50": 50, "p90": 90})


def worst_turns(turns: DataFrame, k: int = 5) -> DataFrame:
    return top_rows(turns, KEY, [F.desc("tool_calls"), F.asc("turn_no")], k)


def abort_events(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Aborted answers with what came before and what the user said next.

    Calls are counted since the last human message; those of the aborted
    answer itself come after it (`part` 1 sorts behind the message).
    """
    aborted = (F.col("role") == "assistant") & (F.col("stop_reason") == "aborted")
    base = messages.select(
        *KEY, "seq", F.lit(0).alias("part"), "ts_ms", F.col("is_human"), aborted.alias("is_abort"),
        trimmed(F.col("text")).alias("text"), F.lit(0).cast("bigint").alias("calls"),
    )
    marks = calls.select(
        *KEY, "seq", (F.col("idx") + 1).alias("part"), F.lit(None).cast("bigint").alias("ts_ms"),
        F.lit(False).alias("is_human"), F.lit(False).alias("is_abort"), F.lit("").alias("text"),
        F.lit(1).cast("bigint").alias("calls"),
    )
    counted = materialise(ordered_scan(
        base.unionByName(marks), KEY, ["seq", "part"], _chunk(), sums={"calls_so_far": F.col("calls")}
    ).where("is_human or is_abort"))
    said = F.when(F.col("is_human"), F.struct("ts_ms", "text", "calls_so_far"))
    events = ordered_scan(
        counted, KEY, ["seq", "part"], _chunk(), last={"prev": said}, next_={"next": said}
    ).where("is_abort")
    gap = (F.col("next.ts_ms") - F.col("ts_ms")) / 1000.0
    rows = events.select(
        *KEY, "seq", "ts_ms",
        (F.col("calls_so_far") - F.coalesce("prev.calls_so_far", F.lit(0))).alias("tool_calls_before"),
        F.coalesce((F.col("ts_ms") - F.col("prev.ts_ms")) / 1000.0, F.lit(0.0)).alias("elapsed_sec"),
        F.substring("text", 1, 200).alias("partial_text"),
        F.substring("next.text", 1, 200).alias("next_text"),
        gap.alias("gap_sec"), F.coalesce("prev.text", F.lit("")).alias("prev_text"),
    )
    rephrased = (
        (F.col("tool_calls_before") == 0) & (F.col("gap_sec") < 60)
        & (F.coalesce("next_text", F.lit("")) != "")
        & (jaccard(F.col("prev_text"), F.col("next_text")) >= 0.5)
    )
    label = (
        F.when(F.col("next_text").rlike("(?i)" + COURSE_CORRECTION), "course_correction")
        .when(rephrased, "user_rephrased")
        .when(F.col("gap_sec").isNull() | (F.col("gap_sec") > 300), "abandoned")
        .otherwise("unknown")
    )
    return rows.withColumn("label", label).drop("prev_text")


def first_aborts(events: DataFrame, k: int = 10) -> DataFrame:
    """The first aborts of each session, for display."""
    return top_rows(events, KEY, [F.asc("seq")], k, rank="abort_no")


def abort_resolution(messages: DataFrame) -> DataFrame:
    """Each aborted answer with the next human message (NULL: none came)."""
    keep = messages.select(
        *KEY, "seq", "ts_ms", "is_human",
        ((F.col("role") == "assistant") & (F.col("stop_reason") == "aborted")).alias("is_abort"),
    ).where("is_human or is_abort")
    found = ordered_scan(
        keep, KEY, ["seq"], _chunk(),
        next_={"n": F.when(F.col("is_human"), F.struct(F.col("seq").alias("seq"), F.col("ts_ms").alias("ts_ms")))},
    )
    return found.where("is_abort").select(
        *KEY, "seq", F.col("n.seq").alias("next_seq"), ((F.col("n.ts_ms") - F.col("ts_ms")) / 1000.0).alias("gap_sec")
    )


def reply_times(messages: DataFrame) -> DataFrame:
    """Seconds from the last answer to each human message, kept in (2, 3600)."""
    keep = messages.where("ts_ms is not null and (is_human or role = 'assistant')").select(
        *KEY, "seq", "ts_ms", "is_human", "role"
    )
    found = ordered_scan(
        keep, KEY, ["seq"], _chunk(), last={"answered_ms": F.when(F.col("role") == "assistant", F.col("ts_ms"))}
    )
    gap = (F.col("ts_ms") - F.col("answered_ms")) / 1000.0
    return found.where("is_human").select(*KEY, "seq", gap.alias("reply_sec")).where(
        "reply_sec > 2 and reply_sec < 3600"
    )


def ends_aborted(messages: DataFrame) -> DataFrame:
    """Whether the last message of the session is an aborted answer."""
    aborted = (F.col("role") == "assistant") & (F.col("stop_reason") == "aborted")
    return messages.groupBy(*KEY).agg(F.max_by(aborted, F.col("seq")).alias("ends_aborted"))


def request_spans(messages: DataFrame, calls: DataFrame, max_lines: int = 5) -> DataFrame:
    """Counters of the current request: everything since the last human message.

    A correction is a human message that reads as one or follows an aborted
    answer. The failed lines are the first `max_lines`, in log order.
    """
    aborted = (F.col("role") == "assistant") & (F.col("stop_reason") == "aborted")
    human_at = F.when(F.col("is_human") & F.col("ts_ms").isNotNull(), F.col("seq"))
    last = messages.groupBy(*KEY).agg(
        F.max(human_at).alias("start_seq"), F.max_by("ts_ms", human_at).alias("start_ms"),
        F.max("ts_ms").alias("stop_ms"),
    ).where("start_seq is not null")
    scanned = ordered_scan(
        messages.select(*KEY, "seq", "ts_ms", "role", "text", "tool", "is_error", "is_human", aborted.alias("is_abort")),
        KEY, ["seq"], _chunk(), last={"prev_abort": F.col("is_abort")},
    )
    span = materialise(scanned.join(last.select(*KEY, "start_seq"), KEY).where("seq >= start_seq"))
    phrase = F.col("is_human") & is_correction(F.col("text"))
    follows = F.col("is_human") & ~phrase & F.coalesce("prev_abort", F.lit(False))
    failed = (F.col("role") == "toolResult") & F.col("is_error")
    first_line = F.trim(F.element_at(F.split(trimmed(F.col("text")), "\n"), 1))
    line = F.concat(
        F.when(F.col("tool") == "", "tool").otherwise(F.col("tool")), F.lit(": "),
        F.when(first_line == "", "(no output)").otherwise(first_line),
    )
    counters = span.groupBy(*KEY).agg(
        F.count_if(failed).alias("tool_errors"), F.count_if(phrase).alias("phrase_corrections"),
        F.count_if(follows).alias("abort_corrections"),
        F.min_by(F.substring(trimmed(F.col("text")), 1, 200), F.when(phrase | follows, F.col("seq"))).alias("quote"),
    )
    lines = top_rows(span.where(failed).select(*KEY, "seq", F.substring(line, 1, 200).alias("line")), KEY, [F.asc("seq")], max_lines)
    joined = lines.groupBy(*KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("failed_lines")
    )
    n_calls = calls.join(last.select(*KEY, "start_seq"), KEY).where("seq >= start_seq").groupBy(*KEY).agg(F.count("*").alias("tool_calls"))
    return (
        last.join(counters, KEY).join(n_calls, KEY, "left").join(joined, KEY, "left")
        .na.fill(0, ["tool_calls"]).na.fill("", ["failed_lines"])
    )
