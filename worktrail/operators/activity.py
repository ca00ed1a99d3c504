"""Activity over wall-clock time, within and across sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.operators.scan import DAY_MS, HOUR_MS, by_width, covered_length, ordered_scan
from worktrail.session import materialise

GAP_MS = 15 * 60_000  # fixed value: a longer gap ends an activity run
CORPUS_CHUNK_MS = 5 * 60_000  # messages of all sessions together: short chunks
OVERLAP_MS = 30 * 60_000  # fixed value: messages this close may interleave


def activity_runs(times: DataFrame, keys: Sequence[str] = ("session_id",), gap_ms: int = GAP_MS) -> DataFrame:
    """Merge timestamps while the gap is at most `gap_ms`; a lone one has length 0.

    Only rows at the edge of a run go on to the second scan.
    """
    keys = list(keys)
    points = times.where("ts_ms is not null").groupBy(*keys, "ts_ms").agg(F.count("*").alias("n"))
    around = ordered_scan(
        points, keys, ["ts_ms"], by_width("ts_ms", HOUR_MS),
        sums={"upto": F.col("n")}, last={"prev": F.col("ts_ms")}, next_={"next": F.col("ts_ms")},
    )
    opens = F.col("prev").isNull() | (F.col("ts_ms") - F.col("prev") > gap_ms)
    closes = F.col("next").isNull() | (F.col("next") - F.col("ts_ms") > gap_ms)
    edges = materialise(around.withColumn("opens", opens).withColumn("closes", closes).where("opens or closes"))
    end = F.struct(F.col("ts_ms").alias("ts_ms"), F.col("upto").alias("upto"))
    paired = ordered_scan(
        edges, keys, ["ts_ms"], by_width("ts_ms", HOUR_MS), next_={"e": F.when(F.col("closes"), end)}
    )
    stop = F.when(F.col("closes"), end).otherwise(F.col("e"))
    return paired.where("opens").select(
        *keys, F.col("ts_ms").alias("start_ms"), stop["ts_ms"].alias("end_ms"),
        (stop["upto"] - F.col("upto") + F.col("n")).alias("records"),
    )


def local_midnights(df: DataFrame, zone: str = "UTC") -> DataFrame:
    """Split intervals at local midnight; adds `local_day`."""
    local = lambda c: F.to_date(F.from_utc_timestamp(F.timestamp_millis(c), zone))
    midnight = lambda d: F.unix_millis(F.to_utc_timestamp(d.cast("timestamp"), zone))
    days = F.sequence(local(F.col("start_ms")), local(F.col("end_ms")))
    return (
        df.where("end_ms > start_ms").withColumn("local_day", F.explode(days))
        .withColumn("start_ms", F.greatest("start_ms", midnight(F.col("local_day"))))
        .withColumn("end_ms", F.least("end_ms", midnight(F.date_add("local_day", 1))))
        .where("end_ms > start_ms")
    )


def active_hours_by_day(runs: DataFrame, by: Sequence[str] = (), zone: str = "UTC") -> DataFrame:
    """Hours of activity per local day; parallel sessions count once."""
    covered = covered_length(local_midnights(runs, zone), [*by, "local_day"])
    return covered.select(*by, "local_day", (F.col("covered_ms") / float(HOUR_MS)).alias("hours"))


def interleavings(
    messages: DataFrame, by: Sequence[str] = (), window_ms: int = OVERLAP_MS, *,
    order: Sequence[str] = ("ts_ms", "seq", "session_id"), chunk: Column | None = None,
) -> DataFrame:
    """Consecutive messages of one session with another session in between.

    "In between" is by `order`: by time, equal times by seq. Where seq counts the
    messages of all sessions, order=["seq"] is the order of arrival. In that
    order each run of one session's messages ends where another session's
    begins; that message is the first between, if the session's own next one
    comes after it, so no join is needed.
    """
    order = list(order)
    chunk = by_width("ts_ms", CORPUS_CHUNK_MS) if chunk is None else chunk
    points = messages.where("is_human and ts_ms is not null").select(*by, "session_id", "seq", "ts_ms")
    keys = list(by) or ["_all"]
    rows = points if by else points.withColumn("_all", F.lit(1))
    place = F.struct(*[F.col(c) for c in order])
    here = F.struct(F.col("session_id").alias("sid"), F.col("ts_ms").alias("ts"), place.alias("at"))
    prior = materialise(ordered_scan(rows, keys, order, chunk, last={"p": F.col("session_id")}))
    begins = F.when(F.col("p").isNull() | (F.col("p") != F.col("session_id")), here)
    every = materialise(ordered_scan(prior, keys, order, chunk, next_={"n": begins}))
    own = F.struct(F.col("ts_ms").alias("ts"), place.alias("at"))
    found = ordered_scan(every, [*keys, "session_id"], ["ts_ms", "seq"], by_width("ts_ms", HOUR_MS), next_={"own": own})
    hit = found.where((F.col("own.ts") - F.col("ts_ms") <= window_ms) & (F.col("n.at") < F.col("own.at")))
    return hit.select(
        *by, "session_id", F.col("ts_ms").alias("from_ms"), F.col("own.ts").alias("to_ms"),
        F.col("n.sid").alias("other_id"), F.col("n.ts").alias("other_ms"),
    )


def overlap_summary(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct pairs, sessions in them and messages involved."""
    keys = list(by)
    pair = F.array_sort(F.array("session_id", "other_id"))
    tagged = found.select(
        *keys, F.explode(F.array(
            F.struct(F.lit("pair").alias("what"), F.array_join(pair, ":").alias("id")),
            F.struct(F.lit("session").alias("what"), F.col("session_id").alias("id")),
            F.struct(F.lit("session").alias("what"), F.col("other_id").alias("id")),
            F.struct(F.lit("message").alias("what"), F.concat_ws(":", "from_ms", "session_id").alias("id")),
            F.struct(F.lit("message").alias("what"), F.concat_ws(":", "to_ms", "session_id").alias("id")),
            F.struct(F.lit("message").alias("what"), F.concat_ws(":", "other_ms", "other_id").alias("id")),
        )).alias("x"),
    ).groupBy(*keys, "x.what", "x.id").agg(F.lit(1).alias("one"))
    return tagged.groupBy(*keys).agg(
        F.count_if(F.col("what") == "pair").alias("overlap_events"),
        F.count_if(F.col("what") == "session").alias("sessions_involved"),
        F.count_if(F.col("what") == "message").alias("user_messages_during"),
    )


def busy_elsewhere(gaps: DataFrame, messages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gaps [start_ms, end_ms) in which another session has a human message.

    Two forward look-ups instead of a range join: the first message at or
    after the gap's start, and the first after it from any other session.
    """
    keys = list(by) or ["_all"]
    add = (lambda d: d) if by else (lambda d: d.withColumn("_all", F.lit(1)))
    points = add(messages.where("is_human and ts_ms is not null").select(*by, "session_id", "seq", "ts_ms"))
    order = ["ts_ms", "session_id", "seq"]
    chunk = by_width("ts_ms", CORPUS_CHUNK_MS)
    prior = materialise(ordered_scan(points, keys, order, chunk, last={"p": F.col("session_id")}))
    starts = F.when(F.col("p").isNull() | (F.col("p") != F.col("session_id")), F.col("ts_ms"))
    nexts = materialise(ordered_scan(prior, keys, order, chunk, next_={"other_ms": starts}))
    m = nexts.select(
        *keys, F.col("ts_ms").alias("t"), F.lit(1).alias("is_message"), "session_id", "seq",
        F.struct(F.col("session_id").alias("sid"), F.col("ts_ms").alias("ts"), F.col("other_ms").alias("other")).alias("m"),
        F.lit(None).cast("bigint").alias("end_ms"),
    )
    g = add(materialise(gaps)).select(
        *keys, F.col("start_ms").alias("t"), F.lit(0).alias("is_message"), "session_id",
        F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("struct<sid:string,ts:bigint,other:bigint>").alias("m"), "end_ms",
    )
    # A gap sorts before messages of the same time, so its start is inclusive.
    met = ordered_scan(
        m.unionByName(g), keys, ["t", "is_message", "session_id", "seq"],
        by_width("t", CORPUS_CHUNK_MS), next_={"first": F.col("m")},
    ).where("is_message = 0")
    foreign = F.when(F.col("first.sid") != F.col("session_id"), F.col("first.ts")).otherwise(F.col("first.other"))
    return met.where(foreign < F.col("end_ms")).select(*by, "session_id", F.col("t").alias("start_ms"), "end_ms")


def hour_histogram(messages: DataFrame, by: Sequence[str] = (), zone: str = "UTC") -> DataFrame:
    """Human messages per local hour, all 24 hours present."""
    hour = F.hour(F.from_utc_timestamp(F.timestamp_millis("ts_ms"), zone))
    wide = messages.where("is_human and ts_ms is not null").select(*by, hour.alias("h")).groupBy(*by).agg(
        *[F.count_if(F.col("h") == h).alias(f"h{h}") for h in range(24)]
    )
    cells = F.array(*[F.struct(F.lit(h).alias("hour"), F.col(f"h{h}").alias("n")) for h in range(24)])
    return wide.select(*by, F.explode(cells).alias("x")).select(*by, "x.hour", "x.n")


# Upper edges (seconds) and names of the reply-time bands.
REPLY_BANDS = [(10, "2-10s"), (30, "10-30s"), (60, "30s-1m"), (120, "1-2m"), (300, "2-5m"), (900, "5-15m"), (None, ">15m")]


def reply_histogram(replies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Replies per band, all seven bands present."""
    low, cells, counts = None, [], []
    for i, (high, name) in enumerate(REPLY_BANDS):
        test = F.lit(True)
        if low is not None:
            test = test & (F.col("reply_sec") >= low)
        if high is not None:
            test = test & (F.col("reply_sec") < high)
        counts.append(F.count_if(test).alias(f"b{i}"))
        cells.append(F.struct(F.lit(name).alias("band"), F.col(f"b{i}").alias("n")))
        low = high
    wide = replies.groupBy(*by).agg(*counts)
    return wide.select(*by, F.explode(F.array(*cells)).alias("x")).select(*by, "x.band", "x.n")
