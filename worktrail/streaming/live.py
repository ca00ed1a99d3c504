"""Streaming variants: live logs, activity, spend and long-request alerts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from worktrail.session import ensure_checkpoint_dir, ship_package
from worktrail.sources import dialect_a
from worktrail.sources.logs import is_record, records_of_lines
from worktrail.sources.scan import LogSource

MIN_MINUTES = 30  # fixed values: a request this long, or with this many calls, is worth a note
MIN_TOOL_CALLS = 100


def live_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Record lines of closed log segments as they appear; partial tails drop out."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).where(is_record(F.col("line")))


def live_logs(spark: SparkSession, root: str, listings: str, source: str = "a", flat: bool = False) -> DataFrame:
    """Record lines of logs that still grow, with their owner columns, as they are appended.

    `listings` is a shared folder that belongs to the query like its
    checkpoint: it holds how far each log was read. A line is read once its line
    break is there.
    """
    ship_package(spark)
    spark.dataSource.register(LogSource)
    lines = spark.readStream.format(LogSource.name()).option("listings", listings).option("source", source).option("flat", str(flat).lower()).load(root)
    return records_of_lines(lines)


def live_tables(lines: DataFrame) -> dict[str, DataFrame]:
    """The typed tables of a stream of dialect A lines, those that need no more than a line.

    Rows are those of the batch build, `seq` included; forks and duplicates are
    left to it.
    """
    tables = dialect_a.tables_of(dialect_a.parse_records(lines).drop("line"))
    return {name: getattr(tables, name) for name in ("messages", "tool_calls", "tool_starts", "usage_events", "markers", "async_jobs")}


def activity_runs(events: DataFrame, keys: list[str], gap: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Closed activity runs: first and last time and rows per run.

    The session window ends one gap after the last row; the true end is the
    latest time seen.
    """
    return (
        events.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("w"))
        .agg(F.min("ts").alias("run_start"), F.max("ts").alias("run_end"), F.count("*").alias("records"))
        .select(*keys, "run_start", "run_end", "records")
    )


def rolling_spend(events: DataFrame, keys: list[str], width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Cost, calls and error rate per tumbling or sliding window."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    total = events.withWatermark("ts", late).groupBy(*keys, window.alias("w")).agg(
        F.sum(F.col("cost").cast("decimal(38,12)")).cast("double").alias("cost"),
        F.count("*").alias("calls"), F.count_if("is_error").alias("errors"),
    )
    return total.select(
        *keys, F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "cost", "calls", "errors",
        (F.col("errors") / F.col("calls")).alias("error_rate"),
    )


def drop_redelivered(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First delivery of each id; copies within the watermark drop out."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class LatestDelivery(StatefulProcessor):
    """Hold the newest version of each key; give it out whenever it changes.

    State is one row per key, dropped when the watermark is `ttl_ms` past the
    last delivery. Of the rows of a micro-batch only the newest is held,
    whatever their number; of equal versions the first one stays.
    """

    def __init__(self, keys: list[str], order: str, columns: list[str], state: str, ttl_ms: int) -> None:
        self.keys, self.order, self.columns, self.schema, self.ttl_ms = keys, order, columns, state, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, *held = tuple(self.latest.get()) if self.latest.exists() else (None,)
        if due is not None and due <= timerValues.getCurrentWatermarkInMs():
            held = []  # timers run after the rows of a micro-batch
        best, last = tuple(held), 0
        for frame in rows:
            row = frame.loc[frame[self.order].idxmax(), [self.order, *self.columns]]
            last = max(last, int(frame["at_ms"].max()) + self.ttl_ms)
            if not best or row[self.order] > best[0]:
                best = tuple(x.item() if hasattr(x, "item") else x for x in row)
        if due is None or last > due:
            if due is not None:
                self.handle.deleteTimer(due)
            due = last
            self.handle.registerTimer(due)
        self.latest.update((due, *best))
        if list(best) != held:
            yield pd.DataFrame([(*key, *best, bool(held))], columns=[*self.keys, self.order, *self.columns, "replaced"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.latest.clear()
        yield from ()

    def close(self) -> None:
        pass


def latest_deliveries(events: DataFrame, keys: list[str], order: str, columns: list[str], ts: str = "ts", late: str = "10 minutes", ttl: timedelta = timedelta(days=1)) -> DataFrame:
    """The newest version of each key, and again each time a later delivery replaces it.

    Columns: keys, order (a number that rises with each version), columns,
    replaced. For sinks in update mode, keyed by `keys`; a key is forgotten
    `ttl` of event time after its last delivery. Needs the RocksDB state store.
    """
    ship_package(events.sparkSession)
    rows = events.withWatermark(ts, late).select(*keys, F.col(order).cast("bigint").alias(order), *columns, ts, F.unix_millis(F.col(ts)).alias("at_ms"))
    kind = lambda names: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    version = f"`{order}` bigint, {kind(columns)}"
    processor = LatestDelivery(keys, order, columns, f"due bigint, {version}", int(ttl.total_seconds() * 1000))
    return rows.groupBy(*keys).transformWithStateInPandas(processor, f"{kind(keys)}, {version}, replaced boolean", "Update", "EventTime")


def written(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now; every row it gave out.

    For update mode, which file sinks lack: each micro-batch is a folder of its
    own, so one that is repeated after a failure replaces itself.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last version of each key among rows given out, and how often it was."""
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.col(order)).alias("x"), F.count("*").alias("versions")).select(*keys, "x.*", "versions")


SESSION_BUCKETS = 1024  # fixed value: sessions are handed to Python by the bucket, as most have few rows
OPEN = "sessions array<string>, starts array<bigint>, calls array<bigint>, fired array<boolean>"
ALERT = "session_id string, start_ms bigint, fired_ms bigint, calls bigint, reason string"


def long_request_alerts(min_minutes: float = MIN_MINUTES, min_calls: int = MIN_TOOL_CALLS):
    """Fire once per request: 30 minutes, 100 tool calls or a correction.

    State per bucket of sessions is one row a session: request start, calls,
    fired. A human message starts a new request. The records of a micro-batch
    are sorted together, so Arrow's batch size does not matter; records older
    than a request that an earlier micro-batch started are skipped. An aborted
    answer holds a pending alert back until the next record. A request that
    fired is forgotten once the watermark is past its start: older records are
    late then, and newer ones need a new request to fire again.
    """
    min_ms = int(min_minutes * 60_000)

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["session_id", "ts_ms", "seq"], ignore_index=True)
        for at in range(0, len(rows), 100_000):
            part = rows.iloc[at:at + 100_000]
            yield from zip(part["session_id"].tolist(), part["ts_ms"].tolist(), part["flags"].tolist(), part["tool_calls"].tolist())

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {s: r for s, *r in zip(*state.get)} if state.exists else {}
        before = {s: r[0] for s, r in held.items()}
        out = []
        for session, at, flags, made in () if state.hasTimedOut else records(frames):
            if at < before.get(session, at):
                continue
            if flags & 1:
                held[session] = [at, 0, False]
            if session not in held:
                continue
            request = held[session]
            request[1] += made
            corrected = flags & 4
            if not request[2] and not flags & 2 and (corrected or request[1] >= min_calls or at - request[0] >= min_ms):
                request[2] = True
                out.append((session, request[0], at, request[1], "correction" if corrected else "tool_calls" if request[1] >= min_calls else "minutes"))
        now = state.getCurrentWatermarkMs()
        for session, request in held.items():
            if not request[2] and request[0] + min_ms <= now:
                request[2] = True
                out.append((session, request[0], request[0] + min_ms, request[1], "minutes"))
        kept = {s: r for s, r in held.items() if not r[2] or r[0] > now}
        if kept:
            state.update((list(kept), *map(list, zip(*kept.values()))))
            # The next request is due, or can be forgotten, once the watermark is there.
            state.setTimeoutTimestamp(min(r[0] if r[2] else r[0] + min_ms for r in kept.values()) - 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session_id", "start_ms", "fired_ms", "calls", "reason"])

    return step


def long_requests(messages: DataFrame, late: str = "10 minutes", **kw) -> DataFrame:
    """Alerts of a message stream.

    Columns: session_id, seq, ts, ts_ms, is_human, is_aborted, is_correction,
    tool_calls; records without a time are left out.
    """
    ship_package(messages.sparkSession)
    flag = lambda c, bit: F.when(F.col(c), bit).otherwise(0)
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(SESSION_BUCKETS))
    rows = messages.withWatermark("ts", late).where("ts_ms is not null").select(
        bucket.alias("bucket"), "session_id", "ts", "ts_ms", "seq", F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"),
        (flag("is_human", 1) + flag("is_aborted", 2) + flag("is_correction", 4)).alias("flags"))
    return rows.groupBy("bucket").applyInPandasWithState(long_request_alerts(**kw), ALERT, OPEN, "append", "EventTimeTimeout")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and read the result.

    Output and stream state live in the shared checkpoint folder.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start(f"{folder}/out")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
