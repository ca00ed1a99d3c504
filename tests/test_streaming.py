"""Streams over several batches: late rows, timers, redelivery."""

import json
import os
import random
import time
from datetime import datetime, timedelta

import builders
import pytest
from pyspark.sql import functions as F

from worktrail.sources import dialect_a, logs
from worktrail.streaming import live

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DAY = datetime(2024, 6, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """Write each batch as one file; read one file per batch, oldest first."""
    def make(schema, *batches):
        folder = tmp_path / "in"
        folder.mkdir()
        for i, rows in enumerate(batches):
            part = tmp_path / f"part{i}"
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
            source = next(part.glob("*.parquet"))
            target = folder / f"{i}.parquet"
            source.rename(target)
            os.utime(target, (time.time() - 1000 + i, time.time() - 1000 + i))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return make


def at(minutes):
    return DAY + timedelta(minutes=minutes)


def test_runs_close_and_late_rows_drop(stream):
    rows = stream("u int, ts timestamp", [(1, at(0)), (1, at(10)), (1, at(120))], [(1, at(125))], [(1, at(130))], [(1, at(5)), (1, at(200))])
    got = live.run_once(live.activity_runs(rows, ["u"])).collect()
    # Minute 5 comes after the watermark passed the first run, which stays as it was.
    assert [(r.run_start, r.run_end, r.records) for r in got if r.run_start == at(0)] == [(at(0), at(10), 2)]
    assert all(r.run_start != at(5) for r in got)


def test_redelivery_within_watermark(stream):
    rows = stream("i int, ts timestamp", [(1, at(0)), (2, at(1))], [(1, at(2)), (3, at(3))])
    assert sorted(r.i for r in live.run_once(live.drop_redelivered(rows, ["i"])).collect()) == [1, 2, 3]


def test_spend_windows(stream):
    rows = stream("ts timestamp, cost double, is_error boolean", [(at(1), 1.0, False), (at(59), 2.0, True), (at(61), 4.0, False)], [(at(300), 1.0, False)])
    got = {r.from_ts: (r.cost, r.calls, r.error_rate) for r in live.run_once(live.rolling_spend(rows, [])).collect()}
    assert got == {at(0): (3.0, 2, 0.5), at(60): (4.0, 1, 0.0)}


def test_long_request_alerts(spark, stream):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "session_id string, seq bigint, ts timestamp, is_human boolean, is_aborted boolean, is_correction boolean, tool_calls int"
    rows = stream(
        schema,
        [("quiet", 1, at(0), True, False, False, 0), ("busy", 1, at(0), True, False, False, 0), ("busy", 2, at(1), False, False, False, 100),
         ("sorry", 1, at(0), True, False, True, 0), ("cut", 1, at(0), True, False, False, 0), ("cut", 2, at(2), False, True, False, 200)],
        [("busy", 3, at(3), False, False, False, 50), ("busy", 4, at(90), False, False, False, 0)],
        [("busy", 5, at(200), True, False, False, 0)],
    )
    got = live.run_once(live.long_requests(rows.withColumn("ts_ms", F.unix_millis("ts")))).collect()
    fired = {r.session_id: r.reason for r in got}
    # Once per request; the aborted answer holds back until the timer.
    assert fired == {"busy": "tool_calls", "sorry": "correction", "quiet": "minutes", "cut": "minutes"}
    assert len(got) == 4


@pytest.mark.parametrize("rows_per_batch", [7, 10_000])
def test_alerts_do_not_depend_on_arrow_batches(spark, stream, rows_per_batch):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "session_id string, seq bigint, ts timestamp, is_human boolean, is_aborted boolean, is_correction boolean, tool_calls int"
    rows = [("s", i, at(i), i % 40 == 0, False, False, 1) for i in range(200)]
    random.Random(1).shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)
    try:
        got = live.run_once(live.long_requests(stream(schema, rows).withColumn("ts_ms", F.unix_millis("ts")))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # Five requests of forty minutes, each due after thirty.
    assert sorted((r.fired_ms - r.start_ms) // 60_000 for r in got) == [30] * 5


def test_alerts_of_many_sessions_run_by_the_bucket(spark, stream, monkeypatch):
    """Sessions share a call and its state; a request started earlier, late rows and timers stay apart per session."""
    monkeypatch.setattr(live, "SESSION_BUCKETS", 3)
    schema = "session_id string, seq bigint, ts timestamp, is_human boolean, is_aborted boolean, is_correction boolean, tool_calls int"
    first = [(f"s{i}", 1, at(i % 5), True, False, False, 0) for i in range(40)]
    # Older than the held request: a correction of s7 that must not count; s8 corrects in time.
    second = [("s7", 0, at(1), True, False, True, 0), ("s8", 2, at(4), False, False, True, 1)]
    rows = stream(schema, first, second, [("z", 1, at(300), True, False, False, 0)], [("z", 2, at(301), False, False, False, 500)])
    query = live.long_requests(rows.withColumn("ts_ms", F.unix_millis("ts")))
    got = {r.session_id: (r.reason, (r.fired_ms - r.start_ms) // 60_000) for r in live.run_once(query).collect()}
    assert got == {f"s{i}": ("correction", 1) if i == 8 else ("minutes", 30) for i in range(40)} | {"z": ("tool_calls", 1)}


def test_latest_delivery_wins(spark, stream):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = "k string, v int, cost double, word string, ts timestamp"
    rows = stream(
        schema, [("a", 1, 1.0, "x", at(0)), ("a", 3, 3.0, "z", at(1)), ("b", 1, 1.5, None, at(0))],
        [("a", 2, 2.0, "y", at(2)), ("b", 1, 9.0, "same", at(3))], [("b", 2, 0.5, "w", at(4)), ("c", 7, 7.0, "c", at(300))], [("a", 1, 4.0, "anew", at(310))],
    )
    latest = live.latest_deliveries(rows, ["k"], "v", ["cost", "word"], ttl=timedelta(minutes=60))
    got = sorted((r.k, r.v, r.cost, r.word, r.replaced) for r in live.written(latest, "update").collect())
    # A late older version and an equal one change nothing, a newer one replaces;
    # five hours on the first key is forgotten, so any version of it is new.
    assert got == [("a", 1, 4.0, "anew", False), ("a", 3, 3.0, "z", False), ("b", 1, 1.5, None, False), ("b", 2, 0.5, "w", True), ("c", 7, 7.0, "c", False)]


def test_logs_that_grow(spark, tmp_path):
    """Each record once, whole tails only, the rows of the batch build."""
    root, place = tmp_path / "logs", str(tmp_path / "state")
    one, two = root / "p" / "2024_s1.jsonl", root / "p" / "2024_s1" / "d" / "__advisor.jsonl"
    records = [builders.human("r1", builders.T0, "hällo"), builders.answer("r2", builders.T0 + 1, builders.call("c", "read", path="/a"), cost=1.0), builders.human("r3", builders.T0 + 2, "more")]
    whole = "".join(json.dumps(r) + "\n" for r in records)
    builders.write(two, [builders.answer("d1", builders.T0, cost=0.5)])
    cut = whole.index("r3") + 5
    one.write_text(whole[:cut])

    def run():
        tables = live.live_tables(live.live_logs(spark, str(root), f"{place}/listings"))
        for name in ("messages", "tool_calls", "usage_events"):
            # One query per table, each with its own listings.
            own = live.live_tables(live.live_logs(spark, str(root), f"{place}/listings-{name}"))[name]
            query = own.writeStream.format("parquet").option("checkpointLocation", f"{place}/check-{name}").trigger(availableNow=True).start(f"{place}/out-{name}")
            query.awaitTermination()
        return {n: spark.read.schema(tables[n].schema).parquet(f"{place}/out-{n}") for n in ("messages", "tool_calls", "usage_events")}

    seen = run()
    assert sorted(r.rec_id for r in seen["messages"].collect()) == ["d1", "r1", "r2"]
    one.write_text(whole)
    builders.write(root / "p" / "2024_s2.jsonl", [builders.human("q1", builders.T0, "other")])
    (root / "p" / "notes.txt").write_text("{}\n")
    seen = run()
    assert run()["messages"].count() == 5
    _, lines = logs.read_corpus(spark, str(root), "a")
    batch = dialect_a.normalise(lines)
    for name, df in seen.items():
        want = getattr(batch, name)
        assert sorted(map(str, df.select(want.columns).collect())) == sorted(map(str, want.collect())), name
