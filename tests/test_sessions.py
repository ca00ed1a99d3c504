"""Time split, pairing and dialect rules on small logs."""

import json
import random

import pytest
from builders import T0, answer, call, human, iso, lines, record, result, session, start

from pyspark.sql import functions as F
from worktrail.functions import waits
from worktrail.functions.numeric import exact_sum
from worktrail.operators import activity, pairing, timesplit, trends, turns
from worktrail.session import WHOLE_STAGE
from worktrail.sources import dialect_a, dialect_b

SEC = 1000


def split(spark, records):
    t = dialect_a.normalise(lines(spark, records))
    results = t.messages.where("role = 'toolResult'")
    timed = timesplit.tool_intervals(t.tool_starts, results, t.tool_calls)
    return t, timed, timesplit.effective_calls(timed, timesplit.job_intervals(t.async_jobs, timed, t.tool_calls))


def test_background_call_counts_once(spark):
    records = [
        session("s1", T0), human("h", T0, "go"),
        answer("a", T0 + SEC, call("c1", "bash", command="npm test"), call("c2", "task", tasks=[{"name": "T1", "agent": "reviewer"}])),
        start("x", T0 + SEC, "c1", "bash"),
        result("y", T0 + 3 * SEC, "c1", "bash", "Backgrounded as job bg_1"),
        result("z", T0 + 9 * SEC, "c1", "bash", "done"),
        record("j", T0 + 20 * SEC, "custom_message", customType="async-result", details={"jobs": [
            {"jobId": "bg_1", "type": "bash", "durationMs": 2000, "label": "x"}, {"jobId": "T1", "type": "task", "durationMs": 4000, "label": ""}]}),
    ]
    _, timed, calls = split(spark, records)
    assert [(r.started_ms - T0, r.ts_ms - T0) for r in timed.collect()] == [(1000, 9000)]
    got = sorted((r.bucket, r.background, r.start_ms - T0, r.end_ms - T0) for r in calls.collect())
    # The call was closed before the job report, so the report adds a span of its own.
    assert got == [("review", True, 16000, 20000), ("tools", False, 1000, 9000), ("tools", True, 18000, 20000)]


def test_job_replaces_open_call(spark):
    records = [
        human("h", T0, "go"), answer("a", T0 + SEC, call("c1", "bash", command="glab ci status")), start("x", T0 + SEC, "c1", "bash"),
        result("y", T0 + 3 * SEC, "c1", "bash", "Backgrounded as job bg_1"),
        record("j", T0 + 50 * SEC, "custom_message", customType="async-result", details={"jobs": [{"jobId": "bg_1", "type": "bash", "durationMs": 49000, "label": ""}]}),
        result("z", T0 + 60 * SEC, "c1", "bash", "late"),
    ]
    _, _, calls = split(spark, records)
    rows = [(r.bucket, r.background, r.busy_sec) for r in calls.collect()]
    assert ("ci", True, 49.0) in rows


def test_malformed_usage_reads_as_zero(spark):
    bad = [None, {}, {"input": "10", "cost": None}, {"input": 5, "cost": {"total": "1"}}]
    records = [record(f"r{i}", T0, "message", message={"role": "assistant", "usage": u, "content": "x"}) for i, u in enumerate(bad)]
    rows = dialect_a.normalise(lines(spark, records)).messages.orderBy("seq").collect()
    assert [(r.input, r.cost) for r in rows] == [(0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (5.0, 0.0)]


def test_text_starting_with_bracket(spark):
    t = dialect_a.normalise(lines(spark, [human("a", T0, '[{"type":"text"}] is my text'), human("b", T0, "  \n"), human("c", T0, "x", attribution="agent")]))
    assert [(r.text.startswith("[{"), r.is_human) for r in t.messages.orderBy("seq").collect()] == [(True, True), (False, False), (False, False)]


def test_lists_and_texts_that_look_like_lists(spark):
    # An escaped bracket starts a text as well; a list may hold a text that starts with one.
    records = [
        '{"type":"message","message":{"role":"user","content":"\\u005b{\\"type\\":\\"text\\",\\"text\\":\\"no\\"}]"}}',
        '{"type":"message","message":{"role":"user","content":[{"type":"text","text":"[yes"}]}}',
        '{"type":"message","message":{"role":"user","content":[{"type":"text","text":"yes"}]}}',
        '{"type":"message","message":{"role":"user","content":[]}}', '{"type":"message","message":{"role":"user"}}',
    ]
    rows = spark.createDataFrame([("b", i, r) for i, r in enumerate(records)], "session_id string, seq bigint, line string")
    flat = rows.withColumn("line", F.replace("line", F.lit('"type":"message"'), F.lit('"type":"user"')))
    want = ['[{"type":"text","text":"no"}]', "[yes", "yes", "", ""]
    assert [r.text for r in dialect_b.normalise(flat).messages.orderBy("seq").collect()] == want
    own = rows.selectExpr("'a' AS source", "session_id", "'primary' AS kind", "'' AS sidecar_name", "seq", "line")
    assert [r.text for r in dialect_a.normalise(own).messages.orderBy("seq").collect()] == want


def test_wide_rows_are_written_by_operator_and_the_setting_comes_back(spark, monkeypatch):
    seen = []
    write = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda w, path: (seen.append(spark.conf.get(WHOLE_STAGE)), write(w, path))[1])
    dialect_a.normalise(lines(spark, [human("a", T0, "x")]))
    dialect_b.log_tables(spark.createDataFrame([("b", 0, "{}")], "session_id string, seq bigint, line string"))
    assert seen[:2] == ["false", "false"] and spark.conf.get(WHOLE_STAGE) == "true"


def test_latest_outcome_and_unseen_ids(spark):
    records = [
        answer("a", T0, call("c1", "read", path="x"), call("c9", "eval", code="browser.click()")),
        result("b", T0, "c1", "read", error=True), result("c", T0, "c1", "read"), result("d", T0, "zz", "read", error=True),
        result("e", T0, "", "bash", error=True), result("f", T0, "c9", "eval", "Tool xd_x not found", error=True), result("g", T0, "c9", "eval", "boom", error=True),
    ]
    t = dialect_a.normalise(lines(spark, records))
    calls = t.tool_calls.withColumn("drives_browser", t.tool_calls.code.contains("browser."))
    got = {(r.rate_key, r.outcome, r.category) for r in pairing.call_outcomes(calls, t.messages.where("role = 'toolResult'")).collect()}
    assert got == {("read", "ok", None), ("bash", "error", "Shell Failed"), ("browser", "error", "Browser Failed")}


@pytest.mark.parametrize("seed", range(4))
def test_partition_against_cells(spark, seed):
    rnd = random.Random(seed)
    step = 100 * SEC
    order = [("ci", 5), ("review", 4), ("agents", 3), ("tools", 2), ("model", 1), ("you", 0)]
    spans, humans, times = [], [], []
    for sid in ("a", "b", "c"):
        lo, hi = 5, 60
        times += [(sid, lo * step), (sid, hi * step)]
        humans += [(sid, i, lo * step if i == 0 else rnd.randint(lo, hi) * step, f"q{i}") for i in range(3)]
        for _ in range(12):
            s = rnd.randint(0, 60)
            b = rnd.choice(order)[0]
            spans.append((sid, s * step, (s + rnd.randint(0, 7)) * step, b, b not in ("you", "model") and rnd.random() < 0.3))
    iv = spark.createDataFrame(spans, "session_id string, start_ms bigint, end_ms bigint, bucket string, background boolean")
    hm = spark.createDataFrame(humans, "session_id string, seq bigint, ts_ms bigint, text string")
    rg = timesplit.session_ranges(spark.createDataFrame(times, "session_id string, ts_ms bigint"), hm)
    segments = timesplit.time_segments(iv, rg, hm)
    got = {r.session_id: r.asDict() for r in timesplit.session_time(segments, timesplit.gap_pieces(segments)).collect()}
    rank = dict(order)
    for sid in ("a", "b", "c"):
        want, run = dict.fromkeys([b for b, _ in order] + ["idle"], 0), 0

        def close():
            nonlocal run
            want["you"] += min(run * 100, 900)
            want["idle"] += max(run * 100 - 900, 0)
            run = 0

        for cell in range(5, 60):
            over = [(0.5 + rank[b] / 1000 if bg else rank[b], b) for k, s, e, b, bg in spans if k == sid and s <= cell * step and e >= (cell + 1) * step]
            if over:
                close()
                want[max(over)[1]] += 100
            else:
                run += 1
        close()
        assert {k: got[sid][k] for k in want} == want
        assert sum(got[sid][k] for k in want) == 5500


def test_day_never_exceeds_24_hours(spark):
    rnd = random.Random(1)
    runs = [(f"s{i}", s := T0 + rnd.randint(0, 80) * 3_600_000, s + rnd.randint(0, 60) * 3_600_000) for i in range(40)]
    hours = activity.active_hours_by_day(spark.createDataFrame(runs, "session_id string, start_ms bigint, end_ms bigint")).collect()
    assert all(0 < r.hours <= 24 for r in hours)


def test_interleaving_windows(spark):
    def run(gap_min):
        rows = [("a", 1, T0, True), ("b", 1, T0 + 60_000, True), ("a", 2, T0 + gap_min * 60_000, True)]
        df = spark.createDataFrame(rows, "session_id string, seq bigint, ts_ms bigint, is_human boolean")
        return activity.interleavings(df).count()

    assert (run(30), run(31)) == (1, 0)


def flat(spark, records):
    return spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(records)], "session_id string, seq bigint, line string")


def test_flat_dialect(spark):
    say = lambda kind, ms, content, **kw: {"type": kind, "sessionId": "s", "cwd": "/b", "timestamp": iso(ms), "message": {"role": kind, "content": content, **kw.pop("m", {})}, **kw}
    use = {"usage": {"input_tokens": 10, "output_tokens": 1}}
    records = [
        say("user", T0, "do it"), say("assistant", T0 + 2000, [{"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "npm test"}}], requestId="q", m=use),
        say("assistant", T0 + 2500, "same", requestId="q", m=use), say("user", T0 + 9000, [{"type": "tool_result", "tool_use_id": "t", "is_error": True}]),
        say("user", T0 + 9500, "side", isSidechain=True), say("user", T0 + 9600, "note", isMeta=True), say("assistant", T0 + 11000, "done", m=use),
        {"type": "cost-state", "sessionId": "s", "totalCostUSD": 1.0}, {"type": "cost-state", "sessionId": "s", "totalCostUSD": 2.5, "totalLinesAdded": 7},
    ]
    t = dialect_b.normalise(flat(spark, records))
    assert t.messages.where("is_human").count() == 1
    u = dialect_b.session_usage(t.messages, t.cost_states).collect()[0]
    assert (u.input, u.cost, u.cost_recorded, u.state_lines_added) == (20.0, 2.5, True, 7.0)
    model = sorted((r.start_ms - T0, r.end_ms - T0) for r in dialect_b.model_intervals(t.messages).collect())
    assert model == [(0, 2000), (0, 2500), (9000, 11000)]
    tool = timesplit.flat_call_intervals(t.tool_calls, t.tool_results).collect()
    assert [(r.bucket, r.family, r.busy_sec) for r in tool] == [("tools", "npm test", 7.0)]


def test_transition_walks_back(spark):
    rows = [("c", f"s{i:02d}", T0 + i * 86_400_000, 1.0 if i < 25 else 3.0, 0.0, "old" if i < 25 else "new") for i in range(50)]
    df = spark.createDataFrame(rows, "corpus string, session_id string, start_ms bigint, cost double, errors double, model string")
    move = trends.transitions(df, ["corpus"]).collect()[0]
    assert (move.pos, move.before_model, move.after_model) == (26, "old", "new")
    delta = trends.deltas(df, ["corpus"]).collect()[0]
    assert (delta.basis, delta.before_n, delta.after_n, delta.cost_pct, delta.insufficient) == ("model_switch", 20, 20, 200.0, False)
    assert trends.trajectory(df, ["corpus"]).collect()[0].cost_trend == "increasing"
    short = df.where("session_id < 's30'")
    assert trends.trajectory(short, ["corpus"]).collect()[0].cost_trend == "insufficient"


def test_many_tiny_costs_add_up(spark):
    rows = spark.range(1_000_000).select(F.lit(1e-7).alias("cost"))
    assert rows.agg(exact_sum(F.col("cost")).alias("s")).first().s == pytest.approx(0.1)
    assert spark.range(3).select(F.lit(1e15).alias("cost")).agg(exact_sum(F.col("cost")).alias("s")).first().s == 3e15


def test_first_call_says_whether_a_browser_is_driven(spark):
    calls = spark.createDataFrame([("s", "c", 1, 0, False), ("s", "c", 5, 0, True)], "session_id string, call_id string, seq long, idx int, drives_browser boolean")
    results = spark.createDataFrame([("s", "c", 9, "eval", False, "")], "session_id string, call_id string, seq long, tool string, is_error boolean, text string")
    assert [r.rate_key for r in pairing.call_outcomes(calls, results).collect()] == ["eval"]


def test_all_aborts_are_kept_and_ten_shown(spark):
    records = [session("s1", T0), human("h", T0, "go"), *[answer(f"a{i}", T0 + i, stopReason="aborted") for i in range(15)]]
    t = dialect_a.normalise(lines(spark, records))
    events = turns.abort_events(t.messages, t.tool_calls)
    assert (events.count(), turns.first_aborts(events).count()) == (15, 10)


def test_async_submit_elsewhere_does_not_hide_a_blocking_one(spark):
    text = "gcloud builds submit . && sleep 1 " + "x" * 80 + "; gcloud builds submit --async ."
    row = spark.createDataFrame([(text,), ("gcloud builds submit --async .",)], "t string").select(waits.waits_for(F.col("t"))["kind"].alias("k")).collect()
    assert [r.k for r in row] == ["ci", None]
