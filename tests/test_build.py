"""Log folders to session and corpus tables."""

import pytest
from builders import T0, answer, call, human, iso, result, session, start, write

from worktrail.operators.usage import provider_basis
from worktrail.plans import build, publish, refresh, store
from worktrail.sources import logs

MIN = 60_000


def parent_records():
    return [
        session("p1", T0),
        human("r1", T0 + MIN, "fix the parser"),
        answer("r2", T0 + 2 * MIN, call("c1", "read", path="/src/a.py"), call("c2", "edit", input="[/src/a.py#0A1b]\nPUT 3.=5\n+x\n-y"), cost=1.0, ttft=500, duration=1500),
        start("r3", T0 + 2 * MIN, "c1", "read"),
        result("r4", T0 + 2 * MIN + 4000, "c1", "read"),
        result("r5", T0 + 2 * MIN + 5000, "c2", "edit", "failed", error=True),
        human("r6", T0 + 30 * MIN, "no, that is wrong"),
        answer("r7", T0 + 31 * MIN, {"type": "text", "text": "sorry"}, cost=2.0, stopReason="aborted"),
    ]


@pytest.fixture(scope="module")
def corpus_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    write(root / "shop" / "2024_p1.jsonl", parent_records(), tail='{"type":"message","id":"cut')
    write(root / "shop" / "2024_p1" / "__advisor.jsonl", [answer("a1", T0, cost=0.25)])
    write(root / "shop" / "2024_p1" / "x" / "x.Sub.jsonl", [answer("b1", T0, call("z", "bash", command="ls"), cost=0.5)])
    (root / "shop" / "2024_p1" / "7.bash.log").write_text("spill")
    # A fork copies the parent's records and its sidecar, then goes on.
    fork = [session("f1", T0 + 40 * MIN, parent=str(root / "shop" / "2024_p1.jsonl")), *parent_records()[1:],
            human("n1", T0 + 41 * MIN, "go on"), human("n2", T0 + 50 * MIN, "and again"), answer("n3", T0 + 51 * MIN, cost=4.0)]
    write(root / "shop" / "2024_f1.jsonl", fork)
    write(root / "shop" / "2024_f1" / "x" / "x.Sub.jsonl", [answer("b1", T0, cost=0.5), answer("b2", T0, cost=0.125)])
    # The smaller copy under another project and a loose file do not count.
    write(root / "old" / "2024_p1.jsonl", parent_records()[:2])
    write(root / "loose.jsonl", parent_records()[:2])
    return str(root)


@pytest.fixture(scope="module")
def built(spark, corpus_dir):
    files, tables = build.build_tables(spark, corpus_dir)
    return files, tables, build.session_tables(files, tables)


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_files(built):
    files, _, _ = built
    got = rows(files, "session_id")
    assert set(got) == {("p1",), ("f1",)}
    assert got[("p1",)].path.endswith("/shop/2024_p1.jsonl")
    assert (got[("p1",)].advisor_logs, got[("p1",)].subagent_logs) == (1, 1)
    assert got[("p1",)].signature.count("|") == 2


def test_missing_root(spark, tmp_path):
    assert logs.list_files(spark, str(tmp_path / "none")).count() == 0


def test_sessions_without_fork_copies(built):
    got = rows(built[2]["sessions"], "session_id")
    p, f = got[("p1",)], got[("f1",)]
    assert (p.cost_primary, p.cost_advisor, p.cost_subagent, p.total_cost) == (3.0, 0.25, 0.5, 3.75)
    assert (f.cost_primary, f.cost_subagent, f.total_cost) == (4.0, 0.125, 4.125)
    assert (p.user_message_count, p.duration_minutes, p.tool_errors) == (2, 31, 1)
    assert (p.lines_added, p.lines_removed, p.files_modified) == (1, 4, 1)
    assert (p.aborted_generations, p.aborted_at_session_end, p.first_prompt) == (1, 1, "fix the parser")
    assert f.user_message_count == 2


def test_total_is_sum_of_classes(built):
    for r in built[2]["sessions"].collect():
        assert r.total_cost == pytest.approx(r.cost_primary + r.cost_advisor + r.cost_subagent)


def test_reconciles(built):
    _, tables, parts = built
    assert all(r.matches for r in refresh.reconcile(tables.usage_events, parts["sessions"]).collect())


def test_turns_and_time(built):
    turn = rows(built[2]["turns"], "session_id", "turn_no")[("p1", 1)]
    assert (turn.round_trips, turn.tool_calls, turn.exploration, turn.mutated) == (1, 2, 1, True)
    time = rows(built[2]["session_time"], "session_id")[("p1",)]
    # Two seconds of model time end where the four of the read call begin.
    assert (time.model, time.tools) == (2.0, 4.0)
    assert time.active_sec + time.idle == 30 * 60


def test_corpus_tables(spark, built):
    basis = provider_basis(spark.createDataFrame([("north", "api_key", 1)], "provider string, credential_type string, row_no int"))
    out = build.corpus_tables(built[2], basis, now_ms=T0 + 100 * MIN)
    assert out["totals"].collect()[0].sessions == 2
    assert out["billed"].collect()[0].billed_cost == pytest.approx(7.875)
    scan = out["scan"].first()
    assert (scan.primary_logs, scan.duplicate_logs, scan.advisor_logs, scan.subagent_logs, scan.excluded_meta, scan.included) == (2, 1, 1, 2, 0, 2)
    ids = {r.fact_id for r in out["facts"].collect()}
    assert {"total_cost", "model_cost.m-1", "time.share.model", "active_hours"} <= ids
    assert any(i.startswith("worst_turn.") for i in ids)
    for name, df in out.items():
        df.count(), name


def test_sidecars_fold_into_the_session(spark, tmp_path):
    """Calls, failed results and active seconds of every sidecar; overlaps inside one count once."""
    sec = 1000
    side = [
        answer("a1", T0 + 10 * sec, call("c1", "bash", command="make"), ttft=2000, duration=3000),
        start("a2", T0 + 10 * sec, "c1", "bash"),
        answer("a3", T0 + 14 * sec, call("c2", "read", path="/a"), duration=2000),
        result("a4", T0 + 20 * sec, "c1", "bash", "no", error=True),
        result("a5", T0 + 21 * sec, "c2", "read", "gone", error=True),
    ]
    write(tmp_path / "p" / "2024_s.jsonl", [session("s", T0), human("h", T0, "go"), answer("b", T0 + sec, cost=1.0)])
    write(tmp_path / "p" / "2024_s" / "x.jsonl", side)
    write(tmp_path / "p" / "2024_s" / "__advisor.jsonl", [answer("d1", T0 + 5 * sec, duration=5000, cost=2.0), answer("d2", T0 + 7 * sec, duration=1000)])
    parts = build.session_tables(*build.build_tables(spark, str(tmp_path)))
    row = parts["sessions"].first()
    assert (row.sidecar_tool_calls, row.sidecar_tool_errors, row.cost_advisor) == (2, 2, 2.0)
    # The subagent: model from second 5 to 10, then the command to 20, then a second of waiting;
    # without a human message the range starts at the first record, which is at 10. The advisor:
    # from its record at 5 to 7, the last of them model, the rest a gap.
    assert parts["subagent_busy"].first().busy_sec == 11 + 2


def b_record(kind, ms, content=None, **fields):
    out = {"type": kind, "sessionId": "b1", "cwd": "/home/b/app", "timestamp": iso(ms), **{k: v for k, v in fields.items() if k not in ("usage", "model")}}
    if content is not None:
        out["message"] = {"role": kind, "model": fields.get("model", "big-1"), "usage": fields.get("usage"), "content": content}
    return out


def b_call(call_id, name, **arguments):
    return {"type": "tool_use", "id": call_id, "name": name, "input": arguments}


@pytest.fixture(scope="module")
def flat_built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("flat")
    use = {"input_tokens": 7, "output_tokens": 3, "cache_read_input_tokens": 2, "cache_creation_input_tokens": 1}
    done = lambda i, ms, **k: b_record("user", ms, [{"type": "tool_result", "tool_use_id": i, **k}])
    records = [
        b_record("user", T0, "please build"),
        b_record("assistant", T0 + 10_000, [b_call("c1", "Bash", command="git commit -m x && git push")], requestId="q1", usage=use),
        b_record("assistant", T0 + 10_000, [b_call("c1", "Bash", command="git commit -m x && git push")], requestId="q1", usage=use),
        done("c1", T0 + 16_000),
        b_record("assistant", T0 + 18_000, [b_call("c2", "Edit", file_path="/x/a.py", old_string="a", new_string="b\nc"), b_call("c3", "Write", file_path="/x/b.ts", content="1\n2\n3")], requestId="q2", usage=use),
        done("c2", T0 + 19_000, is_error=True), done("c3", T0 + 20_000),
        b_record("user", T0 + 21_000, "side prompt", isSidechain=True), b_record("user", T0 + 22_000, "notice", isMeta=True),
        b_record("user", T0 + 40 * MIN, "and now?"), b_record("assistant", T0 + 40 * MIN + 5000, [{"type": "text", "text": "done"}], requestId="q3", usage=use),
        b_record("cost-state", T0 + 41 * MIN, totalCostUSD=9.0),
        b_record("cost-state", T0 + 42 * MIN, totalCostUSD=1.5, totalLinesAdded=40, modelUsage={"big-1": {"inputTokens": 100, "outputTokens": 10, "costUSD": 1.25}}),
    ]
    write(root / "app" / "b1.jsonl", records)
    free = [{**r, "sessionId": "b2"} for r in records[:-2]]
    write(root / "app" / "b2.jsonl", free)
    dialect = build.DialectB()
    files, tables = build.build_tables(spark, str(root), dialect)
    return build.session_tables(files, tables, dialect)


def test_flat_sessions(flat_built):
    got = rows(flat_built["sessions"], "session_id")
    b1, b2 = got[("b1",)], got[("b2",)]
    # The last cost record supersedes; without one the cost is not recorded.
    assert (b1.total_cost, b1.input_tokens, b1.output_tokens, b1.cost_unavailable) == (1.5, 100, 10, False)
    assert (b2.total_cost, b2.input_tokens, b2.cache_read_tokens, b2.cost_unavailable) == (0, 21, 6, True)
    assert (b1.lines_added, b2.lines_added, b1.lines_removed, b1.files_modified) == (40, 5, 1, 2)
    assert (b1.git_commits, b1.git_pushes, b1.tool_errors, b1.user_message_count) == (1, 1, 1, 2)
    assert b1.uses_subagent and not b1.uses_mcp and b1.project_path == "/home/b/app" and b1.first_prompt == "please build"


def test_flat_tools_and_time(flat_built):
    assert {(r.tool, r.n) for r in flat_built["tool_counts"].where("session_id = 'b1'").collect()} == {("Bash", 1), ("Edit", 1), ("Write", 1)}
    assert len(rows(flat_built["languages"].where("session_id = 'b1'"), "language")) == 2
    busy = {r.tool: r.busy_sec for r in flat_built["busy_by_tool"].where("session_id = 'b1'").collect()}
    assert busy == {"Bash": 6.0, "Edit": 1.0, "Write": 2.0}
    assert {r.model: r.cost for r in flat_built["usage_events"].where("session_id = 'b1'").collect()} == {"big-1": 1.25, "unknown": 0.25}
    time = rows(flat_built["session_time"], "session_id")[("b1",)]
    assert (time.model, time.tools) == (10.0 + 2.0 + 5.0, 6.0 + 2.0)
    slow = rows(flat_built["requests"].where("session_id = 'b1'"), "rank")[(1,)]
    assert (slow.prompt, slow.dominant, slow.wall_sec) == ("please build", "idle", 2400.0)


def test_flat_report(spark, flat_built):
    basis = provider_basis(spark.createDataFrame([("north", "api_key", 1)], "provider string, credential_type string, row_no int"))
    out = build.corpus_tables(flat_built, basis, now_ms=T0 + 100 * MIN)
    assert (out["totals"].first().sessions, out["scan"].first().cost_unavailable) == (2, 1)


def test_two_users_do_not_mix(spark, built):
    """Each user's report is the one made of that user's sessions alone."""
    basis = provider_basis(spark.createDataFrame([("north", "api_key", 1)], "provider string, credential_type string, row_no int"))
    owners = spark.createDataFrame([("p1", "ann"), ("f1", "bob")], "session_id string, user string")
    facets = spark.createDataFrame([("p1", "done", "fully_achieved", "single_task", "x"), ("f1", "half", "not_achieved", "multi_task", "")],
                                   "session_id string, brief_summary string, outcome string, session_type string, friction_detail string")
    counts = spark.createDataFrame([("p1", "friction", "wrong_approach", 2), ("p1", "goal", "fix", 1), ("f1", "goal", "warmup_minimal", 1)], "session_id string, dim string, key string, n int")
    prose = spark.createDataFrame([("ann", "a.b", "cost was $3.75 and 77% of it went on"), ("bob", "a", "100% done")], "user string, path string, text string")
    out = build.corpus_tables(built[2], basis, facets, by=["user"], owners=owners, facet_counts=counts, prose=prose, now_ms=T0 + 100 * MIN)
    total = {r.user: (r.sessions, r.total_cost) for r in out["totals"].collect()}
    # Bob's only session has the warm-up as its one goal.
    assert total == {"ann": (1, 3.75)}
    scan = {r.user: r for r in out["scan"].collect()}
    assert (scan["ann"].included, scan["bob"].included, scan["bob"].excluded_warmup, scan["bob"].excluded_current) == (1, 0, 1, 0)
    assert all(r.elsewhere == 0 for r in out["time_rollup"].groupBy("user").pivot("bucket").sum("seconds").collect())
    assert {(r.user, r.dim, r.key) for r in out["label_shares"].collect()} == {("ann", "friction", "wrong_approach"), ("ann", "goal", "fix"), ("ann", "session_type", "single_task")}
    assert [(r.user, r.value) for r in out["fact_flags"].collect() if r.user == "ann"] == [("ann", 77.0)]
    assert {r.window for r in out["facts"].collect()} == {"2024-06-01..2024-06-01"}
    assert {"success_rate", "tool_error_rate", "billed_cost", "time.active_sec"} <= {r.fact_id for r in out["facts"].collect()}
    for name, df in out.items():
        assert "user" in df.columns, name
        df.count()


def test_own_reports_and_bad_ids_leave(spark, tmp_path):
    marker = build.filters.SELF_GENERATED_MARKERS[0]
    write(tmp_path / "p" / "2024_own.jsonl", [session("own", T0), human("a", T0, f"x {marker}"), answer("b", T0 + 1, cost=9.0)])
    write(tmp_path / "p" / "2024_ok.jsonl", [session("ok", T0), human("a", T0, "hello"), answer("b", T0 + 1, cost=1.0)])
    (tmp_path / "p" / "2024_empty.jsonl").write_text("cut off {")
    files, tables = build.build_tables(spark, str(tmp_path))
    assert {r.session_id: r.dropped for r in files.collect()} == {"own": "tooling", "ok": None, "empty": "unparsed"}
    assert [r.session_id for r in tables.usage_events.collect()] == ["ok"]


def test_all_edited_files_count(spark, tmp_path):
    calls = [call(f"c{i}", "write", path=f"/f{i}", content="x") for i in range(30)]
    write(tmp_path / "p" / "2024_s.jsonl", [session("s", T0), human("a", T0, "go"), answer("b", T0 + 1, *calls), human("c", T0 + 5 * MIN, "more")])
    parts = build.session_tables(*build.build_tables(spark, str(tmp_path)))
    assert parts["session_files"].count() == 30
