"""Incremental builds, published versions and labels from files."""

import json
import os
import shutil

import pytest
from builders import T0, answer, call, human, session, write
from pyspark.sql import functions as F

from worktrail.operators import usage
from worktrail.plans import build, publish, store
from worktrail.sources import facets, logs

MIN = 60_000


def log(sid, texts, cost=1.0, parent=None):
    records = [session(sid, T0, parent=parent)]
    for i, text in enumerate(texts):
        records += [human(f"{text}-h", T0 + i * MIN, text), answer(f"{text}-a", T0 + i * MIN + 5000, call(f"{text}-c", "read", path="/a.py"), cost=cost, duration=2000)]
    return records


def put(root, sid, records, at):
    path = root / "p" / f"2024_{sid}.jsonl"
    write(path, records)
    os.utime(path, (at, at))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "logs"
    put(root, "a", log("a", ["one", "two"]), 1000)
    put(root, "b", log("b", ["one", "two", "three"], parent="a"), 1000)
    put(root, "c", log("c", ["one", "three", "four"], parent="b"), 1000)
    put(root, "lone", log("lone", ["five", "six"]), 1000)
    write(root / "p" / "2024_lone" / "__advisor.jsonl", [answer("x", T0, cost=3.0)])
    os.utime(root / "p" / "2024_lone" / "__advisor.jsonl", (1000, 1000))
    return root


def contents(parts):
    return {n: sorted((json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.select(sorted(df.columns)).collect())) for n, df in parts.items() if n != "files"}


def light(files, tables, dialect):
    """Few tables, quickly built: what each session cost, said and called."""
    return {
        "sessions": usage.fold_sidecars(tables.usage_events), "messages": tables.messages.select("session_id", "sidecar_name", "seq", "text", "is_human"),
        "calls": tables.tool_calls.select("session_id", "sidecar_name", "call_id"), "files": files,
    }


def same_as_full_build(spark, tree, version, tables_of_sessions=light):
    full = tables_of_sessions(*build.build_tables(spark, str(tree)), build.DialectA())
    got, want = contents(version.parts), contents(full)
    for name in want:
        assert got[name] == want[name], name


def test_refresh_reads_only_what_changed(spark, tree, tmp_path, monkeypatch):
    place = str(tmp_path / "store")
    first = store.refresh(spark, str(tree), place, tables_of_sessions=light)
    assert (first.number, first.logs_read, first.sessions_built) == (1, 5, 4)
    same_as_full_build(spark, tree, first)

    # Same size and time, other bytes: an opened log would show.
    lone = tree / "p" / "2024_lone.jsonl"
    kept = lone.read_text()
    lone.write_text("x" * len(kept))
    os.utime(lone, (1000, 1000))
    again = store.refresh(spark, str(tree), place, tables_of_sessions=light)
    assert (again.number, again.logs_read) == (1, 0)
    lone.write_text(kept)
    os.utime(lone, (1000, 1000))

    # The root of the forks changes, a sidecar grows and a log arrives: these are
    # read, and the whole fork tree is built again.
    put(tree, "a", log("a", ["one", "two", "three"], cost=2.0), 2000)
    write(tree / "p" / "2024_lone" / "x.jsonl", [answer("y", T0, call("k", "bash", command="ls"), cost=0.5)])
    put(tree, "new", log("new", ["seven", "eight"]), 3000)
    second = store.refresh(spark, str(tree), place, tables_of_sessions=light)
    assert (second.number, second.logs_read, second.sessions_built) == (2, 5, 5)
    same_as_full_build(spark, tree, second)

    # A log goes: what its forks had copied counts again. A failed attempt shows nothing of it.
    (tree / "p" / "2024_b.jsonl").unlink()
    with monkeypatch.context() as broken:
        broken.setattr(publish, "mark", lambda *a: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            store.refresh(spark, str(tree), place, tables_of_sessions=light)
    assert store.current(spark, place).number == 2
    third = store.refresh(spark, str(tree), place, tables_of_sessions=light)
    assert (third.number, third.logs_read) == (3, 0)
    same_as_full_build(spark, tree, third)

    before = contents(third.parts)["sessions"]
    packed = store.compact(spark, place)
    for batch in range(1, 4):
        shutil.rmtree(f"{store._records(place)}/batch={batch}", ignore_errors=True)
        shutil.rmtree(f"{store._part(place, 'sessions')}/batch={batch}", ignore_errors=True)
    assert packed.number == 4 and contents(packed.parts)["sessions"] == before


def test_published_reports(spark, tree, tmp_path):
    place, root = str(tmp_path / "store"), str(tmp_path / "report")
    version = store.refresh(spark, str(tree), place)
    same_as_full_build(spark, tree, version, build.session_tables)
    basis = usage.provider_basis(spark.createDataFrame([("north", "api_key", 1)], "provider string, credential_type string, row_no int"))
    report = build.corpus_tables(version.parts, basis, now_ms=T0 + 100 * MIN)
    assert publish.published(spark, root) == {}
    tables = report | build.manifest(version.parts, report, version.owned)
    assert publish.publish(spark, tables, root) == 1
    seen = publish.published(spark, root)
    assert set(seen) == set(tables)
    sessions = {r.session_id: r for r in seen["session_set"].collect()}
    assert set(sessions) == {"a", "lone"} and sessions["lone"].cost_advisor == 3.0
    assert [(r.session_id, r.kind, r.path.split("/")[-1]) for r in seen["session_sidecars"].collect()] == [("lone", "advisor", "__advisor.jsonl")]
    assert seen["totals"].first().total_cost == pytest.approx(sum(r.total_cost for r in sessions.values()))
    # A version that is not marked is not seen.
    os.makedirs(f"{root}/versions/00000002/totals")
    assert publish.versions(spark, root) == [1]
    with pytest.raises(Exception):
        publish.mark(spark, root, 1)


def test_lines_do_not_shuffle(spark, tree):
    _, records = logs.read_corpus(spark, str(tree), "a")
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchScan" in plan


def test_ranges_hidden_names_and_cut_tails(spark, tmp_path):
    """Whatever the width of the ranges, each line is read once, in order."""
    texts = [json.dumps({"type": "message", "n": i, "pad": "é" * (i % 90)}) for i in range(200)]
    path = tmp_path / "p" / "2024_s.jsonl"
    path.parent.mkdir()
    path.write_text("\n".join(["not json", *texts[:100], "", " " + texts[0], *texts[100:]]) + '\n{"cut":', encoding="utf-8")
    side = tmp_path / "p" / "2024_s" / "d" / "__advisor.jsonl"
    side.parent.mkdir(parents=True)
    side.write_text("\r\n".join(texts[:3]))
    (tmp_path / "p" / "2024_s" / "_hidden.jsonl").write_text(texts[5])
    (tmp_path / "p" / "2024_empty.jsonl").write_text("")
    files, owned = logs.find_logs(logs.list_files(spark, str(tmp_path)), str(tmp_path), "a")
    assert {(r.session_id, r.kind, r.sidecar_name) for r in owned.collect()} == {("s", "primary", ""), ("empty", "primary", ""), ("s", "advisor", "d/__advisor"), ("s", "subagent", "_hidden")}
    for width in (97, 1000, 1 << 20):
        rows = logs.read_logs(owned, width=width, open_cost=100).orderBy("sidecar_name", "seq").collect()
        assert [r.line for r in rows if r.kind == "primary"] == texts
        assert [r.line for r in rows if r.kind == "advisor"] == texts[:3]
        assert [r.line for r in rows if r.kind == "subagent"] == [texts[5]]
    data = path.read_bytes()
    assert all(data[r.seq:].decode().startswith(r.line) for r in rows if r.kind == "primary")


def test_facet_files(spark, tmp_path):
    rows = [
        {"session_id": "a", "brief_summary": "x", "outcome": "done", "goal_categories": {"fix": 2}, "friction_counts": {"Wrong Approach": 1, "approach_wrong": 2, "bug_fixed": 3, "none": 0}},
        {"session_id": "b", "brief_summary": "", "outcome": "done"}, {"session_id": "c", "brief_summary": "y", "outcome": 5}, ["a"], "text",
    ]
    (tmp_path / "f.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + '\n\n{"session_id": "d", "brief')
    got = facets.read_facets(spark, str(tmp_path / "f.jsonl"))
    assert {(r.session_id, r.status) for r in got.where("session_id is not null").collect()} >= {("a", "valid"), ("b", "incomplete")}
    assert {r.status: r.n for r in facets.facet_status(got).collect()}["broken"] == 3
    assert {(r.dim, r.key, r.n) for r in facets.facet_counts(got).collect()} == {("goal", "fix", 2.0), ("friction", "wrong_approach", 3.0)}
    assert {r.status: r.n for r in facets.facet_status(got.where(F.lit(False))).collect()} == {"valid": 0, "incomplete": 0, "broken": 0}
