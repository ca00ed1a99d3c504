"""Text rules: waits, families, labels, budgets."""

import pytest
from pyspark.sql import functions as F

from worktrail.functions import text, waits
from worktrail.functions.labels import LABELS
from worktrail.operators.facts import quoted_figures, unbacked_figures
from worktrail.operators import filters, labels, timerollup
from worktrail.operators.labels import normalise_keys
from worktrail.operators.tools import language_of

CASES = [
    ("bash", "glab ci status", "ci", "polling: ci"),
    ("bash", "gh pr checks 12 --watch", "ci", "polling: ci"),
    ("bash", "kubectl apply -f x.yml", None, "kubectl apply"),
    ("bash", "helm upgrade app ./c --wait", "ci", "polling: ci"),
    ("bash", "helm upgrade app ./c", None, "helm upgrade"),
    ("bash", "gcloud builds submit .", "ci", "polling: ci"),
    ("bash", "gcloud builds submit . --async", None, "gcloud builds"),
    ("bash", "az pipelines runs show --id 4", "ci", "polling: ci"),
    ("bash", "curl -s https://j/job/app/lastBuild/api/json", "ci", "polling: ci"),
    ("bash", "echo the pipeline variable is set", None, "echo the"),
    ("bash", "while true; do sleep 9; orca worker list; done", "agents", "polling: orca"),
    ("bash", "until curl -s localhost; do sleep 2; done", "polling", "polling: generic"),
    ("bash", "orca terminal wait t1 # review", "review", "polling: review"),
    ("bash", "for f in *.py; do ruff check $f; done", None, "ruff check"),
    ("bash", "cd /repo && set -e; A=1 B=2 npx vitest run", None, "vitest run"),
    ("bash", "pnpm exec tsc --noEmit", None, "tsc"),
    ("bash", "", None, "bash"),
    ("eval", "poll2(action='deploy to prod')", "ci", "polling: ci"),
    ("eval", "poll2(label='MR verdict')", "review", "polling: review"),
    ("eval", "poll2(x)", "polling", "polling: generic"),
    ("eval", "await browser.open('x')", None, "eval: browser"),
    ("eval", "subprocess.run('git push origin x')", None, "git push"),
    ("eval", "import json\nprint(1)", None, "eval: python"),
    ("eval", "let a = 1", None, "eval: js"),
    ("vibe_wait", "", "agents", "vibe_wait"),
    ("read", "glab ci status", None, "read"),
    ("", "", None, "unknown"),
]


def test_waits_and_families(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, tool string, text string, kind string, family string")
    got = df.select(
        "i", waits.wait_kind(F.col("tool"), F.col("text")).alias("k"),
        waits.command_family(F.col("tool"), F.col("text"), F.lit(None).cast("string")).alias("f"), "kind", "family",
    ).orderBy("i").collect()
    assert [(CASES[r.i][1], r.k, r.f) for r in got] == [(CASES[r.i][1], r.kind, r.family) for r in got]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_review_words(spark):
    assert column(spark, ["ModelPreview", "ReviewMR188", "auto_approve", "reviewed!", "interview"], text.names_review) == [False, True, True, True, False]


@pytest.mark.parametrize("name,heavy", [("a/x-opus-5", True), ("o3-mini", False), ("gpt-5-pro", True), ("gpt-5-pro-mini", False), ("promax", False), ("grok-4-heavy", True), ("mistral-large", True)])
def test_heavy_models(spark, name, heavy):
    assert column(spark, [name], waits.is_heavy_model) == [heavy]


def test_corrections(spark):
    said = ["No, stop", "I don't know", "Please don't do it", "don't worry, do it again", "no problem", "Nein!", "note this", "Fine. Do not push", "Plannotator Inbox: stop", ""]
    assert column(spark, said, text.is_correction) == [True, False, True, False, False, True, False, True, False, False]


def test_budgets(spark):
    long = "It cost $18.51 in all. Then more words came here! The end of it all is far away"
    assert column(spark, [long, "one two", "a b c d e f g h i j k l"], lambda c: text.fit_words(c, 10)) == ["It cost $18.51 in all. Then more words came here!", "one two", "a b c d e f g h i j…"]
    assert column(spark, [long], lambda c: text.fit_words(c, 3, False)) == ["It cost $18.51"]


def test_slugs_and_labels(spark):
    assert column(spark, ["/a/Shop API", "/a/repo/.worktrees/fix-1/src", "/a/repo/.orca/worktrees/T2", "", None, "/"], text.project_slug) == ["shop-api", "repo-fix-1", "repo-t2", "unknown", "unknown", "unknown"]
    assert column(spark, ["fix_bug", "warmup_minimal", "slow_or_verbose", "my_own"], lambda c: text.display_label(c, LABELS)) == ["Fix Bug", "Cache Warmup", "Slow / Verbose", "My Own"]
    assert column(spark, ["/a/b.TSX", "/a/.env", "Makefile", "x.tar.md"], language_of) == ["TypeScript", None, None, "Markdown"]


def test_friction_keys(spark):
    counts = [("s", "Tool Failures", 2.0), ("s", "tool_failure", 1.0), ("s", "approach wrong", 3.0), ("s", "issue_resolved", 9.0), ("s", "investigation_unresolved", 1.0), ("s", "abandoned", 0.0), ("s", "--", 5.0)]
    got = normalise_keys(spark.createDataFrame(counts, "sid string, key string, n double"), ["sid"]).collect()
    assert {r.key: r.n for r in got} == {"tool_failure": 3.0, "wrong_approach": 3.0, "investigation_unresolved": 1.0}


def test_fact_check(spark):
    prose = spark.createDataFrame([(1, "Success hit 40-61% while cost fell 43%, i.e. $1.2k or $124 of $9,000.50. Only 7 runs.")], "doc int, text string")
    facts = spark.createDataFrame([("pct", -43.4), ("pct", 60.5), ("usd", 1240.0), ("usd", 123.45), ("count", 7.0)], "unit string, value double")
    quotes = quoted_figures(prose, ["doc"])
    assert sorted((r.unit, r.value) for r in quotes.collect()) == [("pct", 40.0), ("pct", 43.0), ("pct", 61.0), ("usd", 124.0), ("usd", 1200.0), ("usd", 9000.5)]
    bad = {(r.unit, r.value): r.excerpt for r in unbacked_figures(quotes, facts).collect()}
    assert set(bad) == {("pct", 40.0), ("usd", 9000.5)}
    assert "$9,000.50" in bad[("usd", 9000.5)] and "40-61%" in bad[("pct", 40.0)]


def test_report_fields_fit_their_budgets(spark):
    long = " ".join(f"w{i}" for i in range(80)) + "."
    rows = [("what_works", "impressive_workflows", "description", long), ("suggestions", "stop_doing", "title", long), ("interaction_style", None, "key_pattern", "short one"), ("other", None, "x", long)]
    got = text.fit_report_fields(spark.createDataFrame(rows, "section string, list string, field string, text string")).collect()
    assert [len(r.text.split()) for r in got] == [40, 10, 2, 80]


def test_names_meet_their_own_corpus_only(spark):
    candidates = spark.createDataFrame([("a", "deploy checker"), ("b", "deploy checker")], "team string, name string")
    names = spark.createDataFrame([("a", "deploy-checker")], "team string, existing string")
    assert [tuple(r) for r in filters.drop_near_duplicates(candidates, names, by=["team"]).collect()] == [("b", "deploy checker")]


def test_instructions_in_start_order(spark):
    facets = spark.createDataFrame([("u", "s2", 2, "", "", ["c"]), ("u", "s1", 1, "", "", ["a", "b"])], "user string, session_id string, start_ms long, brief_summary string, friction_detail string, instructions array<string>")
    assert [r.entry for r in labels.narrative_lists(facets, ["user"]).orderBy("entry").collect()] == ["a", "b", "c"]


def test_slowest_request_comes_last(spark):
    found = spark.createDataFrame([("u", "review_waits", None, 5.0, 0.2), ("u", "waiting_on_you", None, 9.0, 0.4)], "user string, lever string, subject string, seconds double, share double")
    slow = spark.createDataFrame([("u", "s1", 99.0, "model", 1), ("u", "s2", 9.0, "model", 2)], "user string, session_id string, active_sec double, dominant string, rank int")
    got = timerollup.ranked_levers(found, slow, ["user"]).orderBy("place").collect()
    assert [(r.lever, r.subject) for r in got] == [("waiting_on_you", None), ("review_waits", None), ("slowest_requests", "s1")]
