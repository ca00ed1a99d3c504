"""What a shell command or code snippet waits for, and its command family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worktrail.functions.text import let, lookup, matches_any, names_review, trimmed

# Command shapes that wait for a build or a deployment.
CI_WAITS = [
    r"\bglab\s+ci\b|\bgh\s+pr\s+checks\b|\bgh\s+run\s+(?:list|watch|view)\b|\bdeploy\s+status\b|\bvercel\s+inspect\b",
    r"\bglab\b[\s\S]{0,15}\bapi\b[\s\S]{0,60}\b(?:pipelines|jobs)\b",
    r"\bgh\b[\s\S]{0,15}\bapi\b[\s\S]{0,80}\b(?:actions/runs|check-runs|statuses)\b",
    r"\bjenkins-cli(?:\.jar)?\b[\s\S]{0,60}\bbuild\b[\s\S]{0,40}(?:-s\b|-w\b)|\bjava\s+-jar\s+jenkins-cli\.jar\b[\s\S]{0,60}\bbuild\b",
    r"\b(?:curl|wget)\b[\s\S]{0,80}/job/[\s\S]{0,120}\b(?:api/json|lastBuild)\b",
    r"\bcircleci\b[\s\S]{0,15}\b(?:pipeline|workflow)\b|\bcircleci\.com/api/v2/(?:pipeline|workflow)\b",
    r"\bbk\b[\s\S]{0,15}\bbuild\b[\s\S]{0,15}\b(?:view|watch)\b|\bapi\.buildkite\.com/v2/[\s\S]{0,80}/builds\b",
    r"\baz\b[\s\S]{0,15}\bpipelines\b[\s\S]{0,20}\b(?:run\b|runs\s+show\b)|\baz\b[\s\S]{0,15}\bbuild\b[\s\S]{0,15}\bshow\b",
    r"\bkubectl\b[\s\S]{0,15}\brollout\b[\s\S]{0,15}\bstatus\b|\bargocd\b[\s\S]{0,15}\bapp\b[\s\S]{0,15}\bwait\b|\bargocd\b[\s\S]{0,15}\bapp\b[\s\S]{0,15}\bsync\b[\s\S]{0,40}--wait\b|\bhelm\b[\s\S]{0,15}\b(?:upgrade|install)\b[\s\S]{0,80}--wait\b",
    r"\bnetlify\b[\s\S]{0,15}\bwatch\b|\b(?:flyctl|fly)\b[\s\S]{0,15}\bstatus\b[\s\S]{0,15}--watch\b",
    r"\bgcloud\b[\s\S]{0,15}\bbuilds\b[\s\S]{0,15}\bsubmit\b(?![\s\S]{0,60}--async\b)",
    r"\bgcloud\b[\s\S]{0,15}\bbuilds\b[\s\S]{0,15}\blog\b[\s\S]{0,40}--stream\b",
    r"\baws\b[\s\S]{0,15}\bcodebuild\b[\s\S]{0,15}\bbatch-get-builds\b|\baws\b[\s\S]{0,15}\bcodepipeline\b[\s\S]{0,15}\bget-pipeline-state\b",
]
# Marks of waiting for agents and of polling.
AGENT_BLOCKING = [
    r"\borca\b[\s\S]{0,15}\borchestration\b[\s\S]{0,15}\bcheck\b[\s\S]{0,80}--wait\b|\borca\b[\s\S]{0,15}\bterminal\b[\s\S]{0,15}\bwait\b|\borca\b[\s\S]{0,15}\borchestration\b[\s\S]{0,15}\bask\b",
]
AGENT_TERM = r"(?i)\b(orca|worker|dispatch|agent|bg_\w+)\b"
POLL_CALL = r"(?i)\bpoll\w*\s*\("
POLL_LABEL = r"(?i)\b(?:action|label)\s*=\s*['\"]([^'\"]*)['\"]"
CI_LABEL = r"(?i)pipeline|\bci\b|deploy"
AGENT_LABEL = r"(?i)worker|dispatch|agent"
SLEEP_CALL = r"(?i)\btime\.sleep\s*\(|\bsleep\s+\d"
LOOP_WORD = r"(?i)\b(?:while|until|for)\b"

# Marks of slow and of fast model tiers.
FAST_TIER = r"\b(?:mini|flash|haiku|lite|small|nano|sonnet)\b"
HEAVY_TIER = [
    r"\bopus\b", r"\bo[13]\b", r"(?:^|[-_])pro(?:$|[-_])", r"\bgrok\b[\s\S]*\bheavy\b",
    r"\blarge\b", r"\b405b\b", r"\br1\b",
]


def waits_for(text: Column) -> Column:
    """struct(kind, target) of a wait, NULL kind for plain work."""
    return let(text, _waits_for)


def _waits_for(text: Column) -> Column:
    ci = matches_any(text, CI_WAITS)
    labelled = text.rlike(POLL_LABEL)
    label = F.when(labelled, F.regexp_extract(text, POLL_LABEL, 1)).otherwise(text)
    is_poll = text.rlike(POLL_CALL) | labelled
    by_label = let(
        label,
        lambda x: F.when(names_review(x), "review").when(x.rlike(CI_LABEL), "ci")
        .when(x.rlike(AGENT_LABEL), "agents").otherwise("polling"),
    )
    poll = F.when(is_poll, by_label)
    blocking = matches_any(text, AGENT_BLOCKING)
    sleeping = text.rlike(SLEEP_CALL) & text.rlike(LOOP_WORD)
    term = F.lower(F.regexp_extract(text, AGENT_TERM, 1))
    parts = F.struct(
        ci.alias("ci"), poll.alias("poll"), blocking.alias("blocking"), sleeping.alias("sleeping"),
        names_review(text).alias("review"), term.alias("term"),
    )
    return let(parts, _wait_of_parts)


def _wait_of_parts(p: Column) -> Column:
    """First rule that holds: build, labelled poll, blocking agent call, loop."""
    named = p["term"] != ""
    generic = F.coalesce(p["poll"] == "polling", F.lit(False)) | p["sleeping"]
    answer = lambda kind, target: F.struct(kind.alias("kind"), target.alias("target"))
    fixed = lambda kind, target=None: answer(F.lit(kind), F.lit(target or kind))
    return (
        F.when(p["ci"], fixed("ci"))
        .when(p["poll"].isin("review", "ci"), answer(p["poll"], p["poll"]))
        .when(p["poll"] == "agents", answer(F.lit("agents"), F.when(named, p["term"]).otherwise("agents")))
        .when(p["blocking"] & p["review"], fixed("review"))
        .when(p["blocking"], fixed("agents", "orca"))
        .when(generic & named, answer(F.lit("agents"), p["term"]))
        .when(generic, fixed("polling", "generic"))
    )


def wait_kind(tool: Column, text: Column) -> Column:
    """ci, review, agents, polling or NULL for a call of `tool`."""
    return F.when(tool.isin("wait", "task") | tool.endswith("_wait"), F.lit("agents")).when(
        tool.isin("bash", "eval"), waits_for(text)["kind"]
    )


def bucket_of_wait(kind: Column) -> Column:
    return F.when(kind.isin("ci", "review", "agents"), kind).otherwise(F.lit("tools"))


# What stands around the command that does the work.
SETUP = r"^(?:(?:cd\s+\S+\s*&&\s*)|(?:set\s+[^;&\n]*(?:;|&&|\n)\s*))+"
ENV = r"^(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s+)+"
RUNNER = r"^(?:npx|pnpm\s+exec|uv\s+run)(?:\s+|$)"
LOOP_BODY = r"(?is)\b(?:for|while|until)\b.*?\bdo\b(.*?)\bdone\b"


def _loop_step(command: Column) -> Column:
    """First statement of a shell loop body, else the command itself."""
    def step(body: Column) -> Column:
        first = trimmed(F.element_at(F.split(body, r";|&&"), 1))
        return F.when(body == "", command).when(first == "", body).otherwise(first)

    return let(trimmed(F.regexp_extract(command, LOOP_BODY, 1)), step)


def shell_family(command: Column) -> Column:
    """First one or two words of the command that does the work."""
    cmd = trimmed(command)
    for _ in range(3):
        cmd = let(cmd, _loop_step)
    cmd = F.regexp_replace(cmd, SETUP, "")
    cmd = F.regexp_replace(cmd, ENV, "")
    cmd = F.regexp_replace(trimmed(cmd), RUNNER, "")
    words = F.filter(F.split(cmd, r"\s+"), lambda w: w != "")

    def family(w: Column) -> Column:
        first, second = F.get(w, F.lit(0)), F.get(w, F.lit(1))
        two = second.isNotNull() & ~second.startswith("-") & ~second.startswith("$")
        return F.when(first.isNull(), "bash").when(two, F.concat_ws(" ", first, second)).otherwise(first)

    return let(words, family)


# Code that runs a command, drives a browser or is Python.
SUBPROCESS = (
    r"\b(?:sh|subprocess\.(?:run|call|check_output|check_call|Popen))\s*\(\s*['\"`]([^'\"`]+)['\"`]"
    r"|\bBun\.\$\s*(?:\(\s*['\"`]([^'\"`]+)['\"`]|`([^`]*)`)"
)
BROWSER = r"\bbrowser\s*\."
PYTHON_LOOK = r"(?m)^\s*(?:def\s+\w+\s*\(|import\s+\w|from\s+\w+\s+import\b|print\s*\()"


def command_family(tool: Column, text: Column, language: Column) -> Column:
    """Grouping key of a call for busy time by command."""
    return let(
        F.struct(tool.alias("tool"), text.alias("text"), language.alias("language")),
        lambda c: _family(c["tool"], c["text"], c["language"]),
    )


def _family(tool: Column, text: Column, language: Column) -> Column:
    target = F.when(tool.isin("bash", "eval"), waits_for(text)["target"])
    inner = trimmed(F.concat(*[F.regexp_extract(text, SUBPROCESS, i) for i in (1, 2, 3)]))
    by_language = (
        F.when(language == "py", "eval: python")
        .when(language == "js", "eval: js")
        .when(text.rlike(PYTHON_LOOK), "eval: python")
        .otherwise("eval: js")
    )
    in_code = let(inner, lambda x: F.when(x != "", shell_family(x)).otherwise(by_language))
    work = (
        F.when(tool == "bash", shell_family(text))
        .when((tool == "eval") & text.rlike(BROWSER), "eval: browser")
        .when(tool == "eval", in_code)
        .when(F.coalesce(tool, F.lit("")) == "", "unknown")
        .otherwise(tool)
    )
    return F.coalesce(F.concat(F.lit("polling: "), target), work)


def is_heavy_model(name: Column) -> Column:
    lower = F.lower(name)
    return ~lower.rlike(FAST_TIER) & matches_any(lower, HEAVY_TIER, ignore_case=False)
