"""Conversation repair against a search over all edits."""

import hashlib
import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from worktrail.llm import conversation

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, kind string, edits int, conv string, nth int, present string"


def frame(spark, rows):
    """Rows with extra columns that bear the names the operator uses inside."""
    return spark.createDataFrame([(*r, "x", 7, "y", 3, "z") for r in rows], SCHEMA)


def by_force(rows):
    """(counts..., cost, audit, digest) of one conversation by trying every edit."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), y[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else None)
        seen.add((role, text))

    def allowed(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @lru_cache(None)
    def best(i, state, added):
        """Cheapest (cost, audit, lines) from here; at most two turns added in a row."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def take(cost, letter, line, then):
            if then is not None:
                found.append((cost + then[0], letter + then[1], ((line,) if line is not None else ()) + then[2]))

        if added < 2:
            for role in ("user", "assistant"):
                if allowed(state, role[0]):
                    take(2, "I", f"{role}:", best(i, role[0], added + 1))
        if i < len(rows):
            _, role, text = rows[i]
            take(3, "D", None, best(i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if allowed(state, role[:1]):
                    take(extra, "K", f"{role}:{text}", best(i + 1, role[0], 0))
                for new in ("user", "assistant"):
                    if allowed(state, new[0]):
                        take(2 + extra, "R", f"{new}:{text}", best(i + 1, new[0], 0))
        return min(found, default=None)

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in conversation.FAULTS), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def grouped(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return out


def test_random_conversations(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", None, "", "ünser"]
    texts = ["Well.", "yes!", "so", "", " \n", None, "cut off\t", "Why? ", "é"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles[: rng.choice([2, 3, 7])]), rng.choice(texts)) for c in range(150) for _ in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", "hi."), (None, 2, "user", "ho.")]
    got = {r.conv: tuple(r)[1:] for r in conversation.summaries(frame(spark, rows)).collect()}
    assert got == {conv: by_force(own) for conv, own in grouped(rows).items()}


def test_steps_make_the_summary(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "u."), (1, 2, "user", "u."), (1, 3, "user", "v."), (2, 0, "assistant", "a" * 100_000 + "."), (2, 1, "tool", "t.")]
    steps = conversation.repair(frame(spark, rows)).collect()
    assert [s.step for s in steps if s.conv == 1] == list(range(len([s for s in steps if s.conv == 1])))
    whole = {r.conv: r for r in conversation.summaries(frame(spark, rows)).collect()}
    for conv, summary in whole.items():
        own = sorted((s for s in steps if s.conv == conv), key=lambda s: s.step)
        assert "".join(s.edit for s in own) == summary.audit
        lines = "\n".join(f"{s.role}:{s.text}" for s in own if s.edit != "D")
        assert hashlib.sha256(lines.encode()).hexdigest() == summary.repaired_sha256
    deleted = [s for s in steps if s.edit == "D" and s.conv == 1]
    assert [(s.turn, s.text, s.fault) for s in deleted] == [(2, "u.", "duplicate")]


def test_state_crosses_batches(spark):
    """A conversation of many Arrow batches, as cheap as in one."""
    rows = [(1, t, ["user", "assistant", "assistant"][t % 3], f"line {t}.") for t in range(120)]
    want = by_force([r[1:] for r in rows])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert tuple(conversation.summaries(frame(spark, rows)).first())[1:] == want
        assert conversation.repair(frame(spark, rows)).count() == len(want[-2])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_absent_rows_and_empty_tables(spark):
    df = frame(spark, [(1, 0, "user", "a."), (2, 0, "user", "b."), (2, 1, "assistant", "c.")])
    got = {r.conv: r for r in conversation.summaries(df, present=F.col("conv_id") == 2).collect()}
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[2].audit, got[2].cost) == ("KK", 0)
    assert conversation.summaries(df.limit(0)).count() == 0 and conversation.repair(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", range(12))
def test_costs_stay_in_bounds(kind):
    """Differences between states are bounded, so the table of steps is small."""
    seen, todo = set(), [conversation.AT_END]
    while todo:
        costs = todo.pop()
        if costs not in seen:
            seen.add(costs)
            for k in {kind, *range(12)}:
                after, _ = conversation.backward(costs, k)
                todo.append(tuple(x - min(after) for x in after))
    assert len(seen) < 200
