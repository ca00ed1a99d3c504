"""Fork trees: spans, copies against a walk over all ancestors, long chains, cycles."""

import random

import pytest

from worktrail.operators import forks

LINKS, RECORDS = "session_id string, parent string", "session_id string, sidecar_name string, rec_id string"


def ancestors(parent, session):
    out, at = set(), session
    while (at := parent.get(at)) is not None and at not in out:
        out.add(at)
    return out - {session}


def by_force(parent, records):
    held = {}
    for s, side, rec in records:
        held.setdefault(s, set()).add((side, rec))
    return {(s, side, rec) for s, side, rec in records if rec is not None and any((side, rec) in held.get(a, ()) for a in ancestors(parent, s))}


def copied(spark, parent, records):
    trees = forks.fork_trees(spark.createDataFrame(list(parent.items()), LINKS))
    return {tuple(r) for r in forks.copied_records(spark.createDataFrame(records, RECORDS), trees).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(60)]
    parent = {n: names[rng.randrange(i)] for i, n in enumerate(names) if i and rng.random() < 0.8}
    records = sorted({(n, rng.choice(["", "x"]), f"r{rng.randrange(25)}") for n in names for _ in range(8)}) + [("s1", "", None)]
    assert copied(spark, parent, records) == by_force(parent, records)


def test_cycles_and_what_hangs_on_them(spark):
    parent = {"a": "b", "b": "c", "c": "a", "d": "a", "e": "d", "x": "y", "y": "x", "t": "u"}
    records = [(s, "", r) for s, rs in {"a": "1", "b": "12", "c": "3", "d": "23", "e": "34", "x": "56", "y": "6", "t": "7", "u": "7", "z": "7"}.items() for r in rs]
    assert copied(spark, parent, records) == by_force(parent, records)


def test_chain_of_a_thousand(spark):
    """Labels and candidate rows are linear in the chain; each session copies all before it."""
    parent = {f"s{i}": f"s{i - 1}" for i in range(1, 1000)}
    trees = forks.fork_trees(spark.createDataFrame(list(parent.items()), LINKS)).collect()
    assert len(trees) == 1000 and {t.root for t in trees} == {"s0"}
    span = {t.session_id: (t.enter, t.leave) for t in trees}
    assert all(span[p][0] < span[c][0] < span[c][1] < span[p][1] for c, p in parent.items())
    records = [(f"s{i}", "", f"r{j}") for i in range(1000) for j in {0, i, max(0, i - 1)}]
    assert copied(spark, parent, records) == by_force(parent, records)


def test_tree_of_ten_thousand_with_a_hot_parent(spark):
    rng = random.Random(9)
    parent = {f"s{i}": "s0" if i % 3 else f"s{rng.randrange(i)}" for i in range(1, 10_000)}
    trees = forks.fork_trees(spark.createDataFrame(list(parent.items()), LINKS)).collect()
    span = {t.session_id: (t.enter, t.leave) for t in trees}
    assert len(span) == 10_000 and len({x for s in span.values() for x in s}) == 20_000
    assert all(span[p][0] < span[c][0] < span[c][1] < span[p][1] for c, p in parent.items())


def test_no_links(spark):
    assert forks.fork_trees(spark.createDataFrame([], LINKS)).count() == 0
