"""Ordered scans against plain loops, with hot keys and many chunks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from worktrail.functions import numeric
from worktrail.operators import scan


def sample(seed, n=400):
    """A third of the rows and more share key 0."""
    rnd = random.Random(seed)
    return [(0 if rnd.random() < 0.4 else rnd.randint(1, 9), i, rnd.randint(-3, 9), rnd.choice([None, rnd.randint(0, 50)])) for i in rnd.sample(range(5000), n)]


@pytest.mark.parametrize("width", [7, 300, 10_000])
def test_ordered_scan(spark, width):
    data = sample(width)
    df = spark.createDataFrame(data, "k int, t bigint, v int, x int")
    got = scan.ordered_scan(
        df, ["k"], ["t"], scan.by_width("t", width), sums={"run": F.col("v")}, maxs={"top": F.col("x")},
        last={"prev": F.col("x")}, next_={"next": F.col("x")}, totals={"all": F.col("v")},
    ).collect()
    assert len(got) == len(data)
    for r in got:
        mine = sorted((d for d in data if d[0] == r.k), key=lambda d: d[1])
        before, after = [d for d in mine if d[1] < r.t], [d for d in mine if d[1] > r.t]
        known = [d[3] for d in before if d[3] is not None]
        later = [d[3] for d in after if d[3] is not None]
        assert r.run == sum(d[2] for d in before) + r.v
        assert r.top == (max(known) if known else None)
        assert r.prev == (known[-1] if known else None)
        assert r.next == (later[0] if later else None)
        assert r["all"] == sum(d[2] for d in mine)


def test_look_ahead_shares_the_forward_sort_and_is_linear(spark):
    rows = spark.range(300_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    got = scan.ordered_scan(
        rows, ["k"], ["t"], scan.by_width("t", 1_000_000), sums={"n": F.lit(1)}, next_={"end": F.when(F.col("t") == 299_999, F.col("t"))})
    assert not re.search(r"\bt#\d+L? DESC", got._jdf.queryExecution().optimizedPlan().toString())
    assert got.agg(F.count("end"), F.min("end"), F.max("n")).first()[:] == (299_999, 299_999, 300_000)


def test_framed_crosses_chunks(spark):
    df = spark.range(1, 101).select(F.lit("a").alias("k"), F.col("id").alias("pos"), F.col("id").cast("double").alias("v"))
    got = scan.framed(df, ["k"], "pos", {"m": (F.avg("v"), -10, -1), "n": (F.count("v"), 0, 9)}, width=16).collect()
    assert len(got) == 100
    for r in got:
        before = [x for x in range(r.pos - 10, r.pos) if x >= 1]
        assert r.m == (sum(before) / len(before) if before else None)
        assert r.n == min(10, 101 - r.pos)


@pytest.mark.parametrize("seed", range(3))
def test_interval_unions(spark, seed):
    rnd = random.Random(seed)
    hour = scan.HOUR_MS
    spans = [("a" if rnd.random() < 0.6 else "b", s := rnd.randint(0, 40) * hour // 4, s + rnd.randint(0, 9) * hour // 4) for _ in range(30)]
    df = spark.createDataFrame(spans, "k string, start_ms bigint, end_ms bigint")
    covered = {r.k: r.covered_ms for r in scan.covered_length(df, ["k"]).collect()}
    merged = scan.merged_intervals(df, ["k"]).collect()
    step = hour // 4
    for k in "ab":
        cells = {c for kk, s, e in spans if kk == k for c in range(s // step, e // step)}
        assert covered.get(k, 0) == len(cells) * step
        assert sum(r.end_ms - r.start_ms for r in merged if r.k == k) == len(cells) * step
        edges = sorted((r.start_ms, r.end_ms) for r in merged if r.k == k)
        assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("p", [0, 50, 90, 100])
def test_percentile_rule(spark, p):
    rnd = random.Random(p)
    values = [("a", rnd.choice([rnd.uniform(-5, 5), rnd.randint(0, 3), rnd.uniform(0, 1e9)])) for _ in range(101)]
    df = spark.createDataFrame([(k, float(v)) for k, v in values], "k string, v double")
    ordered = sorted(v for _, v in values)
    got = numeric.percentiles(df, ["k"], "v", {"p": p}).collect()[0].p
    assert got == ordered[min(len(ordered) - 1, int(p / 100 * len(ordered)))]
    mid = numeric.medians(df, ["k"], "v", "m").collect()[0].m
    assert mid == pytest.approx(ordered[50])


def test_weighted_percentile(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 0), ("a", 9.0, 3), ("a", 4.0, 1)], "k string, v double, w int")
    assert numeric.weighted_percentile(df, ["k"], "v", "w", 50, "p").collect()[0].p == 4.0
    assert numeric.weighted_percentile(df, ["k"], "v", "w", 100, "p").collect()[0].p == 9.0


@pytest.mark.parametrize("x,want", [(-2.5, -2.0), (2.5, 3.0), (0.49, 0.0), (1e17, 1e17)])
def test_half_up(spark, x, want):
    assert spark.range(1).select(numeric.round_half_up(F.lit(x)).alias("r")).collect()[0].r == want
