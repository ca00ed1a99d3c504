"""Nearest neighbours: recall, exact scores, copies and hot buckets against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from worktrail.llm import ann

SCHEMA = "vec_id long, embedding array<float>, id long, v string, code long, key long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA)


def searched(df, k=20, **kw):
    out = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def by_force(rows, k=20):
    good = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q is not None and q % 20 == 0:
            scored = sorted(((float(np.einsum("rc,c->r", w[None], v)[0]), i) for i, w in good if i != q), key=lambda x: (-x[0], x[1] is None, x[1]))
            out[q] = [(n + 1, i, s) for n, (s, i) in enumerate(scored[:k])]
    return out


def recall(got, want):
    hits = sum(len({x[1] for x in got.get(q, [])} & {x[1] for x in found}) for q, found in want.items())
    return hits / sum(map(len, want.values()))


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 24))
    rows = [(i, (centres[i % 30] * rng.uniform(0.2, 3.0) + 0.4 * rng.standard_normal(24)).tolist()) for i in range(3000)]
    want, got = by_force(rows), searched(frame(spark, rows))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert recall(got, want) >= 0.9
    scores = {(q, x[1]): x[2] for q, found in want.items() for x in found}
    for q, found in got.items():
        assert [x[2] for x in found] == sorted((x[2] for x in found), reverse=True)
        assert all(scores.get((q, i), s) == s for _, i, s in found)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want = by_force([(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()])
    assert recall(searched(df), want) >= 0.9


def test_copies_and_ties_are_exact(spark):
    """A third of the rows are one vector; blocks are smaller than its bucket."""
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 0.5] if i % 3 == 0 else rng.standard_normal(3).tolist()) for i in range(900)]
    got = searched(frame(spark, rows), block_rows=8, success=0.9999)
    assert got == by_force(rows)


def test_full_buckets_are_split(spark):
    """Different vectors of one bucket, more than a block holds."""
    rng = np.random.default_rng(3)
    rows = [(i, (np.array([1.0, 1.0, 1.0]) + 1e-4 * rng.standard_normal(3)).tolist()) for i in range(400)]
    assert recall(searched(frame(spark, rows), block_rows=16, success=0.999), by_force(rows)) >= 0.99


def test_unusable_vectors_and_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [math.nan, 1.0]), (3, [math.inf, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (None, [2.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (40, [0.0, 0.0]), (7, [-1.0, 0.0])]
    got = searched(frame(spark, rows), success=0.9999)
    assert {q: [(i, s) for _, i, s in x] for q, x in got.items()} == {0: [(None, 2.0), (1, 1.0), (20, 0.0), (7, -1.0)], 20: [(1, 1.0), (0, 0.0), (7, 0.0), (None, 0.0)]}
    odd = rows + [(60, [1.0, 2.0, 3.0])]
    assert 60 not in searched(frame(spark, odd), success=0.9999)


def test_empty(spark):
    assert searched(frame(spark, [(0, [1.0])]).limit(0)) == {}
    assert searched(frame(spark, [(0, None)])) == {}
    assert searched(frame(spark, [(0, [1.0])])) == {}


def test_probes_come_in_order_of_chance():
    rng = np.random.default_rng(4)
    chances = rng.dirichlet(np.ones(6), size=(2, 3))
    codes = ann.likeliest(chances, 0.9)
    of = lambda c: [x[0][c // 4096] * x[1][c // 64 % 64] * x[2][c % 64] for x in chances]
    values = [sum(of(c)) for c in codes]
    assert values == sorted(values, reverse=True)
    reached = np.sum([of(c) for c in codes], axis=0)
    assert min(reached) >= 0.9 > min(reached - of(codes[-1]))
    every = sorted((sum(of(a * 4096 + b * 64 + c)) for a in range(6) for b in range(6) for c in range(6)), reverse=True)
    assert values == pytest.approx(every[: len(values)])
