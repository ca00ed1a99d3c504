"""The near-dedup stage of the pipeline against brute-force components."""

import random

import test_llm_overlap as force

import corpus_pipeline
from worktrail.llm.common import table

SF = "/root/testdata/sf0.001"


def test_near_stage_keeps_one_of_each_component(spark):
    stage = corpus_pipeline.STAGES[2][1]
    docs = table(spark, SF, "documents").limit(60)
    rng = random.Random(14)
    texts = force.planted(rng) + force.scattered(rng, 20)
    added = spark.createDataFrame([(9000 + i, t, "x", "s", len(t)) for i, t in enumerate(texts)], docs.schema)
    docs = docs.union(added).localCheckpoint()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pairs = [force.similar(force.shingles(a), force.shingles(b)) for a, b in zip(texts[0:30:2], texts[1:30:2])]
    assert pairs == [True, True, True, True, False] * 3  # 0.957, 0.905, 0.856, 0.8 and 0.791
    kept = stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in force.components_by_force(rows)})


def test_near_stage_takes_candidates_from_simhash(spark, monkeypatch):
    """SimHash groups of five-word fingerprints are proposed first, each node with the least of its group."""
    from worktrail.llm import overlap, simhash

    rng = random.Random(15)
    base = [f"w{rng.randrange(10**9)}" for _ in range(1500)]
    texts = [" ".join(base[:-1] + [f"x{i}"]) for i in range(12)] + [" ".join(f"y{rng.randrange(10**9)}" for _ in range(40)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "x", "s", len(t)) for i, t in enumerate(texts)], table(spark, SF, "documents").schema)
    node, print_ = [overlap.node_of(overlap.shingle_set(t)) for t in texts], [simhash.fingerprint(t, overlap.SHINGLE) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (print_[a] ^ print_[b]).bit_count() <= 3:
                group = [group[b] if g == group[a] else g for g in group]
    want = set()
    for i, g in enumerate(group):
        least = min(n for n, h in zip(node, group) if h == g)
        if node[i] != least:
            want.add((least, node[i]))
    assert want
    seen, pairs = [], overlap.simhash_pairs
    monkeypatch.setattr(overlap, "simhash_pairs", lambda nodes: seen.append(pairs(nodes)) or seen[-1])
    kept = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(12, 32)]
    assert {(bytes(r.a), bytes(r.b)) for r in seen[0].collect()} == want
