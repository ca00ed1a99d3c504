"""Near-duplicates by shingle overlap against brute force."""

import random

import numpy as np

from worktrail.llm import overlap


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def components_by_force(rows):
    """(id, least id of the component) of (id, text) rows."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and similar(sets[a], sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    ids = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            ids[g] = min(i, ids.get(g, i))
    return sorted(((i, ids.get(g)) for g, (i, _) in zip(group, rows)), key=repr)


def planted(rng):
    """Texts of 184 words whose ends differ: similarity 0.957, 0.905, 0.856, exactly 0.8, and 0.791."""
    texts = []
    for changed in (4, 9, 14, 20, 21) * 3:
        base = [f"w{rng.randrange(10**9)}" for _ in range(184)]
        texts += [" ".join(base), " ".join(base[:184 - changed] + [f"x{rng.randrange(10**9)}" for _ in range(changed)])]
    return texts


def scattered(rng, copies=60):
    """Copies of one text with single words changed, some linked over others only and some not at all."""
    base = [f"b{rng.randrange(10**9)}" for _ in range(150)]
    out = []
    for _ in range(copies):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(6)):
            copy[at] = f"n{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def test_near_groups_like_brute_force(spark):
    rng = random.Random(11)
    texts = [None, "", " \t", "One", "one two", "ONE  TWO", "a b c d e", "A b c d e", "a b c d e f", "a b c d e g"]
    texts += planted(rng) + scattered(rng) + [t.upper() for t in scattered(rng, 3)]
    texts += [" ".join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(12))) for _ in range(60)]
    rng.shuffle(texts)
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)] + [(None, texts[10]), (4, texts[10]), (None, "nowhere else")]
    want = components_by_force(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.component_id) for r in overlap.near_groups(df).collect()), key=repr)
    assert got == want and 20 < len({c for _, c in want}) < len(texts)


def test_pairs_after_the_rounds_are_found(spark):
    """Nodes that neither round's hub reaches are linked in the end: two groups in the same buckets, far from each other's hub."""
    rng = random.Random(12)
    base = [f"c{rng.randrange(10**9)}" for _ in range(184)]
    chain = [" ".join([f"d{k}" for k in range(s)] + base[s:]) for s in range(0, 100, 10)]
    rows = list(enumerate([*chain, *scattered(rng, 30)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in overlap.near_groups(df).collect()), key=repr)
    assert got == components_by_force(rows)


def test_parities_never_exceed_the_difference():
    rng = random.Random(13)
    for t, u in zip(scattered(rng), scattered(rng)):
        for other in (u, t + " more words"):
            a, b = overlap.shingle_set(t), overlap.shingle_set(other)
            odd = int(np.unpackbits((overlap.parities(a) ^ overlap.parities(b)).view(np.uint8)).sum())
            assert odd <= len(np.setxor1d(a, b))


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert overlap.near_groups(df).collect() == [] and overlap.drop_near_copies(df).collect() == []
