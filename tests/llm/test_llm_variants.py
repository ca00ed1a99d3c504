"""Spelling variants against a comparison of all words."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from worktrail.llm import variants
from worktrail.llm.queries import altered

SCHEMA = "doc_id long, text string, word string, r string, n long, key string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "w", "r", 1, "k") for i, t in texts], SCHEMA)


def near_by_force(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def by_force(counts, least_length=5, least_count=3):
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {w: [x for x in words if near_by_force(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def count(texts):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return Counter(w for _, t in texts for w in re.findall("[A-Za-zÀ-ÿ]+", fold(t)))


def collected(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_random_words(spark):
    rng = random.Random(3)
    letters = "abéÿ"
    texts = [(i % 40, " ".join("".join(rng.choice(letters) for _ in range(rng.choice([4, 5, 5, 6, 7]))).title() for _ in range(60)) + " 5-x") for i in range(60)]
    texts += [(None, "abaab abaab abaab"), (7, None), (8, ""), (9, "!"), (9, "!"), (10, "a" * 30_000 + " " + "b" * 40), (11, "b" * 40), (12, "b" * 41), (13, "b" * 40)]
    want = by_force(count(texts))
    assert len(want) > 100
    assert collected(variants.variants(frame(spark, texts))) == want


def test_chains_and_ties(spark):
    n = {"maison": 1000, "maisn": 400, "masn": 9, "maisne": 90, "aisne": 40, "zisne": 80, "yisne": 80, "lonely": 3, "few": 99, "rarely": 2}
    texts = [(i, " ".join([w] * k)) for i, (w, k) in enumerate(n.items())]
    got = collected(variants.variants(frame(spark, texts)))
    assert got == by_force(n)
    assert got["aisne"][:2] == ("maisne", "maison") and got["lonely"] == (None, "lonely", 3, 0, None)


def test_one_symbol_still_finds_all(spark):
    """With all letters on one symbol only the exact halves tell words apart."""
    rng = random.Random(8)
    words = {"".join(rng.choice("abc") for _ in range(rng.choice([5, 6]))) for _ in range(150)}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    for symbols in ("a", "ab"):
        got = {(r.word, r.near) for r in variants.near_pairs(df, symbols).collect()}
        assert got == {(a, b) for a in words for b in words if near_by_force(a, b)}


def test_neighbourhoods_are_not_broadcast(spark):
    """They are many times what Spark takes them for, and must not go to the driver."""
    df = spark.createDataFrame([("maison", 9), ("maisn", 4)], "word string, n long")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    near = variants.near_pairs(df)
    assert len(near.collect()) == 2
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_half_neighbourhood_is_half_of_all():
    letters = np.frombuffer(b"aabcc", dtype=np.uint8).reshape(1, 5)
    found = [bytes(row.tobytes()).decode() for of, rows in variants.half_neighbourhood(letters, "abc") for row in rows]
    assert len(found) == len(set(found))
    assert {x for x in found if len(x) == 4} == {"abcc", "aacc", "aabc"}
    assert all(x >= "aabcc" for x in found if len(x) == 5)


def test_altered_runs(spark):
    import zlib

    texts = [(i, " ".join(f"{chr(97 + j % 26)}èword{chr(97 + j // 26)}" for j in range(100))) for i in range(12)]
    want = Counter()
    for i, t in texts:
        for w in t.split():
            h = zlib.crc32(f"{i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    got = {r.word: r.n for r in variants.word_counts(frame(spark, texts), alter=altered, least_count=1).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5} and any(n == 1 for n in want.values())


def test_empty_tables(spark):
    assert variants.variants(frame(spark, [(1, "a b c")])).count() == 0
    assert variants.variants(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert variants.reduced(F.lit("x")) is not None
