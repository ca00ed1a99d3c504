"""Near-duplicate names and suggestion filters against comparing all with all."""

import random

from worktrail.operators import filters


def close(candidate, existing):
    norm = lambda t: " ".join(t.lower().replace("-", " ").replace("_", " ").split())
    a, b = norm(candidate), norm(existing)
    if not a or not b:
        return False
    if len(b) >= 4 and b in a:
        return True
    words = lambda t: {w for w in t.split(" ") if len(w) > 3 and w not in filters.COMMON_WORDS}
    ta, tb = words(a), words(b)
    return bool(ta and tb) and len(ta & tb) / min(len(ta), len(tb)) >= 0.5


def test_random_names(spark):
    rng = random.Random(6)
    words = ["deploy", "review", "build", "tests", "docs", "skill", "with", "log", "cache", "parser", "release", "notes", "lint", "graph"]
    name = lambda: rng.choice(["-", "_", " "]).join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 6])))
    candidates = [(u, name()) for u in "ab" for _ in range(60)] + [("a", ""), ("a", "xy"), ("b", "redeploys it")]
    names = [(u, "-".join(rng.sample([*words, f"own{i}"], rng.choice([3, 5, 6])))) for u in "ab" for i in range(12)] + [("b", "deploy"), ("b", ""), ("a", "log")]
    got = filters.near_duplicate_names(spark.createDataFrame(candidates, "user string, name string"), spark.createDataFrame(names, "user string, existing string"), by=["user"])
    want = {(u, c) for u, c in candidates if any(v == u and close(c, n) for v, n in names)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and 0 < len(want) < len(set(candidates))


def test_common_words_emit_no_pairs(spark):
    """All names hold the same word; candidates too; only rarer words are looked up."""
    names = spark.createDataFrame([(f"common n{i:04d}a n{i:04d}b n{i:04d}c",) for i in range(300)], "existing string")
    candidates = spark.createDataFrame([(f"common m{i:04d}a m{i:04d}b m{i:04d}c",) for i in range(300)] + [("common n0007a n0007b other",)], "name string")
    assert [r.name for r in filters.near_duplicate_names(candidates, names).collect()] == ["common n0007a n0007b other"]


def test_suggestions(spark):
    settings = spark.createDataFrame([("on", True, "hindsight"), ("off", False, "off"), ("part", True, "local")], "user string, autolearn boolean, backend string")
    texts = {"learn": "Use the Learn tool", "manage": "try manage_skill now", "keep": "retain what you RECALL", "plain": "retained notes"}
    rows = [(u, n, t) for u in ("on", "off", "part", "none") for n, t in texts.items()] + [("on", "Release notes skill", "x"), ("on", "release notes", "y"), ("off", "Release notes skill", "x")]
    installed = spark.createDataFrame([("on", "release-notes")], "user string, skill string")
    got = filters.filter_suggestions(spark.createDataFrame(rows, "user string, name string, text string"), installed, settings, ["user"])
    kept = {(r.user, r.name) for r in got.collect()}
    assert kept == {("on", "learn"), ("on", "manage"), ("on", "keep"), ("on", "plain"), ("on", "release notes"), ("off", "plain"), ("off", "Release notes skill"), ("part", "learn"), ("part", "manage"), ("part", "plain"), ("none", "plain")}
