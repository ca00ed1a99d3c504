"""Url rules, chat rotation, top-k search, source mixing: small cases and brute force."""

import math
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from worktrail.llm import chat, mixing, topk, url_rules

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block"}


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "p", ["t"], "x") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, tokens array<string>, action string")


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):], re.S)[0]


def listed(host, path):
    fits = [r for r in RULES if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/"):])]
    return max(fits, key=len, default=None)


def url_token_set(url):
    host, path = parts(url)
    if not host and not path:
        return frozenset()
    query = re.match(r"[^?#]*\?([^#]*)", url[url.index("://") + 3:], re.S)
    keys = [k.split("=")[0] for k in query[1].split("&")] if query else []
    return frozenset([f"h:{x}" for x in host.split(".") if x] + [f"p:{x}" for x in re.sub("[0-9]+", "#", path).split("/") if x] + [f"q:{x}" for x in keys if x])


def verdicts_by_force(urls, support, confidence, most):
    rows = [(u, listed(*parts(u)), url_token_set(u)) for u in urls]
    known = [(t, RULES[r]) for _, r, t in rows if r]
    count, by_action = Counter(), Counter()
    for tokens, action in known:
        for n in range(1, most + 1):
            for s in combinations(sorted(tokens), n):
                count[s] += 1
                by_action[s, action] += 1
    least = math.ceil(support * len(known))
    mined = {k: v / count[k[0]] for k, v in by_action.items() if v >= least and v / count[k[0]] >= confidence}
    out = []
    for i, (u, rule, tokens) in enumerate(rows):
        surest = {"block": 0, "allow": 0}
        for (s, action), c in mined.items():
            if tokens.issuperset(s):
                surest[action] = max(surest[action], c)
        out.append((i, *parts(u), rule, RULES[rule] if rule else "block" if surest["block"] > surest["allow"] else "allow"))
    return out


def test_judge_like_brute_force(spark):
    rng = random.Random(3)
    urls = [None, "", "no scheme", "http://", "://x.com/", "HTTP://WWW.Example.COM/en/1", "http://notexample.com/en/", "http://a.example.com/en/", "http://com/", "http://x.com",
            "http://x.net/es/?a=1&b&=c#://y.com/", "http://x.net?q=://a.com/", "http://É.com/Ä", "http://x.net/es/\nline", "http://x.com/" + "a/" * 3000]
    urls += [f"http://{rng.choice(['www', 'm', 'a'])}.{rng.choice(['example', 'site'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}/{rng.randrange(99)}{rng.choice(['', '?ref=1', '?page=2&ref=x'])}" for _ in range(300)]
    urls += urls[20:60]
    got = url_rules.judge(pages(spark, urls), RULES, min_support=0.02, min_confidence=0.7, most_tokens=2)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect())) == verdicts_by_force(urls, 0.02, 0.7, 2)


def test_judge_without_pages_or_labels(spark):
    assert url_rules.judge(pages(spark, []), RULES).collect() == []
    assert [r.verdict for r in url_rules.judge(pages(spark, ["http://a.org/", None]), RULES).collect()] == ["allow", "allow"]
    labelled = spark.createDataFrame([("http://bad.org/1", "block")] * 3 + [("http://good.org/2", "allow")] * 3 + [(None, "block"), ("http://z.org", None)], "url string, action string")
    got = url_rules.judge(pages(spark, ["http://bad.org/77", "http://good.org/", "http://new.org/"]), {}, labelled=labelled, min_support=0.3)
    assert {r.page_id: r.verdict for r in got.collect()} == {0: "block", 1: "allow", 2: "allow"}


def rotate_by_force(rows, part_turns):
    talks = {}
    for conv, turn, role, text in set(rows):
        role, text = role or "unknown", text or ""
        talks.setdefault(conv, set()).add((turn, role, text))
    import hashlib

    safe = lambda s: s.replace("<|", "< |")
    out = []
    for conv, turns in talks.items():
        ordered = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{t[1]}\n{t[2]}".encode()).hexdigest(), t[1], t[2]))
        for speaker in {t[1] for t in turns} - {"system"}:
            for part in range(0, len(ordered), part_turns):
                text, mask, chosen = "", [], ordered[part:part + part_turns]
                for _, role, said in chosen:
                    text += "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f"<|user name={safe(role)}|>\n"
                    start = len(text)
                    text += safe(said) + "<|end|>\n"
                    if role == speaker:
                        mask.append((start, len(text)))
                out.append((conv, speaker, part // part_turns, len(chosen), text, tuple(mask)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4096, 4])
def test_rotation_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "TURN_BLOCK", block)
    rng = random.Random(8)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(12)]), rng.choice(["ann", "bob", "system", None, "<|x"]), rng.choice([None, "", "hi", "é <|end|> 🙂", "long " * 50])) for _ in range(250)]
    rows += [(9, 0, "system", "alone"), (10, -5, "ann", "below"), (10, 0, "bob", "zero"), *[(11, t, "ann", f"t{t}") for t in range(200)]] + rows[:20]
    frame = spark.createDataFrame([(*r, "c", 0) for r in rows], "conv_id long, turn long, role string, text string, conv string, part int")
    got = [(*r[:5], tuple(map(tuple, r.mask))) for r in chat.rotate(frame, part_turns=7).collect()]
    assert sorted(got, key=repr) == rotate_by_force(rows, 7)
    assert chat.rotate(frame.where("false")).collect() == []


def best_by_force(rows, k):
    sound = {(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for q, qv in sound:
        if q % 50 == 0:
            scored = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(qv, v)))), i) for i, v in sound if i != q)[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block, query_block, levels", [(16_384, 512, 12), (40, 3, 1), (64, 2, 40)])
def test_search_like_brute_force(spark, monkeypatch, block, query_block, levels):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(topk.ImpactIndex.search, "__defaults__", (levels,))
    rng = np.random.default_rng(block)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]  # copies: ties go to the smaller id
    rows += [(1000, [0.0] * 8), (1050, []), (1100, [1.0, -1.0]), (-50, [0.5] * 8), (None, [1.0] * 8), (1150, None), (1200, [None] * 8), (1250, [math.nan] * 8), (1300, [math.inf] * 8), (50, rows[3][1]), rows[100]]
    frame = spark.createDataFrame([(*r, 1, True, 2) for r in rows], "vec_id long, embedding array<float>, own int, is_query boolean, rank int")
    got = topk.search(frame, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == best_by_force(rows, 5)


def test_search_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0]), (3, [-2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 3, -131072)]
    assert topk.search(frame.where("vec_id = 0"), F.col("vec_id") == 0).collect() == []
    assert topk.search(frame.where("false"), F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("size", [1.0, 2.0**20, 2.0**35, 2.0**53])
def test_search_with_large_components(spark, monkeypatch, size):
    """Any finite component counts: scores past 2^53 need more than floating sums, past 2^63 more than 64 bits."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 1 << 20)
    rng = np.random.default_rng(11)
    rows = [(0, [1.0, 200000.0]), (1, [1.0, 200000.0]), (2, [-3.0, 5.0])]
    rows += [(i, [float(x) for x in (rng.normal(size=4) * size * rng.choice([1e-3, 0.5])).tolist()]) for i in range(3, 260)]
    rows += [(260, [size, -size, 1.0, 0.25]), (300, [size, size, 0.5, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = best_by_force(rows, 5)
    assert sorted(map(tuple, topk.search(frame, F.col("vec_id") % 50 == 0).collect())) == want


def test_index_stops_early_and_stays_exact():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-60, 60, size=(3000, 16))
    vectors[:40] += 90  # a clear group of winners
    index = topk.ImpactIndex(np.arange(3000), vectors)
    scores = vectors @ vectors[0]
    want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i)[:5]
    assert index.search(0, vectors[0], 5) == [(i, -s) for s, i in want]


def targets_by_force(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: Fraction(weights[i % 3]) for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: Fraction(3 * sizes[s]) if s in full else weight[s] * rest / open_weight for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("block_words, least_slots", [(1024, 65_536), (7, 1), (50, 1)])
def test_mix_meets_targets(spark, monkeypatch, block_words, least_slots):
    monkeypatch.setattr(mixing, "LEAST_SLOTS", least_slots)
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 1, 3, 40, 300]), rng.choice(["big"] * 6 + ["a", "b", "É", None])) for i in range(150)]
    rows += [(900, "x", "tiny"), (901, None, "none"), (None, "n n", "big"), (None, "n n", "big"), (3, rows[3][1], rows[3][2])]
    frame = spark.createDataFrame([(*r, 5, 6, "s") for r in rows], "doc_id long, text string, source string, size int, taken int, own string")
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    target = targets_by_force(sizes)
    mixture = mixing.mix(frame, most_block_words=block_words)
    taken = mixture.taken().collect()
    assert len(taken) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in taken)
    by_size = {s: [r for r in taken if r.source_size == n] for s, n in sizes.items() if list(sizes.values()).count(n) == 1}
    for source, found in by_size.items():
        assert abs(found[0].target - float(target[source])) < 1e-6
        assert abs(sum(r.taken for r in found) - target[source]) <= Fraction(1, 2)
    again = mixing.mix(frame, most_block_words=block_words)
    assert sorted(map(tuple, again.taken().collect()), key=repr) == sorted(map(tuple, taken), key=repr)
    slots = mixture.slots.collect()
    assert len({r.slot for r in slots}) == len(slots) and all(r.last - r.first <= mixture.block_words for r in slots)


def test_schedule_is_even(spark):
    """Any stretch of the schedule holds each source near its share."""
    rows = [(i, "w " * 100, s) for i, s in enumerate(["a"] * 50 + ["b"] * 100 + ["c"] * 50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixture = mixing.mix(frame, most_block_words=10)
    order = [r.source_no for r in mixture.slots.orderBy("slot").collect()]
    for source in (1, 2, 3):
        share = order.count(source) / len(order)
        for start in range(0, len(order) - 200, 50):
            assert abs(order[start:start + 200].count(source) - 200 * share) <= 6


def test_mixed_rows_repeat_and_cut(spark):
    rows = [(1, "a b c d e f g h", "x", 15), (2, "p q", "y", 3), (3, None, "z", 0), (4, "", None, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = mixing.mixed_rows(frame, length_col="n_chars")
    assert got.columns == frame.columns
    texts = [r.text for r in got.collect() if r.source == "x"]
    assert sum(len(t.split()) for t in texts) + sum(len(r.text.split()) for r in got.collect() if r.source == "y") == 10
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert mixing.mixed_rows(frame.where("false")).collect() == []
    assert mixing.mix(frame.where("size(split(text, 'zz')) > 9")).taken().collect() == []


def test_mixed_rows_with_clashing_names_and_repeats(spark):
    """Each repeated row gets its own count, so sources meet their targets to the word."""
    schema = "doc_id long, text string, source string, n_chars long, id long, own string, size long, taken long, copy int, words string, off long, hash int, place int, nth int, gone long"
    rows = [(i % 3, "one two three four", "a" if i < 3 else "b", 18) for i in range(9)] + [(None, "five six", None, 8)] * 4 + [(7, None, "a", 0), (8, "", None, 0)]
    frame = spark.createDataFrame([(*r, 1, "o", 2, 3, 4, "w", 5, 6, 7, 8, 9) for r in rows], schema)
    got = mixing.mixed_rows(frame, length_col="n_chars")
    assert got.columns == frame.columns
    rows_out = got.collect()
    assert all(tuple(r)[4:] == (1, "o", 2, 3, 4, "w", 5, 6, 7, 8, 9) for r in rows_out)
    words = Counter()
    for r in rows_out:
        words[r.source] += len(r.text.split())
    sizes = {"a": 12, "b": 24, None: 8}
    assert words == {s: math.floor(t + Fraction(1, 2)) for s, t in targets_by_force(sizes).items()}


def test_near_copies_with_clashing_names(spark):
    from worktrail.llm import overlap

    text = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(2, text, 1, "n"), (1, text + " end", 2, "n"), (3, "other words here now and then", 3, "n"), (None, text, 4, "n")], "doc_id long, text string, gone long, node string")
    assert sorted((r.doc_id or 0, r.gone) for r in overlap.drop_near_copies(frame).collect()) == [(0, 4), (1, 2), (3, 3)]
