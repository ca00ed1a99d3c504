"""Exact dedup, repeated passages, SimHash: small cases and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from worktrail.llm import exact_dedup, simhash, substring

DOCS = "doc_id long, text string, id string, h long, part int, keep_id string, norm string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", "z") for i, t in rows], DOCS)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_share", [4096, 3])
def test_exact_groups(spark, monkeypatch, hot_share):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", hot_share)
    rows = [(1, "Ab"), (2, "aB"), (3, "ÄB"), (4, "äB"), (5, "äb"), (6, None), (7, ""), (None, "ab"), (None, "only"), (8, "q " * 40_000), (9, "Q " * 40_000)]
    rows += [(100 + i, "Hot copy") for i in range(60)] + [(2, "aB"), (300, " ab")]
    got = exact_dedup.exact_groups(frame(spark, rows))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected_groups(rows)


@pytest.mark.parametrize("hot_share", [4096, 3])
def test_drop_copies_keeps_one_row_of_each_text(spark, monkeypatch, hot_share):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", hot_share)
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (None, "ab"), (None, "z"), (2, "AB")] + [(100 + i, "Hot") for i in range(40)]
    kept = exact_dedup.drop_copies(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    got = [(r.doc_id, low(r.text)) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted([(2, "ab"), (4, ""), (None, "z"), (139, "hot")], key=repr)


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).collect() == []
    assert exact_dedup.drop_copies(frame(spark, [])).collect() == []


def cut_by_force(rows, window):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p:p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p:p + window])] < i:
                    gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, gram, vocabulary", [(5, 3, 3), (8, 8, 2), (7, 1, 5), (50, 20, 400)])
def test_remove_repeats_like_brute_force(spark, window, gram, vocabulary):
    rng = random.Random(window)
    texts = [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(0, 150))) for _ in range(40)]
    for _ in range(30):  # passages of other texts, between other words
        a, b = rng.choice(texts).split(), rng.choice(texts).split()
        at = rng.randrange(len(b) + 1)
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(b[:at] + a[:rng.randrange(len(a) + 1)] + b[at:]))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[9]), (3, texts[3]), (None, texts[0]), (500, None), (501, ""), (502, " é " * 30), (503, " é " * 300)]
    rng.shuffle(rows)
    got = substring.remove_repeats(frame(spark, rows), window=window, gram=gram).select("doc_id", "n_words", "n_removed", "kept_text", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == cut_by_force(rows, window)


def test_remove_repeats_of_nothing(spark):
    assert substring.remove_repeats(frame(spark, [])).collect() == []


def test_intervals_are_maximal():
    assert substring.intervals(np.array([7, 1, 2, 4, 20]), 3) == [(1, 10), (20, 23)]
    assert substring.intervals(np.array([]), 3) == []


def test_anchor_depends_on_the_window_alone():
    words = substring.word_hashes(" ".join(f"a{i * i % 17}" for i in range(200)))
    anchors, windows = substring.window_anchors(words, 10, 4), substring.rolling(words, 10)
    assert len(anchors) == len(windows) == 191
    for p in range(191):
        assert anchors[p] == substring.rolling(words[p:p + 10], 4).min()
        assert windows[p] == substring.rolling(words[p:p + 10], 10)[0]


def fingerprint_by_force(text):
    w = WORD.findall(low(text))
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_force(rows):
    fp = [fingerprint_by_force(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(fp[a] ^ fp[b]).count("1") <= 3 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        out.append((i, format(fp[k], "016x"), min(ids, default=None)))
    return sorted(out, key=repr)


def test_near_groups_like_brute_force(spark):
    rng = random.Random(5)
    base = [f"Wört{rng.randrange(900)}" for _ in range(300)]
    texts = [None, "", " \t", "One", "one two", "ONE TWO", "one two three", "a b a b a b a b"]
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(300)] = "new"
        texts.append(" ".join(copy))
    texts += [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)] + [(None, texts[10]), (4, texts[10]), (None, "nowhere else")]
    got = simhash.near_groups(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == components_by_force(rows)


def test_links_find_each_pair_once(spark):
    rng = random.Random(6)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(6):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fingerprint long")).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_connected_chain_and_star(spark):
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r.node: r.root for r in simhash.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


def test_near_groups_of_nothing(spark):
    assert simhash.near_groups(frame(spark, [])).collect() == []
    rows = [(1, "a b c"), (2, "A b C"), (None, "a b c"), (3, "d")]
    left = simhash.drop_near_copies(frame(spark, rows)).select("doc_id").collect()
    assert sorted((r.doc_id for r in left), key=repr) == [1, 3, None]
    assert frame(spark, rows).where(F.col("doc_id") > 9).transform(simhash.drop_near_copies).collect() == []
