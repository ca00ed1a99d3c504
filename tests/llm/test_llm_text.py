"""Byte-level BPE, language ID, quality: round trips, held-out accuracy, odd inputs."""

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from worktrail.llm import bpe, langid, quality

SF = "/root/testdata/sf0.001"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", " ", "  ", "   a", "a   ", "a \n b", "a\n\n b", "a \n", " \n ", "a  b", "  x 　 y", "don't we'll I'M", "x" * 5000, "ab " * 4000, "<|endoftext|> <|x|>",
    "naïve café 日本語 🙂🙃👨‍👩‍👧 é", "\x00\x01 \x1c \x85 z", "1234567 12.5% $$$ ***", "tab\there\r\n\r\n  line", "a  b   c    d", "�\U0010ffff", " lead", "trail ",
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "ids", b"x", 3.0) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded binary, score double")


@pytest.mark.parametrize("pieces", [1_000_000, 3])
def test_encode_like_the_rank_library(spark, reference, monkeypatch, pieces):
    monkeypatch.setattr(bpe, "CACHE_PIECES", pieces)
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(ODD, JSON)] == [reference.encode_ordinary(t or "") for t in ODD]


def test_round_trip(spark, reference):
    encoded = bpe.encode(frame(spark, ODD), JSON)
    got = {r.doc_id: r for r in bpe.decode(encoded, RANKS).collect()}
    for i, text in enumerate(ODD):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == reference.encode_ordinary(text or "")
        assert bytes(got[i].decoded) == (text or "").encode()
    assert sorted(map(tuple, bpe.round_trip(frame(spark, ODD), JSON, RANKS).collect())) == sorted(map(tuple, got.values()))
    assert bpe.encode(frame(spark, []), JSON).collect() == [] and bpe.round_trip(frame(spark, []), JSON, RANKS).collect() == []


def test_offsets_cover_split_characters(spark, reference):
    rows = bpe.encode(frame(spark, ODD), JSON, rank_path=RANKS).collect()
    for r in rows:
        text = ODD[r.doc_id] or ""
        at = 0
        for token, start, end in zip(np.frombuffer(r.ids, "<u4").tolist(), r.starts, r.ends):
            raw = reference.decode_single_token_bytes(token)
            first = len(text.encode()[:at].decode(errors="ignore"))
            assert start == first and raw in text[start:end].encode()
            at += len(raw)
        assert len(r.starts) == len(r.ids) // 4


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_char_runs_do_not_depend_on_segments(monkeypatch, size):
    monkeypatch.setattr(langid, "SEGMENT", size)
    texts = ["Straße", None, "", "a1b2  c", "x" * 50, "12 !", "Ünï çø"]
    got = [{} for _ in texts]
    for text, bucket in langid.char_runs(texts):
        for t, b in zip(text.tolist(), bucket.tolist()):
            got[t][b] = got[t].get(b, 0) + 1
    assert [sum(g.values()) for g in got][1:3] == [0, 0] and not got[5]
    assert sum(got[0].values()) == 6 + 7 + 6  # of one, two and three characters; blanks around the word
    monkeypatch.setattr(langid, "SEGMENT", 1 << 20)
    assert [dict(zip(b.tolist(), c.tolist())) for b, c in langid.sparse_rows(texts)] == got


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(F.col("doc_id") % 2 == 0), sample_docs=400)
    right = langid.predict(docs.where(F.col("doc_id") % 2 == 1), model).join(docs, "doc_id").where("lang = lang_pred").count()
    assert right >= 0.98 * 500
    assert (model.weights == 0).mean() > 0.3  # the L1 penalty leaves weights out


def test_language_odd_rows(spark):
    rows = [(1, "the and of", "en"), (2, "der die und", "de"), (3, None, "en"), (4, "", "en"), (5, "123 !", None), (None, "the", None), (1, "the and of", "en"), (6, "y" * 100_000, None)]
    docs = spark.createDataFrame([(*r, 0.5, "p") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    model = langid.fit(docs)
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()]
    assert sorted(got, key=repr) == sorted([(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (6, got[7][1])], key=repr)
    assert langid.fit(docs.where("false")) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    kept = langid.drop_unknown(docs, model, 0.0)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 1, 2, 6, None]


def test_language_scores_are_calibrated():
    logits = np.array([[3.0, 0.0]] * 100)
    labels = np.array([0] * 80 + [1] * 20)  # right in four of five
    t = langid._temperature(logits, labels)
    assert abs(1 / (1 + np.exp(-3 / t)) - 0.8) < 0.02


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit_trees(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.97

    def walk(row):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stats = quality.document_statistics(docs)
    model = quality.fit(stats, labels.where("doc_id % 2 = 0"))
    rows = quality.score(stats, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) > 0.95


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", 1), (2, None, 2), (3, "", 3), (None, "!!! !!!", 4), (1, "a b c", 5), (4, "w " * 50_000, 6)], "doc_id long, text string, stats int")
    stats = quality.document_statistics(docs)
    assert all(len(r.stats) == len(quality.STATISTICS) and np.isfinite(r.stats).all() for r in stats.collect())
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    scores = [r.score for r in quality.score(stats, quality.fit(stats, labels)).collect()]
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    assert quality.fit(stats, labels.where("false")) is None
    assert {r.score for r in quality.score(stats, None).collect()} == {0.5}
    assert quality.score(stats.where("false"), None).collect() == []
