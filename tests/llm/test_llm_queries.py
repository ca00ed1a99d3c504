"""The registered corpus queries on the smallest tables, and the pipeline's stages."""

import base64
import hashlib

import check_oracle
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_llm_dedup import components_by_force, expected_groups, low

import __spark_entry__ as entry
import corpus_pipeline
from worktrail.llm import langid, queries
from worktrail.llm.common import stored, table

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5_exact_topk": ["query_id", "rank", "vec_id", "score"],
    "op6_source_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_quality": ["doc_id", "held_out", "score", "predicted"],
    "op8_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op9_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10_simhash": ["doc_id", "fingerprint", "component_id"],
    "op11_conversation_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op12_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    "op13_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
}


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def tokens(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary_batch(text)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_like_sql(spark, name):
    ok, message = check_oracle.compare(spark, check_oracle.connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, message


def test_all_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == COLUMNS[name]


def test_op9_like_the_rank_library(spark, documents):
    got = {r.doc_id: r for r in queries.op9_byte_bpe(spark, SF).collect()}
    assert len(got) == len(documents)
    for (i, text), ids in zip(documents, tokens([t or "" for _, t in documents])):
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_op10_like_brute_force(spark, documents):
    assert sorted(map(tuple, queries.op10_simhash(spark, SF).collect()), key=repr) == components_by_force(documents)


@pytest.mark.parametrize("name, labels, answer, predicted", [
    ("op2_language_id", "documents", "lang", "lang_pred"), ("op7_quality", "labels", "quality", "predicted"),
])
def test_held_out_accuracy(spark, name, labels, answer, predicted):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES[name](spark, sf).join(table(spark, sf, labels).select("doc_id", answer), "doc_id").where(f"held_out and {answer} is not null").collect()
    assert np.mean([r[answer] == r[predicted] for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("languages", [2, 12])
def test_language_stage_keeps_clean_texts(spark, languages):
    """Whatever the number of languages, texts of a known one stay, short ones too."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n, i: "".join(letters[(2 * n + i * k) % 26] for k in range(4))
    rows = [(n * 100 + i, " ".join(word(n, i + j) for j in range(1 + i % 12)), f"l{n:02d}", "s", 0) for n in range(languages) for i in range(40)]
    docs = spark.createDataFrame(rows + [(9001, "12 34", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars int")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()}
    assert 9001 not in kept and len(kept) >= 0.97 * len(rows)


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents").limit(150)
    docs = stored(docs.union(spark.createDataFrame([(9001, "123 456", None, "s", 7), (9002, None, None, None, None)], docs.schema)).union(docs.limit(3).selectExpr("doc_id + 5000", "upper(text)", "lang", "source", "length(upper(text))")))
    columns, (names, stages) = docs.columns, zip(*corpus_pipeline.STAGES)
    kept = stored(stages[0](spark, docs, SF))
    model = langid.fit(docs)
    judged = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    least = corpus_pipeline.LEAST_OVER_CHANCE / len(model.languages)
    want = {i for i, r in judged.items() if r.lang_pred != "und" and r.score >= least}
    assert {r.doc_id for r in kept.collect()} == want and want.isdisjoint({9001, 9002}) and kept.columns == columns

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    single = stored(stages[1](spark, kept, SF))
    assert {r.doc_id for r in single.collect()} == {i for i, _, _, stays, _ in expected_groups(rows) if stays} and single.columns == columns

    rows = [(r.doc_id, r.text) for r in single.collect()]
    assert len({low(t) for _, t in rows}) == len(rows)
    apart = stored(stages[2](spark, single, SF))
    assert {r.doc_id for r in apart.collect()} <= {r.doc_id for r in single.collect()} and apart.columns == columns

    sizes, source_of = {}, {}
    for r in apart.collect():
        sizes[r.source], source_of[r.doc_id] = sizes.get(r.source, 0) + len(r.text.split()), r.source
    mixed = stored(stages[3](spark, apart, SF))
    got = {}
    for r in mixed.collect():
        assert r.source == source_of[r.doc_id] and r.n_chars == len(r.text)
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    from test_llm_rows import targets_by_force

    assert mixed.columns == columns and all(abs(got.get(s, 0) - t) <= 0.5 for s, t in targets_by_force(sizes).items())

    encoded = stages[4](spark, mixed, SF).collect()
    texts = {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()): r.text for r in mixed.collect()}
    assert len(encoded) == mixed.count()
    for r, ids in zip(encoded, tokens([texts[r.doc_id, r.decoded_sha256] for r in encoded])):
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)


def test_pipeline_of_nothing(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        assert docs.count() == 0


def test_pipeline_runs_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 150
