"""Language identification by multinomial logistic regression on character n-grams.

Features are hashed runs of one to three characters of the lower-cased text,
everything but letters read as blank, as TF-IDF: the run's share of the text
times its inverse document frequency. Document frequencies cover every
learnable document. The weights are fitted on the driver on a sample bounded
by `sample_docs` (equal shares per language, chosen by hash of the id), with
follow-the-regularised-leader updates under L1 and L2 penalties, which leave
most weights zero; a temperature fitted on a fifth of the sample calibrates the
scores.

A null text, or one without a letter, is `und` with score 0, and so is every
text where there is nothing to learn from. Texts of any length are worked
through in segments. Ids are carried, repeated or null; every input row gives
one output row. Equal scores go to the language that comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
SEGMENT = 1 << 18
SHARES = 1_000_000
# Odd multipliers of the n-gram hash, one per place and length.
_PLACES = [np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64) + np.uint64(2 * i) for i in range(3)]

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def _segments(texts: list[str | None]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Groups of (text number, characters, how many of them start a run here)."""
    numbers, parts, owned, size = [], [], [], 0
    for number, text in enumerate(texts):
        lowered = f" {text.lower()} " if text else ""
        for start in range(0, len(lowered), SEGMENT):
            part = lowered[start:start + SEGMENT + 2]
            numbers.append(number)
            parts.append(part)
            owned.append(min(SEGMENT, len(lowered) - start))
            size += len(part)
            if size >= SEGMENT:
                yield numbers, parts, owned
                numbers, parts, owned, size = [], [], [], 0
    if parts:
        yield numbers, parts, owned


def char_runs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every character run that begins or ends with a letter."""
    letter = letter_table()
    for numbers, parts, owned in _segments(texts):
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letter[codes]
        codes = np.where(is_letter, codes, 32).astype(np.uint64)
        lengths = np.array([len(p) for p in parts])
        text_of = np.repeat(np.array(numbers, dtype=np.int64), lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        own, length = np.repeat(np.array(owned), lengths), np.repeat(lengths, lengths)
        for n in (1, 2, 3):
            end = len(codes) - n + 1
            if end <= 0:
                continue
            mixed = codes[:end] * _PLACES[n - 1][0]
            for k in range(1, n):
                mixed = (mixed ^ (mixed >> np.uint64(29))) * _PLACES[n - 1][k] + codes[k:end + k]
            mixed = (mixed ^ (mixed >> np.uint64(32))) * _PLACES[n - 1][0]
            whole = (is_letter[:end] | is_letter[n - 1:]) & (place[:end] < own[:end]) & (place[:end] + n <= length[:end])
            yield text_of[:end][whole], (mixed[whole] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def sparse_rows(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    keys = [text * BUCKETS + bucket for text, bucket in char_runs(texts)]
    cells, counts = np.unique(np.concatenate(keys) if keys else np.array([], dtype=np.int64), return_counts=True)
    cuts = np.searchsorted(cells, np.arange(len(texts) + 1) * BUCKETS)
    return [(cells[a:b] % BUCKETS, counts[a:b]) for a, b in zip(cuts, cuts[1:])]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, times inverse document frequency
    bias: np.ndarray
    temperature: float


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(rows, labels, n_classes, epochs, alpha, beta, l1, l2, seed):
    """Weights (BUCKETS + 1 x classes; the last row is the bias) by per-coordinate
    follow-the-regularised-leader updates over the rows in a shuffled order."""
    z, n = np.zeros((BUCKETS + 1, n_classes)), np.zeros((BUCKETS + 1, n_classes))

    def weights(at):
        return np.where(np.abs(z[at]) > l1, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            error = _softmax(x @ w)
            error[labels[i]] -= 1
            gradient = x[:, None] * error[None, :]
            squares = n[at]
            z[at] += gradient - (np.sqrt(squares + gradient * gradient) - np.sqrt(squares)) / alpha * w
            n[at] = squares + gradient * gradient
    return weights(np.arange(BUCKETS + 1))


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm.

    One label in n + 2 is taken as wrong, so that a faultless sample doesn't
    ask for certainty.
    """
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    doubt = 1 / (len(labels) + 2)

    def loss(log_t):
        p = np.log(np.maximum(_softmax(logits / np.exp(log_t)), 1e-30))
        right = p[np.arange(len(labels)), labels]
        return -((1 - doubt) * right + doubt * (p.sum(axis=1) - right) / (p.shape[1] - 1)).mean()

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(df: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows; and the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                texts = batch.column(0).slice(start, 64).to_pylist()
                seen = np.zeros((len(texts), BUCKETS), dtype=bool)
                for text, bucket in char_runs(texts):
                    seen[text, bucket] = True
                found += seen.sum(axis=0)
                total += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([*range(BUCKETS), BUCKETS], pa.int32()), pa.array([*found.tolist(), total], pa.int64())], names=["bucket", "n"])

    rows = df.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for row in rows:
        out[row.bucket] = row.n
    return out[:BUCKETS], int(out[BUCKETS])


def fit(
    learnable: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", *, sample_docs: int = 6000,
    epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.0001, seed: int = 7,
) -> LanguageModel | None:
    """Learn from the rows with a language and a text; None without any."""
    known = learnable.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(SHARES, -(-SHARES * sample_docs // (len(languages) * sizes[lang]))))])
    chosen = known.where(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(SHARES)) < share[F.col(lang_col)])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows = sparse_rows(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([b.astype("<i4").tobytes() for b, _ in rows], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in rows], pa.binary())],
                    names=["lang", "place", "buckets", "counts"],
                )

    sample = chosen.select(lang_col, text_col, F.xxhash64(id_col, F.lit(seed + 1)).alias("place")).mapInArrow(features, "lang string, place long, buckets binary, counts binary").collect()
    found, total = document_frequencies(known, text_col)
    idf = np.log((1 + total) / (1 + found)) + 1
    rows, labels = [], []
    for r in sorted(sample, key=lambda r: (r.place, r.lang, r.buckets, r.counts)):
        at, counts = np.frombuffer(r.buckets, "<i4").astype(np.int64), np.frombuffer(r.counts, "<i4")
        if len(at):
            rows.append((np.append(at, BUCKETS), np.append(counts / counts.sum() * idf[at], 1.0)))
            labels.append(languages.index(r.lang))
    labels = np.array(labels, dtype=np.int64)
    apart = len(rows) // 5
    weights = _ftrl(rows[apart:], labels[apart:], len(languages), epochs, alpha, beta, l1, l2, seed)
    logits = np.array([x @ weights[at] for at, x in rows[:apart]]).reshape(apart, len(languages))
    return LanguageModel(languages, weights[:BUCKETS] * idf[:, None], weights[BUCKETS], _temperature(logits, labels[:apart]))


def predict_texts(texts: list[str | None], model: LanguageModel | None) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if model is None or not texts:
        return langs, scores
    sums, totals = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    for text, bucket in char_runs(texts):
        totals += np.bincount(text, minlength=len(texts))
        for c in range(len(model.languages)):
            sums[:, c] += np.bincount(text, weights=model.weights[:, c][bucket], minlength=len(texts))
    p = _softmax((sums / np.maximum(totals, 1)[:, None] + model.bias) / model.temperature)
    best = p.argmax(axis=1)
    for i in np.flatnonzero(totals):
        langs[i], scores[i] = model.languages[best[i]], float(p[i, best[i]])
    return langs, scores


def predict(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score) of every row, with the columns in `carry` besides."""
    kept = [id_col, *(carry or [])]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                langs, scores = predict_texts(part.column(0).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.fieldNames())

    return df.select(F.col(text_col).alias("text to judge"), *kept).mapInArrow(run, schema)


def drop_unknown(df: DataFrame, model: LanguageModel | None, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` whose text is in a known language with at least `least_score`."""
    names = {c: f"own {i}" for i, c in enumerate(df.columns)}
    own = df.select(*[F.col(c).alias(n) for c, n in names.items()])
    judged = predict(own, model, names[id_col], names[text_col], carry=[n for c, n in names.items() if c != id_col])
    judged = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
    return judged.select(*[F.col(n).alias(c) for c, n in names.items()])
