"""Document quality by histogram gradient-boosted trees over text statistics.

Statistics of each whole text are computed once, in tasks. The trees are
fitted on the driver on labelled rows bounded by `sample_rows`, chosen by hash
of the id; every statistic is cut into at most `bins` intervals and splits are
found from gradient histograms. Trees are kept as flat arrays and walked for
all rows of a batch at once.

Null and empty texts have all statistics zero and are scored like any other.
Rows without a label (null) are not learned from; repeated labels of an id
each count. Without labels every score is 0.5; with one class it is near it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARES = 1_000_000
STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "lower", "digit", "symbol", "bar", "exclamation", "newline", "beyond_ascii",
    "distinct_words", "commonest_word", "distinct_pairs", "commonest_pair", "distinct_lines", "words_per_line", "symbol_ends", "upper_words", "stutter",
)

_CLASSES = np.zeros((256, 8))
for _byte in range(256):
    _char = chr(_byte)
    _CLASSES[_byte] = [
        "A" <= _char <= "Z", "a" <= _char <= "z", "0" <= _char <= "9", 32 < _byte < 127 and not _char.isalnum(), _char == "|", _char == "!", _char == "\n", _byte > 127,
    ]
_SYMBOLS = frozenset(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:?'\")")


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS of one text."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    lengths = np.array([*map(len, words)])
    classes = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _CLASSES / len(raw)
    counts, pairs = Counter(words), Counter(zip(words, words[1:]))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    n, n_pairs = len(words), max(1, len(words) - 1)
    return [
        float(np.log1p(len(raw))), float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), *classes.tolist(),
        len(counts) / n, max(counts.values()) / n, len(pairs) / n_pairs, max(pairs.values(), default=0) / n_pairs,
        len(set(lines)) / len(lines), n / len(lines),
        sum(w[-1] in _SYMBOLS for w in words) / n, sum(map(bytes.isupper, words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n_pairs,
    ]


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array) of every row."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                stats = pa.array([statistics(text) for text in part.column(1).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), stats], names=[id_col, "stats"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


@dataclass
class Trees:
    """Complete trees of one depth: inner nodes breadth first, then leaves."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; go right where above
    value: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least_weight: float = 1.0) -> Trees:
    """Boost logistic loss on rows `x` with labels `y` (0 or 1)."""
    rows, features = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if rows else np.array([0.0]) for f in range(features)]
    cut = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(features)], axis=1) if rows else np.zeros((0, features), dtype=np.int64)
    share = (y.sum() + 1) / (rows + 2)
    model = Trees(np.zeros((trees, 2**depth - 1), dtype=np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)), float(np.log(share / (1 - share))))
    raw = np.full(rows, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight, node = p - y, p * (1 - p), np.zeros(rows, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            gain, best_feature, best_cut = np.zeros(width), np.zeros(width, dtype=np.int64), np.full(width, -1)
            for f in range(features):
                cell = (node - first) * bins + cut[:, f]
                g = np.bincount(cell, gradient, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(cell, weight, width * bins).reshape(width, bins).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gains = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
                gains[(h < least_weight) | (all_h - h < least_weight)] = 0
                gains[:, len(edges[f]):] = 0
                at = gains.argmax(axis=1)
                better = gains[np.arange(width), at] > gain + 1e-12
                gain[better], best_feature[better], best_cut[better] = gains[np.arange(width), at][better], f, at[better]
            for k in range(width):
                if best_cut[k] >= 0:
                    model.feature[t, first + k], model.threshold[t, first + k] = best_feature[k], edges[best_feature[k]][best_cut[k]]
            here = node
            node = 2 * here + 1 + (x[np.arange(rows), model.feature[t, here]] > model.threshold[t, here])
        leaf = node - (2**depth - 1)
        model.value[t] = -rate * np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, weight, 2**depth) + l2)
        raw += model.value[t, leaf]
    return model


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = 20_000, seed: int = 11, **options) -> Trees | None:
    """Trees from the statistics (id, stats) of labelled rows; None without any."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("label"))
    total = known.count()
    if not total:
        return None
    share = min(SHARES, -(-SHARES * sample_rows // total))
    chosen = known.where(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(SHARES)) < share)
    rows = chosen.join(stats, id_col).select(id_col, "label", "stats").collect()
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    return fit_trees(np.array([r[2] for r in rows], dtype=np.float64), np.array([r[1] for r in rows], dtype=np.float64), **options)


def score(stats: DataFrame, model: Trees | None, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every row of (id, stats)."""
    schema = T.StructType([T.StructField(id_col, stats.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            found = np.full(batch.num_rows, 0.5) if model is None else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=[id_col, "score"])

    return stats.select(id_col, "stats").mapInArrow(run, schema)
