"""Removal of word passages that an earlier document has too.

Every window of `window` words gets a Rabin-Karp hash (96 bits of two rolling
polynomials over 64-bit word hashes). A window whose hash also starts in a
document with a smaller id is removed; overlapping windows merge into maximal
intervals.

Most windows occur once, and moving a row for each would cost several times
the text. So each window first gets an anchor: the least hash of its
`gram`-word runs, the same for equal windows wherever they stand. Anchors
change once in about a dozen words. Windows below an anchor that only one text
holds can't repeat; all others are counted in Spark, by an aggregate and a
join that splits hot keys. Of equal texts only the one with the smallest id
takes part: all windows of the others are in it. The text is dealt by id once,
and that exchange serves both the windows and the result.

Null texts have no words. Rows with a null id neither lose nor claim words.
Rows that repeat an id are judged each by its own text, and don't count as
smaller than each other. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktrail.llm.common import stored

WINDOW = 50
GRAM = 25

# Odd bases of the two rolling polynomials, and their inverses modulo 2^64.
_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
_powers: dict[int, list[np.ndarray]] = {}


def _power(base: int, count: int) -> list[np.ndarray]:
    """Powers of `base` and of its inverse, at least `count` of each."""
    if base not in _powers or len(_powers[base][0]) < count:
        size = max(4096, 2 * count)
        _powers[base] = []
        for factor in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, factor, dtype=np.uint64)
            table[0] = 1
            _powers[base].append(np.cumprod(table))
    return _powers[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array([*map(xxh3_64_intdigest, (text or "").encode().split())], dtype=np.uint64)


def rolling(words: np.ndarray, length: int, base: int = _BASES[0]) -> np.ndarray:
    """Rabin-Karp hash of every run of `length` words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.array([], dtype=np.uint64)
    power, inverse = _power(base, len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * power[:len(words)], out=sums[1:])
    return _mixed((sums[length:] - sums[:n]) * inverse[:n])


def window_anchors(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The least gram hash within each window."""
    least, reach, span = rolling(words, gram), 1, window - gram + 1
    if len(least) < span:
        return np.array([], dtype=np.uint64)
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[:len(least) - (span - reach)], least[span - reach:]) if span > reach else least


def anchors(df: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, own) for the distinct anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [np.unique(window_anchors(word_hashes(text), window, gram)) for text in part.column(1).to_pylist()]
                rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), part.column(0).take(pa.array(rows))], names=["anchor", "own"])

    return df.select("own", "text").mapInArrow(run, "anchor long, own long")


def _windows(df: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, own, pos, h, g) of each window below one of its document's shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                at, first, second = [], [], []
                for text, shared in zip(part.column(2).to_pylist(), part.column(3)):
                    words = word_hashes(text)
                    wanted = np.isin(window_anchors(words, window, gram), shared.values.to_numpy(zero_copy_only=False).view(np.uint64))
                    at.append(np.flatnonzero(wanted))
                    first.append(rolling(words, window)[wanted])
                    second.append(rolling(words, window, _BASES[1])[wanted])
                rows = pa.array(np.repeat(np.arange(len(at)), [len(x) for x in at]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(at).astype(np.int32)),
                        pa.array(np.concatenate(first).view(np.int64)), pa.array((np.concatenate(second) >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    ],
                    names=["id", "own", "pos", "h", "g"],
                )

    schema = T.StructType([
        T.StructField("id", df.schema["id"].dataType), T.StructField("own", T.LongType()), T.StructField("pos", T.IntegerType()),
        T.StructField("h", T.LongType()), T.StructField("g", T.IntegerType()),
    ])
    return df.select("id", "own", "text", "shared").mapInArrow(run, schema)


def intervals(positions: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal word intervals (first, past the last) that windows at `positions` cover."""
    if not len(positions):
        return []
    starts = np.sort(positions)
    fresh = np.r_[True, starts[1:] > starts[:-1] + window]
    ends = np.r_[starts[:-1][fresh[1:]], starts[-1]] + window
    return list(zip(starts[fresh].tolist(), ends.tolist()))


def _cut(df: DataFrame, window: int) -> DataFrame:
    """(id, n_words, n_removed, spans, kept_text, kept_sha256) of rows (id, text, positions, copy)."""
    schema = T.StructType([
        T.StructField("id", df.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                out = []
                for text, positions, copy in zip(part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist()):
                    words = (text or "").encode().split()
                    if copy:
                        spans = [(0, len(words))] if len(words) >= window else []
                    else:
                        spans = intervals(positions.values.to_numpy(zero_copy_only=False), window) if positions.is_valid else []
                    kept, last = [], 0
                    for a, b in spans:
                        kept += words[last:a]
                        last = b
                    kept += words[last:]
                    joined = b" ".join(kept)
                    out.append((len(words), len(words) - len(kept), spans, joined.decode(), hashlib.sha256(joined).hexdigest()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, t) for x, t in zip(map(list, zip(*out)), (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.string(), pa.string())))],
                    names=schema.fieldNames(),
                )

    return df.select("id", "text", "positions", "copy").mapInArrow(run, schema)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: id, n_words, n_removed, spans (removed word
    intervals), kept_text (words joined by one space), kept_sha256."""
    if not 1 <= gram <= window:
        raise ValueError("grams must fit in the window")
    # an alias that renames nothing would hinder the reuse of the exchange
    rows = df.select(*[F.col(c) if c == name else F.col(c).alias(name) for c, name in ((id_col, "id"), (text_col, "text"))])
    known = rows.where(F.col("id").isNotNull())
    texts = known.select("id", "text", F.xxhash64("text").alias("own"))
    ids = stored(texts.select("id", "own", F.xxhash64("text", F.lit(1)).alias("own2")))
    least = ids.groupBy("own", "own2").agg(F.min("id").alias("least"))
    copies = ids.join(least, ["own", "own2"]).where("id > least").select("id", "own").distinct()

    held = stored(anchors(texts, window, gram))
    shared = held.groupBy("anchor").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a < b")
    lists = held.join(shared, "anchor", "left_semi").groupBy("own").agg(F.collect_set("anchor").alias("shared"))
    lists = lists.join(least, "own").groupBy(F.col("least").alias("id")).agg(F.collect_list(F.struct("own", "shared")).alias("of_texts"))
    lists = stored(lists)
    dealt = known.repartition("id")
    of_text = F.get(F.filter("of_texts", lambda x: x["own"] == F.xxhash64("text")), F.lit(0))
    listed = dealt.join(lists, "id").select("id", "text", F.xxhash64("text").alias("own"), of_text["shared"].alias("shared"))
    windows = _windows(listed.where("shared is not null"), window, gram)
    firsts = windows.groupBy("h", "g").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    # Keys apart from the aggregate's, so that the join gets exchanges of its own and can split a hot passage.
    key = F.bitwise_not("h")
    firsts = firsts.select(key.alias("key"), F.col("g").alias("check"), "first")
    removed = windows.join(firsts, (key == F.col("key")) & (F.col("g") == F.col("check")) & (F.col("id") > F.col("first")))
    positions = removed.groupBy("id", "own").agg(F.collect_set("pos").alias("positions")).withColumn("copy", F.lit(False))
    positions = positions.unionByName(copies.select("id", "own", F.array().cast("array<int>").alias("positions"), F.lit(True).alias("copy")))
    by_id = positions.groupBy("id").agg(F.collect_list(F.struct("own", "positions", "copy")).alias("of_texts"))
    judged = dealt.join(by_id, "id", "left").select("id", "text", of_text["positions"].alias("positions"), of_text["copy"].alias("copy"))
    unknown = rows.where(F.col("id").isNull()).select("id", "text", F.lit(None).cast("array<int>").alias("positions"), F.lit(None).cast("boolean").alias("copy"))
    return _cut(judged.union(unknown), window).withColumnRenamed("id", id_col)
