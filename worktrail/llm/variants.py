"""Spelling variants: words one edit apart, grouped under their commonest form.

Every letter is hashed to one of a few symbols. Words one edit apart have
reduced words at most one edit apart, so the one-edit neighbourhood of each
distinct reduced word is generated and joined with the reduced vocabulary;
pairs found so are verified on the original strings. Nothing is missed.

To be a neighbour is mutual: it is enough to generate those that are shorter or
of higher symbols, and each pair comes once. Words are paired where, beside the
reduced words, one exact half agrees, as an edit leaves the start or the end of
a word alone; so words that share a reduced word are not paired all with all.

Defined results: null texts hold no words; a null id counts as empty text;
repeated rows count again; ties of form go to the word that is first in code
point order. Only the named columns are read. Without words nothing returns.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.llm.common import fold_ascii, stored

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"  # fixed value: what a word is made of
FOLDED = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))  # its letters once A-Z are lower-cased
SYMBOLS = "abcdefgh"  # of reduced words


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alter: Callable[[Column, Column], Column] | None = None, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words of whole texts, A-Z lower-cased.

    `alter` maps (id as text, word) to the word that counts.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    words = docs.select(key.alias("id"), F.explode(F.regexp_extract_all(fold_ascii(F.col(text_col)), F.lit(LETTERS), F.lit(0))).alias("word"))
    if alter:
        words = words.select(alter(F.col("id"), F.col("word")).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def reduced(word: Column, symbols: str = SYMBOLS) -> Column:
    """Each letter as the symbol it is hashed to."""
    return F.translate(word, FOLDED, "".join(symbols[zlib.crc32(c.encode()) % len(symbols)] for c in FOLDED))


def _strings(rows: np.ndarray) -> pa.Array:
    """Rows of ASCII codes, all of one length, as strings."""
    n, size = rows.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(rows)))


def half_neighbourhood(letters: np.ndarray, symbols: str = SYMBOLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of words of one length (rows of codes): themselves, all distinct words one
    deletion away, and those one replacement by a higher symbol away.

    Returns pairs (row numbers, neighbours).
    """
    n, size = letters.shape
    out = [(np.arange(n), letters)]
    for i in range(size):
        # Letters of a run give the same word: the first one stands for all.
        of = np.flatnonzero(letters[:, i] != letters[:, i - 1]) if i else np.arange(n)
        if size > 1:
            out.append((of, np.delete(letters[of], i, axis=1)))
        for symbol in symbols.encode():
            of = np.flatnonzero(letters[:, i] < symbol)
            changed = letters[of]
            changed[:, i] = symbol
            out.append((of, changed))
    return out


def _neighbours(symbols: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array(batch.column(0).to_pylist(), dtype=bytes)
            sizes = np.char.str_len(words) if len(words) else words
            for size in np.unique(sizes):
                same = words[sizes == size].astype(f"S{size}")
                letters = same.view(np.uint8).reshape(len(same), int(size))
                whole = _strings(letters)
                for of, found in half_neighbourhood(letters, symbols):
                    yield pa.RecordBatch.from_arrays([whole.take(pa.array(of)), _strings(found)], names=["r", "r2"])

    return run


def _halves(length: Column) -> Column:
    """The starts and ends that a word shares with another, `length` being that of the shorter."""
    half = F.floor(length / 2).cast("int")
    return F.array(F.concat(length, F.lit("<"), F.substring(F.col("word"), F.lit(1), half)), F.concat(length, F.lit(">"), F.right(F.col("word"), half)))


def near_pairs(words: DataFrame, symbols: str = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): words one edit apart, each pair both ways round."""
    vocabulary = stored(words.select("word", "n", reduced(F.col("word"), symbols).alias("r")))
    size = F.char_length("word")
    around = vocabulary.select("r").distinct().mapInArrow(_neighbours(symbols), "r string, r2 string")
    # The second word is as long as the first or one shorter.
    first = vocabulary.select("r", "word", "n", F.explode(F.concat(_halves(size), _halves(size - 1))).alias("key"))
    second = vocabulary.select(F.col("r").alias("r2"), F.col("word").alias("near"), F.col("n").alias("near_n"), _halves(size).alias("keys"))
    # Spark sizes neighbourhoods and exploded keys as if each row gave one; by that it would broadcast them.
    met = around.join(second.hint("merge"), "r2").select("r", "r2", "near", "near_n", F.posexplode("keys").alias("side", "key"))
    pairs = first.join(met.hint("merge"), ["r", "key"])
    half = F.floor(F.char_length("near") / 2).cast("int")
    once = (F.col("side") == 0) | (F.substring("word", F.lit(1), half) != F.substring("near", F.lit(1), half))
    found = pairs.where(once & ((F.col("r") != F.col("r2")) | (F.col("word") < F.col("near"))) & (F.levenshtein("word", "near", 1) == 1))
    ends = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return found.select(F.inline(ends))


def forms(words: DataFrame, times: int = 2, symbols: str = SYMBOLS) -> DataFrame:
    """(word, n, n_near, form, form_n): the commonest near word where it is `times` as frequent."""
    near = near_pairs(words, symbols)
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("best")
    ).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.rank")).alias("form_n"))
    joined = words.join(best, "word", "left").na.fill(0, ["n_near"])
    sure = F.col("form_n") >= times * F.col("n")
    return joined.withColumns({"form": F.when(sure, F.col("form")), "form_n": F.when(sure, F.col("form_n"))})


def with_roots(table: DataFrame) -> DataFrame:
    """Add `root`: the end of the chain of forms, the word itself without one.

    A form is more frequent than its word, so chains end; distances double
    with each round. Stored words are several times their files' size in memory:
    they are merged, not broadcast.
    """
    hops = stored(table.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(hops.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        hops = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return table.join(hops.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alter: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts."""
    words = stored(word_counts(docs, id_col, text_col, alter))
    return with_roots(stored(forms(words))).select("word", "form", "root", "n", "n_near", "form_n")
