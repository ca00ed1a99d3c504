"""SimHash near-duplicates by multi-index hashing.

Each text's 64-bit fingerprint is taken over its word shingles. Distinct
fingerprints are cut into two halves of 32 bits: where two differ in at most
three bits, one half differs in at most one. Each half is a key of the index,
and is looked up with its Hamming ball of radius one. Of two halves that
differ in one bit just one has it set, so a look-up clears set bits only and
finds each pair from one side. Complete distances are verified within the
join, so only true links leave it.

Links between distinct fingerprints are reduced to components by alternating
large and small stars; copies of a text share a fingerprint and are never
paired. A hot fingerprint is one row until the result is joined back.

Null or wordless texts have fingerprint zero and are linked like any other.
Ids may repeat; null ids are never a component's id unless it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktrail.llm.common import stored

SHINGLE = 3
SEED = 42
MOST_SHINGLES = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 of the text's word shingles, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (np.concatenate(([0], ends[:-1] + 1))[:len(words) - shingle + 1]).tolist()
    ends = ends[shingle - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), MOST_SHINGLES):
        h = [digest(joined[a:b], SEED) for a, b in zip(starts[at:at + MOST_SHINGLES], ends[at:at + MOST_SHINGLES])]
        bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((2 * ones > len(starts)) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint long) of every row; a null or wordless text has fingerprint zero."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = np.array([fingerprint(text, shingle) for text in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=[id_col, "fingerprint"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def hex_digits(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def links(distinct: DataFrame, most_bits: int = 3) -> DataFrame:
    """(a, b) fingerprints that differ in 1 to `most_bits` (at most 3) bits, each pair once."""
    if not 0 <= most_bits <= 3:
        raise ValueError("two halves and radius one reach three bits")
    halves = F.array(F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fingerprint", 32).bitwiseOR(F.lit(1 << 32)))
    index = distinct.select(F.col("fingerprint").alias("b"), F.explode(halves).alias("key"))
    bits = F.array(*[F.lit(i) for i in range(32)])
    lookups = distinct.select(F.col("fingerprint").alias("a"), F.explode(halves).alias("half")).select(
        "a", F.explode(F.concat(
            F.array(F.struct(F.col("half").alias("key"), F.lit(True).alias("same"))),
            F.transform(
                F.filter(bits, lambda i: F.getbit("half", i) == 1),
                lambda i: F.struct((F.col("half") - F.call_function("shiftleft", F.lit(1).cast("long"), i)).alias("key"), F.lit(False).alias("same")),
            ),
        )).alias("lookup"),
    ).select("a", "lookup.key", "lookup.same")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, most_bits)
    found = lookups.join(index, "key").where(near & (~F.col("same") | (F.col("a") < F.col("b"))))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def connected(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node in `pairs` (a, b); root is the component's smallest node.

    Large stars move the larger neighbours of a node to its smallest, small
    stars the smaller ones, until nothing moves: a logarithmic number of rounds
    in practice, each written to the checkpoint folder.
    """
    edges = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(edges)
        if after == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        before = after


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most_bits: int = 3) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: the smallest id reachable) of every row."""
    rows = stored(fingerprints(df, id_col, text_col, shingle))
    distinct = stored(rows.groupBy("fingerprint").agg(F.min(id_col).alias("least_id")))
    members = stored(connected(links(distinct, most_bits)).withColumnRenamed("node", "fingerprint").join(distinct, "fingerprint"))
    component = members.groupBy("root").agg(F.min("least_id").alias("of_component"))
    linked = members.join(component, "root").select("fingerprint", "of_component")
    ids = distinct.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("of_component", "least_id").alias("component_id"))
    return rows.join(ids, "fingerprint").select(id_col, hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most_bits: int = 3) -> DataFrame:
    """The rows of `df`, but of each component only those of its smallest id.

    Rows with a null id stay; rows that share an id stay or go together.
    """
    gone = near_groups(df, id_col, text_col, shingle, most_bits).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone")).distinct()
    return df.join(gone, F.col(id_col) == F.col("gone"), "left_anti").select(*df.columns)
