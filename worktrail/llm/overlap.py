"""Near-duplicates by SimHash and shingle overlap: Jaccard similarity of 4/5 and more.

Texts are sets of word shingles; equal sets are one node. First the nodes are
grouped by SimHash (`simhash.links`: at most three differing bits, multi-index
hashing), and each is verified against the least node of its group. SimHash
reaches the closest copies only, so more candidates are those that share one
of 48 bands of four min-hashes: of two sets that just reach the similarity, one
pair in 10^11 shares none. Each node also has the parities of its shingles in
1,024 cells: every odd cell of two nodes holds a shingle that only one has, so
pairs with too many can't be similar. Those that are left are verified on
their complete sets before they count as links.

Groups are components of the links of both. Large groups are not paired up: two
more rounds compare each node with one node of its band's bucket, and only nodes
that are then in different components of a bucket are compared in pairs.

Wordless texts are equal to each other; a text of up to five words is one
shingle. Ids may repeat; null ids are never a component's id unless it has no
other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktrail.llm.common import stored
from worktrail.llm.simhash import connected, fingerprint
from worktrail.llm.simhash import links as simhash_links

SHINGLE = 5
SEED = 42
BANDS, ROWS = 48, 4
CELLS = 1024
PARITIES = [f"p{i}" for i in range(CELLS // 64)]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the text's word shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0] + [e + 1 for e in ends[:-1]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])], dtype=np.uint64))


def node_of(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.astype("<u8").tobytes(), SEED)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 31, (BANDS * ROWS, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, (BANDS * ROWS, 1)).astype(np.uint32)


def band_keys(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key per band: equal where all its min-hashes are."""
    x, least = (found ^ (found >> np.uint64(32))).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 512):
        least = np.minimum(least, (x[None, at:at + 512] * a + b).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    odd = np.bincount((found >> np.uint64(54)).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def signatures(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, text_hash, node, fingerprint, n shingles, band keys, parities) of every row."""
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("node", T.BinaryType()),
        T.StructField("fingerprint", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), *[T.StructField(p, T.LongType()) for p in PARITIES],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                nodes, prints, sizes, keys, odd = [], [], [], [], []
                for text in part.column(2).to_pylist():
                    found = shingle_set(text, shingle)
                    nodes.append(node_of(found))
                    prints.append(fingerprint(text, shingle))
                    sizes.append(len(found))
                    keys.append(band_keys(found, a, b))
                    odd.append(parities(found))
                offsets = pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS)
                bands = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys)))
                columns = [pa.array(c) for c in np.array(odd).T.copy()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), bands, *columns], names=schema.names)

    return df.select(id_col, F.xxhash64(text_col), text_col).mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, its shingles as 8 bytes each) of one column of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                found = [shingle_set(text, shingle) for text in batch.column(0).slice(start, 100).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(f) for f in found], pa.binary()), pa.array([f.astype("<u8").tobytes() for f in found], pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(run, "node binary, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets share 4/5 and more of their union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                s, t = (np.frombuffer(c[i].as_buffer(), "<u8") for c in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(5 * both >= 4 * (len(s) + len(t) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of = lambda side, name: sets.select(F.col("node").alias(side), F.col("shingles").alias(name))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _alike(a: str, b: str) -> Column:
    """False only for nodes under the similarity: with `d` shingles in one set alone, 4/5 means n + n >= 9 d."""
    odd = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in PARITIES])
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (n + m >= 9 * odd)


def _possible(pairs: DataFrame, light: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and parities don't rule out."""
    x, y = light.alias("x"), light.alias("y")
    return pairs.join(x, F.col("a") == F.col("x.node")).join(y, (F.col("b") == F.col("y.node")) & _alike("x", "y")).select("a", "b")


def _labelled(postings: DataFrame, links: DataFrame) -> DataFrame:
    """Postings with the root of their node's component."""
    roots = connected(links)
    rooted = postings.join(roots, "node", "left").select(*postings.columns, F.coalesce("root", "node").alias("root"))
    return stored(rooted)


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): each node and the least one of its SimHash group."""
    roots = connected(simhash_links(nodes.select("fingerprint").distinct()))
    rooted = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("node", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a != last").select("root", "a")
    return rooted.join(least, "root").where("node != a").select("a", F.col("node").alias("b"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, node, component_id: the smallest id reachable) of every row."""
    rows = stored(signatures(df, id_col, text_col, shingle))
    nodes = stored(rows.groupBy("node").agg(F.min(id_col).alias("least_id"), F.min("fingerprint").alias("fingerprint"), *[F.first(c).alias(c) for c in ("n", "bands", *PARITIES)]))
    every = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    crowded = every.groupBy("band", "key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    postings = stored(every.join(crowded, ["band", "key"], "left_semi").select("band", "key", "node"))
    proposed = stored(simhash_pairs(nodes.select("node", "fingerprint")))
    wanted = postings.select("node").union(proposed.select(F.explode(F.array("a", "b")))).distinct()
    few = stored(nodes.drop("least_id", "fingerprint").join(wanted, "node", "left_semi"))
    hashes = rows.join(few.select("node"), "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("text_hash")).select("text_hash")
    texts = df.select(text_col, F.xxhash64(text_col).alias("text_hash")).join(hashes.distinct(), "text_hash", "left_semi").select(text_col)
    sets = stored(shingle_sets(texts, shingle).groupBy("node").agg(F.first("shingles").alias("shingles")))

    light = few.select("node", "n", *PARITIES)
    links = stored(verified(_possible(proposed, light), sets))
    for spread in (F.lit(0), F.xxhash64("node", "band")):
        labelled = _labelled(postings, links)
        hubs = labelled.groupBy("band", "key").agg(F.min_by(F.struct("node", "root"), F.struct(spread, "node")).alias("hub"), (F.min("root") != F.max("root")).alias("several")).where("several")
        pairs = labelled.join(hubs, ["band", "key"]).where("root != hub.root").select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
        links = stored(links.union(verified(_possible(pairs, light), sets)))

    labelled = _labelled(postings, links)
    several = labelled.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    apart = stored(labelled.join(several.select("band", "key"), ["band", "key"], "left_semi").join(few, "node"))
    first = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True) == F.col("x.band") + 1
    pairs = apart.alias("x").join(
        apart.alias("y"),
        (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _alike("x", "y") & first,
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    links = stored(links.union(verified(pairs, sets)))

    members = stored(connected(links).join(nodes.select("node", "least_id"), "node"))
    component = members.groupBy("root").agg(F.min("least_id").alias("of_component"))
    linked = members.join(component, "root").select("node", "of_component")
    ids = nodes.select("node", "least_id").join(linked, "node", "left").select("node", F.coalesce("of_component", "least_id").alias("component_id"))
    return rows.select(id_col, "node").join(ids, "node").select(id_col, "node", "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of `df`, but of each component only those of its smallest id.

    Rows with a null id stay; rows that share an id stay or go together.
    Columns may have any names.
    """
    names = {c: f"own {i}" for i, c in enumerate(df.columns)}
    own = df.select(*[F.col(c).alias(n) for c, n in names.items()])
    groups = near_groups(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", shingle)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct()
    return own.join(gone, F.col(names[id_col]) == F.col("gone"), "left_anti").select(*[F.col(n).alias(c) for c, n in names.items()])
