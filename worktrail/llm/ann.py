"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Largest inner product is nearest distance once vectors are scaled to the unit
ball and lifted onto the unit sphere (one more component takes up the rest of
the length; a query's is zero). Each table hashes the lifted vector by several
Gaussian projections, cut into cells of equal width with a random shift. A
query visits its own bucket and perturbed ones in order of estimated success:
the chance that a neighbour falls into the bucket, the mean over a few fitted
kinds of neighbours, until the chances of the visited ones sum to `success` for
each of the kinds. What the tables find is
merged, and every visited candidate is ranked by its exact inner product.

Every row is indexed, in every table. Buckets are gathered into blocks of
bounded size; a bucket of more rows than a block is dealt over several, and its
visitors go to each of them, so nothing is left out. Of identical vectors only
the k + 1 with the smallest ids are indexed: ties go to smaller ids, so no
other can be in a result. A task holds one block and streams its queries past.

Only the kinds of neighbours and the number of projections are fitted: on the
`sample_rows` rows of least hash, and the row count.

Defined results: vectors that are null, zero or of another length than most, or
hold null or non-finite components, take no part; rows that share id and vector
count once; rows that share an id are no candidates of each other; a null id is
no query and comes last among ties. Only the two columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktrail.llm.common import stored

MOST_CELLS = 64  # of one projection, six bits of the bucket's code
MOST_PROJECTIONS = 10

_GRID = np.linspace(-8.0, 8.0, 4001)
_CHANCE = np.array([0.5 * math.erfc(-x / math.sqrt(2.0)) for x in _GRID])


def normal_below(x: np.ndarray) -> np.ndarray:
    """Chance that a standard normal number is below x."""
    return np.interp(x, _GRID, _CHANCE)


@dataclass(frozen=True)
class Index:
    """What rows and queries are hashed with."""

    projections: np.ndarray  # (tables, projections, components + 1)
    shifts: np.ndarray  # (tables, projections)
    width: float
    longest: float  # vector of the corpus
    # Kinds of neighbours on the sphere: similarity to the query, what is added
    # on average to that share of the query, and length of the rest.
    similarities: np.ndarray  # (kinds)
    drifts: np.ndarray  # (kinds, components + 1)
    spreads: np.ndarray  # (kinds)
    success: float

    def cells(self, lifted: np.ndarray) -> np.ndarray:
        """Position in cells, (tables, projections, rows)."""
        return (np.einsum("tpc,rc->tpr", self.projections, lifted) + self.shifts[:, :, None]) / self.width + MOST_CELLS // 2

    def lift(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Vectors on the unit sphere of one more dimension."""
        if query:
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            return np.hstack([unit, np.zeros((len(unit), 1))])
        inside = vectors / self.longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("rc,rc->r", inside, inside)))
        return np.hstack([inside, rest[:, None]])

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """Code of each row's bucket, (tables, rows)."""
        return _codes(np.clip(np.floor(self.cells(self.lift(vectors, False))), 0, MOST_CELLS - 1).astype(np.int64))

    def probes(self, vectors: np.ndarray) -> list[list[np.ndarray]]:
        """Codes to visit for each query and table, likeliest first."""
        lifted = self.lift(vectors, True)
        at = self.cells(lifted) - MOST_CELLS // 2 - self.shifts[:, :, None] / self.width  # the projection itself, in cells
        drift = np.einsum("tpc,sc->stp", self.projections, self.drifts) / self.width
        spread = np.maximum(self.spreads, 1e-3) / self.width
        middle = np.multiply.outer(self.similarities, at) + (drift + self.shifts / self.width)[..., None] + MOST_CELLS // 2
        edges = np.arange(MOST_CELLS + 1.0)
        edges[0], edges[-1] = -np.inf, np.inf
        # (kinds, tables, projections, queries, cells)
        chances = np.diff(normal_below((edges - middle[..., None]) / spread[:, None, None, None, None]), axis=-1)
        return [[likeliest(chances[:, t, :, q], self.success) for t in range(chances.shape[1])] for q in range(len(vectors))]


def _codes(cells: np.ndarray) -> np.ndarray:
    """One number from the cells of all projections (axis 1)."""
    return reduce(lambda code, cell: code * MOST_CELLS + cell, np.moveaxis(cells, 1, 0))


def likeliest(chances: np.ndarray, success: float) -> np.ndarray:
    """Codes of the likeliest cell combinations whose chances sum to `success`.

    `chances` is (kinds, projections, cells). Combinations are ordered by
    their mean chance and taken until every kind has its `success`. One
    projection is added at a time, and the unlikeliest tail of the beginnings
    is dropped: all tails together weigh a hundredth of what may be missed.
    """
    tail = (1.0 - success) / 100 / chances.shape[1]
    weights, codes = np.ones((len(chances), 1)), np.zeros(1, dtype=np.int64)

    def first(least: np.ndarray) -> np.ndarray:
        """Order of the likeliest ones that reach `least` for each kind."""
        order = np.argsort(-weights.mean(axis=0), kind="stable")
        total = np.cumsum(weights[:, order], axis=1)
        return order[: max(np.searchsorted(t, x) for t, x in zip(total, least)) + 1]

    for i in range(chances.shape[1]):
        cells = np.flatnonzero(chances[:, i].max(axis=0) > tail / MOST_CELLS)
        weights = (weights[:, :, None] * chances[:, i][:, None, cells]).reshape(len(chances), -1)
        codes = (codes[:, None] * MOST_CELLS + cells).ravel()
        kept = first(weights.sum(axis=1) - tail)
        weights, codes = weights[:, kept], codes[kept]
    return codes[first(np.full(len(chances), success))]


def usable(df: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, asks) of the rows whose vectors can take part."""
    v = F.col(vector_col)
    if not isinstance(df.schema[vector_col].dataType.elementType, (T.FloatType, T.DoubleType)):
        v = v.cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))


def fit(rows: DataFrame, k: int = 20, tables: int = 2, width: float = 1.0, bucket_rows: int = 32, success: float = 0.7, sample_rows: int = 2000, seed: int = 7) -> Index | None:
    """Index of (id, v) rows; None without any.

    The kinds are quarters, by similarity, of the pairs of a sample row and its
    nearest ones, as many as stand for the k nearest of all rows.
    """
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size, longest = rows.agg(F.count("*"), F.max(squares)).first()
    if not size:
        return None
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample_rows).select("v").toPandas()["v"]
    vectors = np.array([np.asarray(v, dtype=np.float64) for v in sample])
    rng = np.random.default_rng(seed)
    number = int(np.clip(round(np.log2(max(2.0, size / bucket_rows)) / 2), 1, MOST_PROJECTIONS))
    shape = (tables, number, vectors.shape[1] + 1)
    index = Index(rng.standard_normal(shape), rng.uniform(0, width, shape[:2]), width, float(np.sqrt(longest)), np.zeros(1), np.zeros((1, shape[2])), np.ones(1), success)
    asking, found = index.lift(vectors, True), index.lift(vectors, False)
    met = asking @ found.T
    np.fill_diagonal(met, -np.inf)
    rank = min(len(vectors) - 1, max(1, round(k * len(vectors) / size)))
    if not rank:
        return index
    nearest = np.argpartition(met, -rank, axis=1)[:, -rank:]
    who, whom = np.repeat(np.arange(len(vectors)), rank), nearest.ravel()
    kinds = [part for part in np.array_split(np.argsort(met[who, whom], kind="stable"), 4) if len(part)]
    similarities = np.array([met[who[part], whom[part]].mean() for part in kinds])
    rests = [found[whom[part]] - s * asking[who[part]] for s, part in zip(similarities, kinds)]
    drifts = np.array([rest.mean(axis=0) for rest in rests])
    spreads = np.array([np.sqrt(np.mean(np.sum((rest - drift) ** 2, axis=1))) for rest, drift in zip(rests, drifts)])
    return replace(index, similarities=similarities, drifts=drifts, spreads=spreads)


def _matrix(column: pa.Array) -> np.ndarray:
    """(rows, components) of a list column whose lists have one length."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 16_384, **fitted) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query row."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType
    result = T.StructType([T.StructField("query_id", id_type), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])
    all_rows = usable(df, is_query, id_col, vector_col)
    lengths = all_rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], result).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    rows = all_rows.where(F.size("v") == lengths["n"])
    # More copies than k + 1 of one vector can't be in any result.
    copies = W.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    indexed = stored(rows.select("id", "v").withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("id", "v").distinct())
    queries = stored(rows.where("asks and id is not null").select("id", "v").distinct().withColumn("q", F.xxhash64("id", "v")))
    index = fit(indexed, k, **fitted)

    # A bucket lies in the block its key falls to; its further parts, where it has
    # more rows than a block, in the blocks after that one.
    blocks = max(1, -(-len(index.projections) * lengths["rows"] // block_rows))
    hashed = indexed.mapInArrow(_hash_rows(index), T.StructType([T.StructField("key", T.LongType()), *indexed.schema.fields]))
    sizes = hashed.groupBy("key").agg(F.count("*").alias("rows"))
    full = stored(sizes.where(F.col("rows") > block_rows).select("key", F.ceil(F.col("rows") / block_rows).alias("parts")))
    home = F.pmod("key", F.lit(blocks))
    after = lambda block, part: F.pmod(block + part, F.lit(blocks)).alias("block")
    wanted = queries.repartition(-(-lengths["rows"] // 5000), "q").mapInArrow(_visit(index, blocks), "q bigint, block bigint, keys array<bigint>")
    if full.isEmpty():
        placed = hashed.withColumn("block", home)
    else:
        parts = F.coalesce("parts", F.lit(1))
        placed = hashed.join(full, "key", "left").withColumn("block", after(home, F.pmod(F.xxhash64("id", "v"), parts)))
        more = wanted.select("q", F.explode("keys").alias("key")).join(full, "key").select("q", "key", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("parts") - 1)).alias("part"))
        further = more.groupBy("q", after(home, F.col("part"))).agg(F.collect_set("key").alias("keys"))
        wanted = wanted.unionByName(further).groupBy("q", "block").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    held = placed.select("block", "key", F.lit(False).alias("asks"), "id", "v", F.lit(None).cast("array<bigint>").alias("keys"))
    asking = wanted.join(queries, "q").select("block", F.lit(0).cast("bigint").alias("key"), F.lit(True).alias("asks"), "id", "v", "keys")
    dealt = held.unionByName(asking).repartition(F.col("block")).sortWithinPartitions("block", "asks", "key", "id")
    found = dealt.mapInArrow(_rank(k, len(index.projections), result), result)
    merged = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return merged.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def bucket_keys(t: int, codes: np.ndarray) -> np.ndarray:
    """A well mixed number of each bucket of a table."""
    x = codes.astype(np.uint64) + np.uint64((t + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values: the splitmix64 finisher
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.int64)


def _hash_rows(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, codes in enumerate(index.buckets(_matrix(batch.column("v")))) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([pa.array(bucket_keys(t, codes)), *batch.columns], names=["key", *batch.schema.names])

    return run


def _visit(index: Index, blocks: int, at_once: int = 64):
    """The buckets each query visits, a row for each block that holds some."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                rows = []
                for q, tables in zip(part.column("q").to_pylist(), index.probes(_matrix(part.column("v")))):
                    keys = np.concatenate([bucket_keys(t, codes) for t, codes in enumerate(tables)])
                    of = np.mod(keys, blocks)
                    rows += [(q, int(block), keys[of == block]) for block in np.unique(of)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["q", "block", "keys"])

    return run


def _rank(k: int, tables: int, result: T.StructType, at_once: int = 256):
    """The best k rows of each query among the visited buckets of each block."""
    most = (k + 1) * tables  # a row may lie in the block once for each table

    def best(block: tuple, queries: pa.RecordBatch) -> pa.RecordBatch:
        keys, ids, vectors = block
        names = ids.to_pylist()
        starts = {key: slice(a, b) for key, a, b in zip(*_runs(keys))}
        asked = _matrix(queries.column("v"))
        visits: dict = {}
        for i, wanted in enumerate(queries.column("keys").to_pylist()):
            for key in wanted:
                if key in starts:
                    visits.setdefault(key, []).append(i)
        near = np.full((len(asked), len(keys)), -np.inf)
        for key, visitors in visits.items():
            near[visitors, starts[key]] = asked[visitors] @ vectors[starts[key]].T
        out_q, out_r, out_s = [], [], []
        for i, own in enumerate(queries.column("id").to_pylist()):
            row = near[i]
            at = np.flatnonzero(row > -np.inf)
            if len(at) > most:
                # Products of matrices round by shape: keep what may tie.
                least = np.partition(row[at], -most)[-most]
                at = at[row[at] >= least - 1e-9 * (1.0 + abs(least))]
            scores = np.einsum("rc,c->r", vectors[at], asked[i]) if len(at) else np.zeros(0)
            found = {(-s, names[j] is None, names[j]) for s, j in zip(scores.tolist(), at.tolist()) if names[j] != own}
            ranked = sorted(found, key=lambda x: x if x[2] is not None else (x[0], True, 0))[:k]
            out_q += [own] * len(ranked)
            out_r += [x[2] for x in ranked]
            out_s += [-x[0] for x in ranked]
        kind = ids.type
        return pa.RecordBatch.from_arrays([pa.array(out_q, kind), pa.array(out_r, kind), pa.array(out_s, pa.float64())], names=result.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, block = None, [], None
        for batch in batches:
            numbers, asks = np.asarray(batch.column("block")), batch.column("asks").to_numpy(zero_copy_only=False)
            _, firsts, ends = _runs(2 * numbers.astype(np.int64) + asks)
            for a, b in zip(firsts, ends):
                part = batch.slice(a, b - a)
                if current != numbers[a]:
                    current, parts, block = numbers[a], [], None
                if not asks[a]:
                    parts.append(part)
                    continue
                if block is None and parts:
                    table = pa.Table.from_batches(parts).combine_chunks()
                    block = (table.column("key").to_numpy(), table.column("id").combine_chunks(), np.vstack([_matrix(p.column("v")) for p in parts]))
                    parts = []
                if block:
                    for start in range(0, part.num_rows, at_once):
                        yield best(block, part.slice(start, at_once))

    return run


def _runs(values: np.ndarray) -> tuple[list, list, list]:
    """Values, first and past-the-last places of runs of equal values."""
    if not len(values):
        return [], [], []
    firsts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[firsts].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(values)]
