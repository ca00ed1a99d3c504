"""Exact top-k inner-product search over an impact-ordered index.

Vectors are turned into integers. Candidates are dealt into blocks by hash,
queries too, and each pair of blocks is one group: within it every dimension
has its postings in order of value. A query's postings are processed by
descending quantised impact (what a posting adds above its dimension's least
contribution). After each level the unseen rest of every dimension is bounded
by its next posting, so a candidate whose sum plus all rests is below the k-th
largest sum is proven out. Processing stops when the candidates not proven out
are few, or at the end, and those are scored exactly. The best k of all blocks
are ranked in Spark.

Sums are floating numbers; what rounding can do to them is bounded and added to
the rests, so nothing is ruled out by it. Where products might not fit 64 bits
they are taken as integers of any size.

Vectors that are null or hold null or non-finite components take no part, nor
do null ids, or components of 2^54 and more, which are no 64-bit integers once
scaled. A score beyond 64 bits counts as the last number that fits, so such
scores tie. Shorter vectors count as ending in zeros. Rows with the query's id are not its
candidates; rows that repeat an id and vector count once; an id with several
vectors is a query for each. Ties go to the smaller id. Other columns are left
out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktrail.llm.common import stored

SCALE = 256
CANDIDATE_BLOCK = 16_384
QUERY_BLOCK = 512
LEVELS = 12
FITS = 2**63


class ImpactIndex:
    """Postings of one block of candidates, by value within each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.largest = int(np.abs(self.vectors).max(initial=0))
        by_value = np.argsort(self.vectors, axis=0, kind="stable")
        self.postings = np.ascontiguousarray(by_value.T)
        self.values = np.ascontiguousarray(np.take_along_axis(self.vectors, by_value, axis=0).T.astype(np.float64))

    def search(self, query_id: int, query: np.ndarray, k: int, levels: int = LEVELS) -> list[tuple[int, int]]:
        """(id, score) of the k best candidates, best first."""
        n = len(self.ids)
        own = np.zeros(n, dtype=bool)
        own[np.searchsorted(self.ids, query_id, "left"):np.searchsorted(self.ids, query_id, "right")] = True
        weights = query.astype(np.float64)
        used = np.flatnonzero(weights) if n else np.array([], dtype=np.int64)
        least = np.where(weights > 0, self.values[:, 0], self.values[:, -1]) if n else weights
        spread = np.abs(weights) * (self.values[:, -1] - self.values[:, 0]) if n else weights
        top = spread.max(initial=0.0)
        largest = np.maximum(np.abs(self.values[:, 0]), np.abs(self.values[:, -1])) if n else weights
        base = float(weights @ least)
        rounding = 2.0**-50 * max(1, len(used)) * float(np.abs(weights) @ largest)
        sums, done = np.where(own, -np.inf, 0.0), np.where(weights > 0, n, 0)
        possible = ~own
        for level in range(1, levels + 1):
            if not top or possible.sum() <= max(4 * k, n // 16):
                break
            cut = top * (levels - level) / levels
            places, impacts, rest = [], [], 0.0
            for d in used:
                values, w, was = self.values[d], weights[d], done[d]
                if spread[d] < cut:
                    rest += spread[d]
                    continue
                if w > 0:
                    now = int(np.searchsorted(values, least[d] + cut / w, "left")) if level < levels else 0
                    now = min(now, was)
                    part = slice(now, was)
                    if now:
                        rest += w * (values[now - 1] - least[d])
                else:
                    now = int(np.searchsorted(values, least[d] + cut / w, "right")) if level < levels else n
                    now = max(now, was)
                    part = slice(was, now)
                    if now < n:
                        rest += w * (values[now] - least[d])
                done[d] = now
                places.append(self.postings[d][part])
                impacts.append(w * (values[part] - least[d]))
            sums += np.bincount(np.concatenate(places), np.concatenate(impacts), n)
            if n > k:
                floor = np.partition(sums, n - k)[n - k]
                # Scores that don't fit tie, so none of them rules out another.
                floor = min(floor, FITS - base) if floor + base > rounding - FITS else -np.inf
                possible = ~own & (sums + rest * (1 + 1e-9) + rounding >= floor)
        members = np.flatnonzero(possible)
        bound = len(query) * int(np.abs(query).max(initial=0)) * self.largest
        if bound < FITS:
            scores = self.vectors[members] @ query
            best = np.lexsort((self.ids[members], -scores))[:k]
        else:
            whole = self.vectors[members].astype(object) @ query.astype(object)
            scores = [max(-FITS, min(FITS - 1, int(s))) for s in whole]
            best = sorted(range(len(members)), key=lambda i: (-scores[i], self.ids[members[i]]))[:k]
        return [(int(self.ids[members[i]]), int(scores[i])) for i in best]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, row in enumerate(column.to_numpy(zero_copy_only=False)):
        out[i, :len(row)] = row
    return out


def _search_block(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if candidates.num_rows and queries.num_rows:
            width = max(1, *(max(map(len, t["v"].to_numpy())) for t in (candidates, queries)))
            index = ImpactIndex(candidates["id"].to_numpy(), _matrix(candidates["v"], width))
            vectors = _matrix(queries["v"], width)
            for query_id, own, query in zip(queries["id"].to_pylist(), queries["own"].to_pylist(), vectors):
                rows += [(query_id, own, *hit) for hit in index.search(query_id, query, k)]
        columns = list(zip(*rows)) or [[]] * 4
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "own", "vec_id", "score"), columns)})

    return run


def scaled(vector: Column) -> Column:
    """floor(256 x) of each component; null where the vector takes no part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**54))
    return F.when(sound, F.transform(x, lambda c: F.floor(c * SCALE)))


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k highest integer inner
    products of each row that `is_query` marks with all rows of other ids."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col)).alias("v"), is_query.alias("is_query"))
    rows = stored(rows.where("id is not null and v is not null").distinct().withColumn("own", F.xxhash64("v")))
    sizes = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    blocks, query_blocks = -(-sizes[0] // CANDIDATE_BLOCK), -(-sizes[1] // QUERY_BLOCK)
    dealt = lambda n: F.pmod(F.xxhash64("id", "own", F.lit(3)), F.lit(max(n, 1)))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))
    candidates = rows.select("id", "v", dealt(blocks).alias("block")).withColumn("query_block", each(query_blocks))
    queries = rows.where("is_query").select("id", "own", "v", dealt(query_blocks).alias("query_block")).withColumn("block", each(blocks))
    keys = ["block", "query_block"]
    found = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_search_block(k), "query_id long, own long, vec_id long, score long")
    best = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
