"""Ordered scans that survive hot keys.

A plain window over a session puts the whole session into one task. The scans
here split each key into chunks of its order column, run the window inside
(key, chunk), and carry sums, maxima and neighbours across chunks through a
summary with one row per chunk. A key holding a third of all rows is then
spread over many tasks, and the rows themselves shuffle once. A scan reads its
input twice (rows and summary), so a scan over a scan first materialises.

Rules for callers: keys and order columns are not null, the order is total,
and `chunk` is a non-decreasing function of the first order column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from worktrail.session import materialise

SEQ_CHUNK = 65_536  # rows of one log per window group
HOUR_MS = 3_600_000
DAY_MS = 86_400_000

Exprs = Mapping[str, Column]


def by_width(column: str | Column, width: int) -> Column:
    """Chunk number for an integer order column."""
    col = F.col(column) if isinstance(column, str) else column
    return F.floor(col / F.lit(width)).cast("bigint")


def by_magnitude(column: str | Column, steps: int = 256) -> Column:
    """Chunk number for a numeric value column of unknown scale (monotone)."""
    col = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.floor(F.signum(col) * F.log2(F.lit(1.0) + F.abs(col)) * F.lit(steps)).cast("bigint")


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    sums: Exprs | None = None,
    maxs: Exprs | None = None,
    last: Exprs | None = None,
    next_: Exprs | None = None,
    totals: Exprs | None = None,
) -> DataFrame:
    """Add running columns to `df`.

    sums    running sum up to and including the row
    maxs    running max over earlier rows (null on the first)
    last    latest non-null value among earlier rows
    next_   earliest non-null value among later rows
    totals  sum over the whole key
    """
    sums, maxs, last = dict(sums or {}), dict(maxs or {}), dict(last or {})
    next_, totals = dict(next_ or {}), dict(totals or {})
    keys, order = list(keys), list(order)
    # A plain column keeps the summary in a hash aggregate; a struct would sort.
    position = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    chunked = df.withColumn("_chunk", chunk)

    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    # Look-ahead shares the forward order, so rows are sorted once.
    spec = ", ".join(f"`{c}`" for c in [*keys, "_chunk"]), ", ".join(f"`{c}`" for c in order)
    ahead = lambda c: F.expr(f"lead(`{c}`) IGNORE NULLS OVER (PARTITION BY {spec[0]} ORDER BY {spec[1]})")
    local = chunked.select("*", *[e.alias(f"_e_{n}") for n, e in next_.items()]).select(
        "*",
        *[F.coalesce(F.sum(e).over(upto), F.lit(0)).alias(f"_s_{n}") for n, e in sums.items()],
        *[F.max(e).over(before).alias(f"_m_{n}") for n, e in maxs.items()],
        *[F.last(e, ignorenulls=True).over(before).alias(f"_l_{n}") for n, e in last.items()],
        *[ahead(f"_e_{n}").alias(f"_n_{n}") for n in next_],
    )

    summary = chunked.groupBy(*keys, "_chunk").agg(
        *[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()],
        *[F.max(e).alias(f"_m_{n}") for n, e in maxs.items()],
        *[F.max_by(e, F.when(e.isNotNull(), position)).alias(f"_l_{n}") for n, e in last.items()],
        *[F.min_by(e, F.when(e.isNotNull(), position)).alias(f"_n_{n}") for n, e in next_.items()],
        *[F.sum(e).alias(f"_t_{n}") for n, e in totals.items()],
    )
    across = W.partitionBy(*keys).orderBy("_chunk")
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    carry = summary.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_cs_{n}") for n in sums],
        *[F.max(f"_m_{n}").over(earlier).alias(f"_cm_{n}") for n in maxs],
        *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_cl_{n}") for n in last],
        *[F.last(f"_n_{n}", ignorenulls=True).over(later).alias(f"_cn_{n}") for n in next_],
        *[F.sum(f"_t_{n}").over(whole).alias(f"_ct_{n}") for n in totals],
    )
    joined = local.join(carry, [*keys, "_chunk"])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_s_{n}") + F.col(f"_cs_{n}")).alias(n) for n in sums],
        *[F.greatest(f"_m_{n}", f"_cm_{n}").alias(n) for n in maxs],
        *[F.coalesce(f"_l_{n}", f"_cl_{n}").alias(n) for n in last],
        *[F.coalesce(f"_n_{n}", f"_cn_{n}").alias(n) for n in next_],
        *[F.col(f"_ct_{n}").alias(n) for n in totals],
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    exprs: Mapping[str, tuple[Column, int, int]],
    width: int = SEQ_CHUNK,
) -> DataFrame:
    """Window expressions over short row frames of a dense 1-based position.

    `exprs` maps a name to (aggregate, first offset, last offset). Rows near a
    chunk edge are also sent to the neighbour chunk, so each frame is whole.
    """
    keys = list(keys)
    back = max(0, *[-lo for _, lo, _ in exprs.values()])
    ahead = max(0, *[hi for _, _, hi in exprs.values()])
    pos = F.col(position)
    home = by_width(pos, width)
    low, high = by_width(F.greatest(pos - ahead, F.lit(0)), width), by_width(pos + back, width)
    spread = df.withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence(low, high)))
    window = W.partitionBy(*keys, "_chunk").orderBy(position)
    return (
        spread.select(
            "*", *[agg.over(window.rowsBetween(lo, hi)).alias(n) for n, (agg, lo, hi) in exprs.items()]
        )
        .where("_chunk = _home")
        .drop("_chunk", "_home")
    )


def dense_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str = "pos"
) -> DataFrame:
    """Add the 1-based rank in `order` within `keys`."""
    return ordered_scan(df, keys, order, chunk, sums={name: F.lit(1)}, totals={f"{name}_n": F.lit(1)})


def covered_length(
    intervals: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms"
) -> DataFrame:
    """Length in ms of the union of intervals per key (column `covered_ms`)."""
    keys = list(keys)
    points = (
        intervals.where(F.col(end) > F.col(start))
        .select(*keys, F.explode(F.array(
            F.struct(F.col(start).alias("t"), F.lit(1).alias("d")),
            F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")),
        )).alias("p"))
        .groupBy(*keys, F.col("p.t").alias("t"))
        .agg(F.sum("p.d").alias("d"))
    )
    swept = ordered_scan(
        points, keys, ["t"], by_width("t", HOUR_MS), sums={"depth": F.col("d")}, next_={"t2": F.col("t")}
    )
    return (
        swept.where("depth > 0").groupBy(*keys).agg(F.sum(F.col("t2") - F.col("t")).alias("covered_ms"))
    )


def merged_intervals(
    intervals: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms"
) -> DataFrame:
    """Maximal intervals of the union per key; touching intervals join."""
    keys = list(keys)
    points = (
        intervals.where(F.col(end) > F.col(start))
        .select(*keys, F.explode(F.array(
            F.struct(F.col(start).alias("t"), F.lit(1).alias("d")),
            F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")),
        )).alias("p"))
        .groupBy(*keys, F.col("p.t").alias("t"))
        .agg(F.sum("p.d").alias("d"))
    )
    chunk = by_width("t", DAY_MS)
    swept = ordered_scan(points, keys, ["t"], chunk, sums={"depth": F.col("d")})
    turns = materialise(swept.where("depth = 0 or depth = d"))
    closed = ordered_scan(turns, keys, ["t"], chunk, next_={"stop": F.when(F.col("depth") == 0, F.col("t"))})
    return closed.where("depth > 0 and depth = d").select(*keys, F.col("t").alias(start), F.col("stop").alias(end))
