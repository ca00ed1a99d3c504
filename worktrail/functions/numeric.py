"""Rounding, exact sums and rank-based statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.operators.scan import by_magnitude, ordered_scan


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x + 0.5) at `digits` decimals: halves go up, also below zero."""
    scale = float(10**digits)
    raised = x * F.lit(scale) + F.lit(0.5)
    # floor gives a bigint; doubles beyond 2^53 have no fraction to round.
    out = F.when(F.abs(raised) < 2.0**53, F.floor(raised).cast("double")).otherwise(raised)
    return out / F.lit(scale) if digits else out


def exact_sum(x: Column) -> Column:
    """Sum as decimal, so the result does not depend on task order.

    Twelve decimals keep costs of a single token; totals reach 10^26.
    """
    return F.coalesce(F.sum(x.cast("decimal(38,12)")), F.lit(0)).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when the whole is not positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def nearest_rank(n: Column, p: float) -> Column:
    """1-based rank of percentile p in n values: min(n, floor(p*n/100) + 1)."""
    return F.least(n, F.floor(F.lit(p / 100) * n).cast("bigint") + 1)


def select_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    weight: Column | None = None,
) -> DataFrame:
    """The value at each rank per key, exact and without collecting a group.

    `ranks` maps an output name to a function of the total weight (or row
    count) giving the rank to pick: the first value whose cumulative weight
    reaches it. Equal values collapse before the shuffle.
    """
    keys = list(keys)
    unit = F.lit(1).cast("bigint") if weight is None else weight
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.sum(unit).alias("_w"))
    )
    cum = ordered_scan(
        counts, keys, ["_v"], by_magnitude("_v"), sums={"_cum": F.col("_w")}, totals={"_n": F.col("_w")}
    )
    total = F.col("_n")
    return cum.groupBy(*keys).agg(
        *[F.min(F.when(F.col("_cum") >= rank(total), F.col("_v"))).alias(n) for n, rank in ranks.items()]
    )


def percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: Mapping[str, float]) -> DataFrame:
    """Nearest-rank percentiles (p in [0, 100]) per key."""
    return select_ranks(df, keys, value, {n: (lambda t, p=p: nearest_rank(t, p)) for n, p in ps.items()})


def weighted_percentile(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, p: float, name: str
) -> DataFrame:
    """First value whose cumulative weight reaches p% of the total; weights <= 0 drop out."""
    return select_ranks(
        df.where(F.col(weight) > 0), keys, value,
        {name: lambda total: total * F.lit(p / 100)}, weight=F.col(weight),
    )


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Midpoint median per key."""
    halves = select_ranks(
        df, keys, value,
        {
            "_lo": lambda n: F.floor((n + 1) / 2).cast("bigint"),
            "_hi": lambda n: F.floor(n / 2).cast("bigint") + 1,
        },
    )
    return halves.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(name))
