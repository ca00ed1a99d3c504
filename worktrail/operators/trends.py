"""Before and after: weeks, trajectory, anomalies, model transitions.

Every operator takes `by`, the columns that name a corpus. Rows need
session_id, start_ms, cost, errors and model; the order is (start_ms,
session_id). Series of any length are split into chunks of positions, so one
long series is not one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.functions.numeric import exact_sum, round_half_up
from worktrail.operators.scan import DAY_MS, SEQ_CHUNK, by_width, dense_position, framed, ordered_scan
from worktrail.operators.usage import top_rows
from worktrail.session import materialise

WEEK_MS = 7 * DAY_MS
MIN_WINDOW = 20  # fixed value: sessions each side of a quoted comparison needs
ORDER = ["start_ms", "session_id"]


def positions(sessions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add `pos` (1 = oldest) and `pos_n` (length of the series)."""
    # An hour of one corpus is one task at most.
    return dense_position(sessions, by, ORDER, by_width("start_ms", DAY_MS // 24))


def percent_change(after: Column, before: Column) -> Column:
    base = F.when(before == 0, F.lit(1.0)).otherwise(before)
    return round_half_up((after - before) / base * 100)


def week_summary(sessions: DataFrame, by: Sequence[str]) -> DataFrame:
    """This and last week before the latest session: n, mean cost and errors, main model."""
    by = list(by)
    latest = sessions.groupBy(*by).agg(F.max("start_ms").alias("now_ms"))
    age = F.col("now_ms") - F.col("start_ms")
    band = F.when(age < WEEK_MS, "this_week").when(age < 2 * WEEK_MS, "last_week")
    rows = sessions.join(latest, by).withColumn("band", band).where("band is not null")
    main = rows.groupBy(*by, "band", "model").agg(F.count("*").alias("n")).groupBy(*by, "band").agg(
        F.min_by("model", F.struct((-F.col("n")).alias("n"), F.col("model"))).alias("primary_model")
    )
    means = rows.groupBy(*by, "band").agg(
        F.count("*").alias("sessions"), (exact_sum(F.col("cost")) / F.count("*")).alias("avg_cost"),
        (exact_sum(F.col("errors")) / F.count("*")).alias("errors_per_session"),
        F.min("start_ms").alias("from_ms"), F.max("start_ms").alias("to_ms"),
    )
    return means.join(main, [*by, "band"])


def _tail_means(sessions: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Totals over all and over the last k sessions of each series.

    The last k come from a ranked limit, so no series is sorted as a whole.
    """
    by = list(by)
    total = sessions.groupBy(*by).agg(
        F.count("*").alias("n"), exact_sum(F.col("cost")).alias("cost"), exact_sum(F.col("errors")).alias("errors")
    )
    tail = top_rows(sessions, by, [F.desc(c) for c in ORDER], k).groupBy(*by).agg(
        F.count("*").alias("tail_n"), exact_sum(F.col("cost")).alias("tail_cost"),
        exact_sum(F.col("errors")).alias("tail_errors"),
    )
    return total.join(tail, by)


def trajectory(sessions: DataFrame, by: Sequence[str], k: int = MIN_WINDOW) -> DataFrame:
    """Last k sessions against all earlier ones; both sides need k."""
    s = _tail_means(sessions, by, k).withColumn("older_n", F.col("n") - F.col("tail_n"))
    ok = (F.col("tail_n") >= k) & (F.col("older_n") >= k)

    def trend(name: str) -> list[Column]:
        recent = F.col(f"tail_{name}") / F.col("tail_n")
        older = (F.col(name) - F.col(f"tail_{name}")) / F.when(F.col("older_n") > 0, F.col("older_n"))
        word = (
            F.when(~ok, "insufficient").when(recent > older * 1.2, "increasing")
            .when(recent < older * 0.8, "decreasing").otherwise("stable")
        )
        return [
            word.alias(f"{name}_trend"), F.when(ok, recent).alias(f"recent_mean_{name}"),
            F.when(ok, older).alias(f"older_mean_{name}"), F.when(ok, percent_change(recent, older)).alias(f"{name}_pct"),
        ]

    return s.select(*by, F.col("tail_n").alias("recent_n"), "older_n", *trend("cost"), *trend("errors"))


def staleness(sessions: DataFrame, by: Sequence[str], k: int = 10) -> DataFrame:
    """Distance of the last ten sessions' mean cost from the overall mean, in percent."""
    s = _tail_means(sessions, by, k)
    flat, recent = F.col("cost") / F.col("n"), F.col("tail_cost") / F.col("tail_n")
    value = F.when(flat > 0, F.abs((recent - flat) / flat * 100)).otherwise(0.0)
    return s.select(*by, value.alias("staleness_pct"))


def anomalies(sessions: DataFrame, by: Sequence[str], k: int = 5, floor: float = 10) -> DataFrame:
    """From the 6th session on: cost or errors over 3x the mean of up to ten before, and over `floor`."""
    placed = materialise(positions(sessions, by))
    rows = framed(placed, by, "pos", {
        "avg_cost": (F.avg("cost"), -10, -1), "avg_errors": (F.avg("errors"), -10, -1),
    })
    spike = lambda c: (F.col(c) > F.col(f"avg_{c}") * 3) & (F.col(c) > floor)
    found = rows.where("pos > 5").withColumn("cost_spike", spike("cost")).withColumn("error_spike", spike("errors")).where(
        "cost_spike or error_spike"
    )
    return top_rows(found, by, [F.desc("cost"), F.asc("pos")], k)


def first_mode(values: Column) -> Column:
    """Most frequent non-empty value of an array; the first seen wins a tie."""
    kept = F.filter(values, lambda v: v != "")
    scored = F.transform(
        F.array_distinct(kept),
        lambda v: F.struct((-F.size(F.filter(kept, lambda x: x == v))).alias("n"), F.array_position(kept, v).alias("i"), v.alias("v")),
    )
    return F.get(F.array_sort(scored), F.lit(0))["v"]


def transitions(sessions: DataFrame, by: Sequence[str]) -> DataFrame:
    """The latest change of the main model, one row per series that has one.

    The modes of the ten sessions before and up to ten from a place on differ
    (five or more each); the change is walked back to the first session of the
    run on the new model. Rows: by, pos (the switch), n, before_model,
    after_model, when_ms.
    """
    by = list(by)
    placed = materialise(positions(sessions, by))
    rows = framed(placed, by, "pos", {
        "before": (F.collect_list("model"), -10, -1), "after": (F.collect_list("model"), 0, 9),
    })
    # Positions are 1-based; the walk starts at the 11th session.
    changed = rows.withColumn("b", first_mode(F.col("before"))).withColumn("a", first_mode(F.col("after"))).where(
        "pos > 10 and size(before) >= 5 and size(after) >= 5 and b <> a"
    )
    latest = changed.groupBy(*by).agg(
        F.max("pos").alias("found"), F.max_by("b", "pos").alias("before_model"), F.max_by("a", "pos").alias("after_model")
    )
    # Walk back: the run starts right after the last earlier session on another model.
    other = placed.join(latest, by).where("pos < found and model <> after_model").groupBy(*by).agg(F.max("pos").alias("stop"))
    start = latest.join(other, by, "left").withColumn(
        "pos", F.least(F.col("found"), F.greatest(F.coalesce("stop", F.lit(0)) + 1, F.lit(2)))
    )
    return start.join(placed.select(*by, "pos", F.col("pos_n").alias("n"), F.col("start_ms").alias("when_ms")), [*by, "pos"]).select(
        *by, "pos", "n", "before_model", "after_model", "when_ms"
    )


def compare(sided: DataFrame, by: Sequence[str], basis: str, k: int = MIN_WINDOW) -> DataFrame:
    """Means of both sides (column `side`: before or after) and their change."""
    def part(side: str) -> list[Column]:
        on = F.col("side") == side
        n = F.count_if(on)
        return [
            n.alias(f"{side}_n"),
            (exact_sum(F.when(on, F.col("cost"))) / n).alias(f"{side}_cost"),
            (exact_sum(F.when(on, F.col("errors"))) / n).alias(f"{side}_errors"),
            F.min(F.when(on, F.col("start_ms"))).alias(f"{side}_from_ms"), F.max(F.when(on, F.col("start_ms"))).alias(f"{side}_to_ms"),
        ]

    s = sided.groupBy(*by).agg(*part("before"), *part("after")).where("before_n > 0 and after_n > 0")
    return s.select(
        "*", F.lit(basis).alias("basis"),
        percent_change(F.col("after_cost"), F.col("before_cost")).alias("cost_pct"),
        percent_change(F.col("after_errors"), F.col("before_errors")).alias("errors_pct"),
        ((F.col("before_n") < k) | (F.col("after_n") < k)).alias("insufficient"),
    )


def deltas(sessions: DataFrame, by: Sequence[str], switches: DataFrame | None = None) -> DataFrame:
    """The one before/after comparison of each series.

    20 sessions each side of the model switch; where there is none, last week
    against this week. `headlines` says which changes are worth a line.
    """
    by = list(by)
    switches = materialise(transitions(sessions, by)) if switches is None else switches
    placed = positions(sessions, by).join(switches.select(*by, F.col("pos").alias("switch")), by)
    near = placed.where(f"pos >= switch - {MIN_WINDOW} and pos < switch + {MIN_WINDOW}").withColumn(
        "side", F.when(F.col("pos") < F.col("switch"), "before").otherwise("after")
    )
    switched = compare(near, by, "model_switch")
    rest = sessions.join(switches.select(*by), by, "left_anti")
    latest = rest.groupBy(*by).agg(F.max("start_ms").alias("now_ms"))
    age = F.col("now_ms") - F.col("start_ms")
    weeks = rest.join(latest, by).withColumn(
        "side", F.when(age < WEEK_MS, "after").when(age < 2 * WEEK_MS, "before")
    ).where("side is not null")
    both = switched.unionByName(compare(weeks, by, "week_over_week"))
    return both.withColumn("cost_headline", ~F.col("insufficient") & (F.abs("cost_pct") > 15)).withColumn(
        "errors_headline", ~F.col("insufficient") & (F.abs("errors_pct") > 20)
    )


def delta_unavailable(sessions: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Why a series has no comparison; the latest week is never empty."""
    missing = sessions.select(*by).distinct().join(found.select(*by), list(by), "left_anti")
    return missing.withColumn("reason", F.lit("No previous week inside this report window"))
