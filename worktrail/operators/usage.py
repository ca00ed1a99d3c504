"""Tokens, cost and model usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from worktrail.functions.numeric import exact_sum, nearest_rank, ratio, round_half_up, select_ranks
from worktrail.session import materialise

SUMS = ["input", "output", "cache_read", "cache_write", "cost", "cost_input", "cost_output"]


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate (a broadcast of exactly one row)."""
    return df.withColumn("_row", F.lit(1)).join(F.broadcast(row.withColumn("_row", F.lit(1))), "_row").drop("_row")


def usage_totals(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The seven sums, and the cost of out-of-band calls."""
    return events.groupBy(*keys).agg(
        *[exact_sum(F.col(c)).alias(c) for c in SUMS],
        exact_sum(F.when(F.col("utility"), F.col("cost")).otherwise(0.0)).alias("utility_cost"),
    )


def usage_by_model(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums, messages and distinct sessions per model.

    Two steps: sessions collapse first, so a busy model never needs its set of
    session ids in one place.
    """
    per_session = events.groupBy(*by, "model", "session_id").agg(
        *[exact_sum(F.col(c)).alias(c) for c in ("input", "output", "cost", "cost_input", "cost_output")],
        F.count("*").alias("n"),
    )
    return per_session.groupBy(*by, "model").agg(
        exact_sum(F.col("input")).alias("input_tokens"),
        exact_sum(F.col("output")).alias("output_tokens"),
        exact_sum(F.col("cost")).alias("cost"),
        F.sum("n").alias("message_count"),
        exact_sum(F.col("cost_input")).alias("cost_input"),
        exact_sum(F.col("cost_output")).alias("cost_output"),
        F.count("*").alias("sessions"),
    )


def basis_of(credential: Column) -> Column:
    """Billing basis of a credential type, NULL for types that say nothing."""
    kind = F.lower(credential)
    return F.when(kind == "oauth", "subscription").when(kind.contains("key"), "api_key")


def provider_basis(credentials: DataFrame, order: str = "row_no") -> DataFrame:
    """provider -> basis; per-server tokens are no provider, the last row wins."""
    rows = credentials.where(~F.col("provider").startswith("mcp_oauth:")).withColumn(
        "basis", basis_of(F.col("credential_type"))
    ).where("basis is not null")
    return rows.groupBy("provider").agg(F.max_by("basis", order).alias("basis"))


def cost_by_provider(events: DataFrame, basis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cost per provider with its basis, `unknown` by default.

    Cost is summed before the join, so the join sees one row per provider.
    """
    cost = events.groupBy(*by, "provider").agg(exact_sum(F.col("cost")).alias("cost"))
    return cost.join(basis, "provider", "left").select(
        *by, "provider", "cost", F.coalesce("basis", F.lit("unknown")).alias("basis")
    )


def billed_split(provider_cost: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    part = lambda b: exact_sum(F.when(F.col("basis") == b, F.col("cost")).otherwise(0.0))
    return provider_cost.groupBy(*by).agg(
        part("api_key").alias("billed_cost"), part("subscription").alias("subscription_cost"),
        part("unknown").alias("unknown_cost"),
    )


def cache_hit_ratio(cache_read: Column, uncached: Column) -> Column:
    return ratio(cache_read, uncached + cache_read)


def fold_sidecars(events: DataFrame) -> DataFrame:
    """Cost per class and session; total = primary + advisor + subagent."""
    part = lambda k: exact_sum(F.when(F.col("kind") == k, F.col("cost")).otherwise(0.0))
    return events.groupBy("session_id").agg(
        part("primary").alias("cost_primary"), part("advisor").alias("cost_advisor"),
        part("subagent").alias("cost_subagent"), exact_sum(F.col("cost")).alias("total_cost"),
        *[exact_sum(F.col(c)).alias(c) for c in ("input", "output", "cache_read", "cache_write")],
        exact_sum(F.when(F.col("utility"), F.col("cost")).otherwise(0.0)).alias("utility_cost"),
    )


def list_price(model_usage: DataFrame) -> DataFrame:
    """Implied list price per million uncached input and output tokens, 4 decimals."""
    def per_million(cost: str, tokens: str) -> Column:
        value = round_half_up(F.col(cost) / F.col(tokens) * 1e6, 4)
        return F.when((F.col(cost) != 0) & (F.col(tokens) > 0), value).otherwise(0.0)

    return model_usage.withColumn("input_per_mtok", per_million("cost_input", "input_tokens")).withColumn(
        "output_per_mtok", per_million("cost_output", "output_tokens")
    )


def model_tiers(priced: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tier of each model from its price relative to the (upper middle) median."""
    keys = list(by) or ["_all"]
    # One row per model, read three times below.
    rows = materialise(priced if by else priced.withColumn("_all", F.lit(1)))
    middle = select_ranks(
        rows.where("input_per_mtok > 0"), keys, "input_per_mtok",
        {"median_price": lambda n: nearest_rank(n, 50)},
    )
    price, mid = F.col("input_per_mtok"), F.col("median_price")
    tier = (
        F.when((F.col("input_tokens") + F.col("output_tokens") > 10_000) & (F.col("cost") < 0.01), "subscription")
        .when((price == 0) & (F.col("cost") > 0), "mid")
        .when((price == 0) & (F.col("message_count") > 20), "subscription")
        .when(price == 0, "low")
        .when(price > mid * 3, "high")
        .when(price < mid * 0.4, "low")
        .otherwise("mid")
    )
    out = rows.join(middle, keys, "left").withColumn("tier", tier)
    return out if by else out.drop("_all")


SUBSCRIPTION_HEAVY = r"(?i)medium|large|pro|opus|o[13]"  # fixed values: heavier plan models
SUBSCRIPTION_LIGHT = r"(?i)small|mini|flash|haiku|lite"


def primary_model(session_models: DataFrame) -> DataFrame:
    """The costliest model of each session, ties by name."""
    order = F.struct((-F.col("cost")).alias("c"), F.col("model"))
    return session_models.groupBy("session_id").agg(
        F.min_by(F.struct("model", F.col("cost").alias("model_cost"), F.col("message_count").alias("model_messages")), order).alias("p")
    ).select("session_id", "p.*")


def model_mismatch(sessions: DataFrame, facets: DataFrame, session_models: DataFrame, tiers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sessions whose model did not suit the task, with the estimated waste."""
    rows = (
        sessions.join(facets.select("session_id", "outcome", "session_type"), "session_id")
        .join(primary_model(session_models), "session_id")
        .join(tiers.select(*by, "model", "tier"), [*by, "model"], "left")
    )
    simple = F.col("session_type").isin("quick_question", "single_task") | (
        (F.col("user_message_count") <= 3) & (F.col("duration_minutes") < 5)
    )
    complex_ = (
        F.col("session_type").isin("multi_task", "iterative_refinement")
        | (F.col("user_message_count") > 8)
        | (F.col("files_modified") > 5)
    )
    poor = F.col("outcome").isin("not_achieved", "partially_achieved")
    good = F.col("outcome").isin("fully_achieved", "mostly_achieved")
    tier, cost = F.col("tier"), F.col("model_cost")
    heavy = F.col("model").rlike(SUBSCRIPTION_HEAVY) & ~F.col("model").rlike(SUBSCRIPTION_LIGHT)
    plan = tier == "subscription"
    pressed = plan & simple & good & (F.col("model_messages") > 3) & heavy
    over_simple = ~plan & (tier == "high") & simple & good
    under = ~plan & (tier == "low") & complex_ & poor
    over_poor = ~plan & (tier == "high") & poor & (cost > 0.10)
    flag = F.when(pressed, "quota_pressure").when(over_simple, "overspend").when(under, "underspend").when(over_poor, "overspend")
    waste = F.when(over_simple, cost * 0.8).when(under, cost).when(over_poor, cost * 0.5).otherwise(0.0)
    return rows.withColumn("flag", flag).withColumn("waste", waste).where("flag is not null")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key; only k rows per key and task reach the shuffle."""
    if not keys:
        # One sorted limit, then ranks over k rows.
        return df.orderBy(*order).limit(k).withColumn(
            rank, F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order))
        )
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
