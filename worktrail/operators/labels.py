"""Facet labels: key clean-up, decayed distributions, resolved and ongoing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from worktrail.functions.labels import FRICTION_LABELS, OUTCOME_WORDS
from worktrail.functions.text import lookup
from worktrail.operators.scan import DAY_MS
from worktrail.operators.usage import top_rows, with_row

HALF_LIFE_DAYS = 10  # fixed value: a label counts half after ten days
LAMBDA = math.log(2) / (HALF_LIFE_DAYS * DAY_MS)


def is_valid_facet() -> Column:
    """An id, a summary and an outcome; rows without count as failures."""
    return F.expr("coalesce(session_id <> '' and brief_summary <> '' and outcome <> '', false)")


def valid_facets(facets: DataFrame) -> DataFrame:
    return facets.where(is_valid_facet())


def key_tokens(key: Column) -> Column:
    return F.regexp_extract_all(F.lower(key), F.lit("([a-z0-9]+)"), 1)


def _sorted_key(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), "_")


def _singular(token: Column) -> Column:
    plural = (F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss")
    return F.when(plural, F.substr(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def _canonical() -> dict[str, str]:
    """Known friction keys by their sorted words."""
    return {"_".join(sorted(k.split("_"))): k for k in FRICTION_LABELS}


def normalise_keys(counts: DataFrame, keys: Sequence[str], key: str = "key", n: str = "n") -> DataFrame:
    """One spelling per friction type within `keys`.

    Drops non-positive counts and keys holding an outcome word. A key with the
    words of a known type becomes that type; the others group by their sorted
    singular words and take the smallest spelling seen.
    """
    keys = list(keys)
    outcome = F.array(*[F.lit(w) for w in OUTCOME_WORDS])
    tokens = key_tokens(F.col(key))
    rows = counts.where(F.col(n) > 0).withColumn("_tok", tokens).where(
        (F.size("_tok") > 0) & ~F.arrays_overlap("_tok", outcome)
    )
    known = lookup(_sorted_key(F.col("_tok")), _canonical())
    spelled = rows.select(
        *keys, known.alias("_known"), F.array_join("_tok", "_").alias("_spelling"),
        _sorted_key(F.transform("_tok", _singular)).alias("_group"), F.col(n).alias("_n"),
    )
    group = F.when(F.col("_known").isNotNull(), F.concat(F.lit("="), F.col("_known"))).otherwise(F.col("_group"))
    grouped = spelled.groupBy(*keys, group.alias("_g")).agg(
        F.min(F.coalesce("_known", "_spelling")).alias(key), F.sum("_n").alias(n)
    )
    # Two groups can share a final name (a known type and a spelling); add them up.
    return grouped.groupBy(*keys, key).agg(F.sum(n).alias(n))


def merge_friction(counts: DataFrame, session_keys: Sequence[str], corpus_keys: Sequence[str], n: str = "n") -> DataFrame:
    """Per-session clean-up, then the merged counts cleaned up again."""
    per_session = normalise_keys(counts, session_keys, n=n)
    merged = per_session.groupBy(*corpus_keys, "key").agg(F.sum(n).alias(n))
    return normalise_keys(merged, corpus_keys, n=n)


def decay_weights(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add `weight`: 1 for the latest session, half per ten days of age."""
    if by:
        latest = sessions.groupBy(*by).agg(F.max("start_ms").alias("_latest"))
        rows = sessions.join(latest, list(by))
    else:
        rows = with_row(sessions, sessions.agg(F.max("start_ms").alias("_latest")))
    age = F.col("_latest") - F.col("start_ms")
    return rows.withColumn("weight", F.exp(F.lit(-LAMBDA) * age)).drop("_latest")


def weighted_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Decay-weighted count per (dim, key); friction keys are cleaned up twice."""
    weighted = decay_weights(counts, by)
    friction = weighted.where("dim = 'friction'")
    per_session = normalise_keys(friction, [*by, "session_id", "weight"]).withColumn("w", F.col("n") * F.col("weight"))
    merged = per_session.groupBy(*by, "key").agg(F.sum("w").alias("n"))
    clean = normalise_keys(merged, list(by)).select(*by, F.lit("friction").alias("dim"), "key", "n")
    other = weighted.where("dim <> 'friction' and n > 0").groupBy(*by, "dim", "key").agg(
        F.sum(F.col("n") * F.col("weight")).alias("n")
    )
    return clean.unionByName(other.select(*by, "dim", "key", "n"))


def single_labels(facets: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Facet columns as (session_id, ..., dim, key, n=1) rows; `none` is no success."""
    rest = [c for c in facets.columns if c not in dims]
    cells = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("key")) for d in dims])
    rows = facets.select(*rest, F.explode(cells).alias("x")).select(*rest, "x.dim", "x.key")
    return rows.where("key <> '' and not (dim = 'primary_success' and key = 'none')").withColumn("n", F.lit(1.0))


def outcome_counts(facets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted sessions per outcome and their share."""
    n = facets.groupBy(*by, "outcome").agg(F.count("*").alias("n"))
    total = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    return n.withColumn("share", F.col("n") / F.sum("n").over(total))


def abort_labels(aborts: DataFrame, facet_labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Aborts per label; a classified label at the same time wins over the guess."""
    named = facet_labels.groupBy("session_id", "ts_ms").agg(F.min("label").alias("given"))
    joined = aborts.join(named, ["session_id", "ts_ms"], "left")
    label = F.when(F.coalesce("given", F.lit("")) != "", F.col("given")).otherwise(F.col("label"))
    return joined.groupBy(*by, label.alias("abort_label")).agg(F.count("*").alias("n"))


def friction_status(
    counts: DataFrame, latest: DataFrame, current: DataFrame, by: Sequence[str],
    since_days: float | None = None,
) -> DataFrame:
    """Resolved and ongoing friction per `by`.

    recent: the last 14 days, or half of the since range if that is shorter.
    Resolved needs absence from the recent window and from the current totals.
    Rows: by, key, recent_n, older_n, status.
    """
    days = min(14, since_days / 2) if since_days else 14
    by = list(by)
    sided = counts.join(latest, by).withColumn(
        "recent", F.col("start_ms") >= F.col("latest_ms") - F.lit(int(days * DAY_MS))
    )
    merged = merge_friction(sided, [*by, "recent", "session_id"], [*by, "recent"])
    wide = merged.groupBy(*by, "key").agg(
        F.sum(F.when(F.col("recent"), F.col("n")).otherwise(0.0)).alias("recent_n"),
        F.sum(F.when(~F.col("recent"), F.col("n")).otherwise(0.0)).alias("older_n"),
    )
    now = current.where("n > 0").select(*by, "key", F.lit(True).alias("is_current"))
    joined = wide.join(now, [*by, "key"], "left")
    status = F.when(F.col("recent_n") > 0, "ongoing").when(F.col("is_current").isNull(), "resolved")
    return joined.withColumn("status", status).drop("is_current").where("status is not null")


def capped_friction(status: DataFrame, by: Sequence[str], resolved: int = 5, ongoing: int = 8) -> DataFrame:
    """The first five resolved and the eight most frequent ongoing types."""
    ranked = top_rows(status, [*by, "status"], [F.desc("recent_n"), F.asc("key")], max(resolved, ongoing))
    return ranked.where((F.col("rank") <= resolved) | (F.col("status") == "ongoing"))


def narrative_lists(facets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Last 50 summaries, first 20 friction details and, where facets have them,
    first 15 instructions per `by`, in start order."""
    order = ["start_ms", "session_id"]
    tail = top_rows(facets.where("brief_summary <> ''"), by, [F.desc(c) for c in order], 50)
    head = top_rows(facets.where(F.trim("friction_detail") != ""), by, [F.asc(c) for c in order], 20)
    pick = lambda df, what, col: df.select(*by, F.lit(what).alias("list"), "session_id", F.trim(F.col(col)).alias("entry"))
    lists = pick(tail, "summary", "brief_summary").unionByName(pick(head, "friction_detail", "friction_detail"))
    if "instructions" in facets.columns:
        each = facets.select(*by, *order, F.posexplode("instructions").alias("place", "instruction"))
        asked = top_rows(each, by, [F.asc(c) for c in (*order, "place")], 15)
        lists = lists.unionByName(pick(asked, "instruction", "instruction"))
    return lists
