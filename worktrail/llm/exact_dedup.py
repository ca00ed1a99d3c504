"""Exact deduplication by content sort.

Texts are equal when identical after lower-casing A-Z only; null counts as
empty. Spark samples splitters and range-partitions the rows by the leading
characters and hash of the text; the external sort within partitions puts
equal texts side by side, and a window over the whole normalised text compares
neighbours in full.

A text that more than a `HOT_SHARE`th of the rows hold is dealt out by id over
several ranges; the few representatives of its parts are compared in full
once more. Only those representatives' digests are broadcast: there are less
than three times HOT_SHARE of them at any size.

Ties and repeated ids: each row is kept or dropped as its id says, so all rows
of the kept id and text stay. A null id is smaller than any other and is kept
only where a group has no other id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktrail.llm.common import fold_ascii, stored

HOT_SHARE = 4096
LEADING = 32


def _sorted(df: DataFrame, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows (id, norm, part, ...) range-partitioned by text, and the columns that
    name a group; `part` is -1 but for hot texts."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)
    total = rows.count()
    # texts that are equal after folding A-Z are equal after `lower` too
    lower = F.lower("text")
    keyed = rows.select("*", F.xxhash64(lower).alias("h"), F.left(lower, F.lit(LEADING)).alias("leading"))
    counts = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") * HOT_SHARE > total).select("h", F.ceil(F.col("n") * HOT_SHARE / F.lit(max(total, 1))).alias("parts"))
    salted = keyed.join(F.broadcast(hot), "h", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(-1)))
    ranged = salted.repartitionByRange("leading", "h", "part").withColumn("norm", fold_ascii(F.col("text")))
    return ranged, ["leading", "h", "part", "norm"]


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id (the group's largest id), group_size,
    kept, text_sha256 (of the normalised text)."""
    ranged, group = _sorted(df, id_col, text_col, [])
    same = Window.partitionBy(*group)
    compared = stored(ranged.select(
        "id", "part",
        F.max("id").over(same).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("n"),
        F.sha2("norm", 256).alias("sha256"),
        F.when((F.col("part") >= 0) & (F.row_number().over(same.orderBy("id")) == 1), F.col("norm")).alias("representative"),
    ))
    parts = compared.where(F.col("representative").isNotNull())
    whole = parts.groupBy("representative").agg(F.max("keep_id").alias("all_keep"), F.sum("n").alias("all_n"), F.first("sha256").alias("sha256"))
    joined = compared.drop("representative").join(F.broadcast(whole.drop("representative")), "sha256", "left")
    keep = F.when(F.col("all_n").isNotNull(), F.col("all_keep")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col), keep.alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, but of equal texts only one with the largest id."""
    carried = [F.col(c).alias(f"own {i}") for i, c in enumerate(df.columns)]
    ranged, group = _sorted(df, id_col, text_col, carried)
    first = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("id"), F.xxhash64("text")))
    kept = ranged.withColumn("place", first(group)).where("place = 1")
    hot = kept.where("part >= 0").withColumn("place", first(["norm"])).where("place = 1")
    return kept.where("part < 0").union(hot).select(*[F.col(f"own {i}").alias(c) for i, c in enumerate(df.columns)])
