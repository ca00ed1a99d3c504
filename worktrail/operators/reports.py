"""Report upkeep: snapshots, evidence, repeated items, config."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.functions.text import category_slug
from worktrail.operators.scan import DAY_MS
from worktrail.session import materialise

RECENT_MS = 7 * DAY_MS  # fixed value: a change younger than this cannot be judged


def snapshot_diff(previous: DataFrame, current: DataFrame, keys: Sequence[str] = ("owner", "entity", "key")) -> DataFrame:
    """added / removed / changed keys; owners without a previous snapshot give no rows.

    Rows need `value` and `taken_ms`.
    """
    keys = list(keys)
    p = previous.select(*keys, F.col("value").alias("old"), F.lit(True).alias("in_old"))
    c = current.select(*keys, F.col("value").alias("new"), F.lit(True).alias("in_new"))
    joined = p.join(c, keys, "full_outer")
    status = (
        F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed")
        .when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    )
    owner = keys[:1]
    known = previous.groupBy(*owner).agg(F.max("taken_ms").alias("previous_ms"))
    return joined.withColumn("status", status).where("status is not null").join(known, owner).select(
        *keys, "old", "new", "status", "previous_ms"
    )


def harness_changes(diff: DataFrame, window_end_ms: DataFrame) -> DataFrame:
    """Diff rows with `too_recent`; a bare hash change becomes config_changed.

    `config_hash` counts only when neither the memory backend nor a model role
    changed, as those carry the news themselves.
    """
    rows = diff.join(window_end_ms, "owner").withColumn(
        "too_recent", F.col("window_end_ms") - F.col("previous_ms") < RECENT_MS
    )
    tracked = rows.where("entity in ('memory_backend', 'model_role')").select("owner").distinct()
    bare = rows.where("entity = 'config_hash'").join(tracked, "owner", "left_anti")
    rest = rows.where("entity <> 'config_hash'")
    kind = (
        F.when(F.col("entity") == "memory_backend", "memory_backend")
        .when(F.col("entity") == "model_role", "model_roles_changed")
        .when(F.col("entity") == "agents_md_hash", "agents_md_updated")
        .when(F.col("entity") == "config_hash", "config_changed")
        .otherwise(F.concat_ws("_", "entity", "status"))
    )
    both = rest.unionByName(bare)
    keep = F.col("entity").isin("memory_backend", "model_role", "agents_md_hash", "config_hash") | F.col("status").isin("added", "removed")
    return both.where(keep).withColumn("type", kind)


def config_diff(live: DataFrame, proposed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Proposed keys whose value differs from the live one ((unset) if absent)."""
    keys = list(keys)
    joined = proposed.select(*keys, F.col("value").alias("to")).join(
        live.select(*keys, F.col("value").alias("from")), keys, "left"
    )
    return joined.where(~F.col("from").eqNullSafe(F.col("to"))).select(*keys, F.coalesce("from", F.lit("(unset)")).alias("from"), "to")


def category_diff(previous: DataFrame, current: DataFrame, by: Sequence[str]) -> DataFrame:
    """Categories new, persisting or resolved between two reports."""
    keys = [*by, "category"]
    p = previous.select(*keys).distinct().withColumn("was", F.lit(True))
    c = current.select(*keys).distinct().withColumn("now", F.lit(True))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("persisting")
    return p.join(c, keys, "full_outer").select(*keys, status.alias("status"))


def evidence_links(items: DataFrame, sessions: DataFrame, item_keys: Sequence[str]) -> DataFrame:
    """Items' evidence ids with the path of their log; unknown ids drop out."""
    ids = items.select(*item_keys, F.posexplode("evidence").alias("place", "session_id"))
    known = sessions.where("path <> ''").select("session_id", "path")
    return ids.join(known, "session_id").select(
        *item_keys, "place", "session_id", "path", F.concat(F.lit("file://"), F.col("path")).alias("href")
    )


def claim_incidents(items: DataFrame) -> DataFrame:
    """Let the first item of each incident keep its text.

    Items (report_id, item_no, section, evidence) claim their session ids in
    item order; an item sharing an id with an earlier claim refers to its
    section and claims nothing. A report's items are few and bounded by its
    sections, so each report is one ordered fold.
    Returns items with evidence as (report_id, item_no, owner); owner is NULL
    for items that keep their text.
    """
    ids = F.array_distinct(F.array_compact("evidence"))
    with_ids = items.select("report_id", F.struct("item_no", "section", ids.alias("ids")).alias("item")).where("size(item.ids) > 0")
    per_report = with_ids.groupBy("report_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    number = items.schema["item_no"].dataType.simpleString()
    start = F.struct(
        F.create_map().cast("map<string,string>").alias("claims"), F.array().cast(f"array<struct<item_no:{number},owner:string>>").alias("out"),
    )

    def step(state, item):
        taken = F.filter(item["ids"], lambda i: F.map_contains_key(state["claims"], i))
        owner = F.element_at(state["claims"], F.get(taken, F.lit(0)))
        claimed = F.map_from_arrays(item["ids"], F.transform(item["ids"], lambda _: item["section"]))
        claims = F.when(F.size(taken) == 0, F.map_concat(state["claims"], claimed)).otherwise(state["claims"])
        row = F.struct(item["item_no"].alias("item_no"), F.when(F.size(taken) > 0, owner).alias("owner"))
        return F.struct(claims.alias("claims"), F.array_append(state["out"], row).alias("out"))

    folded = F.aggregate("items", start, step, lambda state: state["out"])
    return per_report.select("report_id", F.explode(folded).alias("x")).select("report_id", "x.item_no", "x.owner")


def title_key(title) -> object:
    return F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " "))


def distinct_recommendations(items: DataFrame) -> DataFrame:
    """One item per report and normalised title, the first by list and position."""
    rest = [c for c in items.columns if c not in ("report_id",)]
    keyed = items.withColumn("title_key", title_key(F.col("title"))).where("title_key <> ''")
    best = F.min_by(F.struct(*rest), F.struct("list_no", "position"))
    return keyed.groupBy("report_id", "title_key").agg(best.alias("b")).select("report_id", "title_key", "b.*")


def still_present(categories: DataFrame, current: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add `present`: the category's slug holds a current slug as a run of words.

    Every run of words of the category is a candidate for an equi-join.
    """
    by = list(by)
    rows = categories.select(*by, "category").distinct().withColumn("_w", F.split(category_slug(F.col("category")), "-"))
    spans = rows.select(
        *by, "category", F.explode(F.flatten(F.transform(
            F.sequence(F.lit(1), F.size("_w")),
            lambda i: F.transform(F.sequence(F.lit(1), F.size("_w") - i + 1), lambda n: F.array_join(F.slice("_w", i, n), "-")),
        ))).alias("slug"),
    )
    now = current.select(*by, category_slug(F.col("key")).alias("slug")).distinct()
    hit = spans.join(now, [*by, "slug"], "left_semi").select(*by, "category").distinct().withColumn("_hit", F.lit(True))
    return categories.join(hit, [*by, "category"], "left").withColumn("present", F.coalesce("_hit", F.lit(False))).drop("_hit")


def first_actions(items: DataFrame, k: int = 5) -> DataFrame:
    """First k action items per report: config rules, habits to stop, patterns."""
    from worktrail.operators.usage import top_rows

    order = F.when(F.col("source") == "config_additions", 0).when(F.col("source") == "stop_doing", 1).when(
        F.col("source") == "usage_patterns", 2
    )
    return top_rows(items.withColumn("_o", order).where("_o is not null"), ["report_id"], [F.asc("_o"), F.asc("position")], k).drop("_o")


def flatten_config(configs: DataFrame, keys: Sequence[str], column: str = "config") -> DataFrame:
    """(keys, key, value): dotted paths of the scalar leaves; lists drop out.

    One pass per nesting level, until no object is left.
    """
    keys = list(keys)
    spark = configs.sparkSession
    level = configs.select(*keys, F.lit("").alias("path"), F.try_parse_json(column).alias("node")).where("node is not null")
    found = None
    while True:
        cols = ", ".join(keys)
        rows = spark.sql(
            f"SELECT {cols}, concat_ws('.', nullif(path, ''), v.key) AS path, v.value AS node, schema_of_variant(v.value) AS kind "
            "FROM {level}, LATERAL variant_explode(node) AS v WHERE v.key IS NOT NULL", level=level,
        )
        rows = materialise(rows)
        leaves = rows.where("kind not like 'OBJECT%' and kind not like 'ARRAY%' and kind <> 'VOID'").select(
            *keys, F.col("path").alias("key"), F.expr("variant_get(node, '$', 'string')").alias("value")
        )
        found = leaves if found is None else found.unionByName(leaves)
        level = rows.where("kind like 'OBJECT%'").select(*keys, "path", "node")
        if level.isEmpty():
            return found
