"""Session and evidence filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from worktrail.functions.labels import SELF_GENERATED_MARKERS
from worktrail.operators.usage import with_row
from worktrail.session import materialise

SAFE_ID = r"^[A-Za-z0-9._-]{1,128}$"


def self_generated(messages: DataFrame, markers: Sequence[str] = SELF_GENERATED_MARKERS) -> DataFrame:
    """Ids of sessions one of whose first 3 human messages holds a marker."""
    w = W.partitionBy("session_id").orderBy("seq")
    # row_number <= 3 keeps three rows per session before the shuffle.
    first = messages.where("is_human").select("session_id", "seq", "text").withColumn(
        "n", F.row_number().over(w)
    ).where("n <= 3")
    hit = F.lit(False)
    for marker in markers:
        hit = hit | F.col("text").contains(marker)
    return first.where(hit).select("session_id").distinct()


def exclusion_reason(
    *, now_ms: int | Column, since_days: float | None = None,
    current_id: str | None = None, only_id: str | None = None,
) -> Column:
    """Why a session is left out, NULL if it stays.

    With `only_id` the substance floor and the since window do not apply.
    Reads session_id, user_message_count, duration_minutes, start_ms.
    """
    if only_id is not None:
        return F.when(F.col("session_id") != only_id, "other_session")
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    reason = F.when(F.lit(current_id) == F.col("session_id"), "current") if current_id else F.when(F.lit(False), "")
    reason = reason.when(
        (F.col("user_message_count") < 2) | (F.col("duration_minutes") < 1), "not_substantive"
    )
    if since_days:
        reason = reason.when(now - F.col("start_ms") >= F.lit(int(since_days * 86_400_000)), "by_since")
    return reason


def substantive(sessions: DataFrame, **kw) -> DataFrame:
    return sessions.where(exclusion_reason(**kw).isNull())


def drop_warmup_only(sessions: DataFrame, goal_counts: DataFrame, warmup: str = "warmup_minimal") -> DataFrame:
    """Drop sessions whose only positive goal is the warm-up; keep those without goals."""
    positive = goal_counts.where("n > 0").groupBy("session_id").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi")
    )
    only = positive.where((F.col("lo") == warmup) & (F.col("hi") == warmup))
    return sessions.join(only.select("session_id"), "session_id", "left_anti")


def is_analysis(project_path: Column, excluded: Sequence[str]) -> Column:
    """False where the project path holds one of the excluded texts (any case)."""
    keep = F.lit(True)
    for needle in excluded:
        if needle:
            keep = keep & ~F.lower(project_path).contains(needle.lower())
    return keep


def is_safe_id(value: Column) -> Column:
    return F.coalesce(value.rlike(SAFE_ID) & ~value.isin(".", ".."), F.lit(False))


def safe_session_id(record_id: Column, file_id: Column) -> Column:
    """The record's id if safe, else the file's, else NULL (unparsed)."""
    return F.when(is_safe_id(record_id), record_id).when(is_safe_id(file_id), file_id)


def has_evidence(evidence: Column, minimum: int = 2) -> Column:
    return F.size(F.array_distinct(F.coalesce(evidence, F.array().cast("array<string>")))) >= minimum


# Words too common to tell two names apart.
COMMON_WORDS = ["skill", "skills", "with", "your", "that", "this"]


def _name_text(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[-_]", " "), r"\s+", " "))


def _name_tokens(text: Column) -> Column:
    common = F.array(*[F.lit(w) for w in COMMON_WORDS])
    return F.array_distinct(
        F.filter(F.split(text, " "), lambda w: (F.length(w) > 3) & ~F.array_contains(common, w))
    )


def _seeds(names: DataFrame, by: list[str], size: int = 4) -> DataFrame:
    """(by, _b, gram): of each name of `size` characters or more, the gram that fewest names hold."""
    grams = names.where(F.length("_b") >= size).select(*by, "_b", F.explode(_grams(F.col("_b"), size)).alias("gram"))
    held = grams.groupBy(*by, "gram").agg(F.count("*").alias("n"))
    rarest = F.min_by("gram", F.struct("n", "gram")).alias("gram")
    return grams.join(held, [*by, "gram"]).groupBy(*by, "_b").agg(rarest)


def _grams(text: Column, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size))))


def _rare_first(sets: DataFrame, keys: list[str], item: str, by: list[str], counts: DataFrame) -> DataFrame:
    """(by, item, w, place, size): words of each item, the rarest first."""
    words = sets.select(*by, item, F.size("_words").alias("size"), F.explode("_words").alias("w")).join(counts, [*by, "w"])
    ranked = words.groupBy(*by, item, "size").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("x"))
    return ranked.select(*by, item, "size", F.posexplode("x").alias("place", "x")).select(*by, item, "size", "place", F.col("x.w").alias("w"))


def near_duplicate_names(
    candidates: DataFrame, names: DataFrame, candidate: str = "name", existing: str = "existing", by: Sequence[str] = ()
) -> DataFrame:
    """(by, candidate) of the candidates close to an existing name.

    Close: the candidate holds the name (4 characters or more), or the two share
    at least half of the words of the one with fewer telling words.

    Words: sets that share t of the m words of the smaller one share one of its
    m - t + 1 rarest, so only those are looked up. Up to two words make t = 1,
    where any shared word settles it and no pair is needed; so a word that all
    names hold emits none. Held names: a candidate meets a name through the
    name's rarest four characters only, and is then searched for it.
    """
    by = list(by)
    left = candidates.select(*by, F.col(candidate).alias("_c")).distinct().withColumn("_a", _name_text(F.col("_c"))).where("_a <> ''")
    left = left.withColumn("_words", _name_tokens(F.col("_a")))
    right = names.select(*by, F.col(existing).alias("_e")).distinct().withColumn("_b", _name_text(F.col("_e"))).where("_b <> ''")
    right = right.select(*by, "_b").distinct().withColumn("_words", _name_tokens(F.col("_b")))
    left, right = materialise(left), materialise(right)

    counts = left.select(*by, F.explode("_words").alias("w")).unionByName(right.select(*by, F.explode("_words").alias("w"))).groupBy(*by, "w").agg(F.count("*").alias("n"))
    a = materialise(_rare_first(left, by, "_c", by, counts))
    b = materialise(_rare_first(right, by, "_b", by, counts))
    # The smaller set has at most two words: one in common is enough.
    smallest = lambda sets: sets.groupBy(*by, "w").agg(F.min("size").alias("least"))
    met = a.join(smallest(b), [*by, "w"]).where("least <= 2 or size <= 2").select(*by, "_c")
    # Three and more: look up the rarest words of the smaller, then count.
    need = F.ceil(F.col("size") / 2)
    prefix = lambda sets: sets.where(F.col("size") > 2).where(F.col("place") < F.col("size") - need + 1)
    other = lambda sets, item: sets.select(*by, "w", F.col(item), F.col("size").alias("size2")).where("size2 > 2")
    pairs = prefix(a).join(other(b, "_b"), [*by, "w"]).where("size2 >= size").select(*by, "_c", "_b").union(
        prefix(b).join(other(a, "_c"), [*by, "w"]).where("size2 >= size").select(*by, "_c", "_b")
    ).distinct()
    whole = pairs.join(left.select(*by, "_c", F.col("_words").alias("ta")), [*by, "_c"]).join(right.select(*by, "_b", F.col("_words").alias("tb")), [*by, "_b"])
    shared = whole.where(F.size(F.array_intersect("ta", "tb")) >= F.least(F.size("ta"), F.size("tb")) * 0.5).select(*by, "_c")

    seeds = _seeds(right.select(*by, "_b"), by)
    spots = left.where(F.length("_a") >= 4).select(*by, "_c", "_a", F.explode(_grams(F.col("_a"), 4)).alias("gram"))
    held = spots.join(seeds, [*by, "gram"]).where(F.contains("_a", F.col("_b"))).select(*by, "_c")
    return met.unionByName(shared).unionByName(held).distinct().withColumnRenamed("_c", candidate)


def drop_near_duplicates(
    candidates: DataFrame, names: DataFrame, candidate: str = "name", existing: str = "existing", by: Sequence[str] = ()
) -> DataFrame:
    """Drop candidates close to an existing name of their own corpus."""
    close = near_duplicate_names(candidates, names, candidate, existing, by)
    return candidates.join(close, [*by, candidate], "left_anti")


# Words of features, and the memory backends that can retain.
LEARN_WORDS = r"(?i)\blearn tool\b|memory \(learn\)"
MANAGE_WORDS = r"(?i)\bmanage_skill\b"
RETAIN_WORDS = r"(?i)\bretain\b|\brecall\b|\breflect\b|\bmemory_edit\b"
RETAINING_BACKENDS = ["hindsight", "mnemopi"]


def names_unavailable(text: Column, autolearn: Column, backend: Column) -> Column:
    """The text names a feature that the user's settings switch off."""
    learns = autolearn & (backend != "off")
    return (~learns & text.rlike(LEARN_WORDS)) | (~autolearn & text.rlike(MANAGE_WORDS)) | (~backend.isin(*RETAINING_BACKENDS) & text.rlike(RETAIN_WORDS))


def filter_suggestions(suggestions: DataFrame, installed: DataFrame, settings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Suggestions that name no feature switched off and no skill already there.

    suggestions: by, name, text. installed: by, skill. settings: one row per
    `by`: autolearn, backend; missing ones count as off. Only names that speak
    of a skill are compared with the installed ones.
    """
    by = list(by)
    known = suggestions.join(settings.select(*by, "autolearn", "backend"), by, "left") if by else with_row(suggestions, settings.agg(F.max("autolearn").alias("autolearn"), F.max("backend").alias("backend")))
    on, backend = F.coalesce("autolearn", F.lit(False)), F.coalesce("backend", F.lit("off"))
    usable = known.where(~F.coalesce(names_unavailable(F.coalesce("text", F.lit("")), on, backend), F.lit(False))).drop("autolearn", "backend")
    of_skills = suggestions.where(F.lower("name").contains("skill"))
    close = near_duplicate_names(of_skills, installed, "name", "skill", by)
    return usable.join(close, [*by, "name"], "left_anti")
