"""Text predicates and small string expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that name a review.
REVIEW_WORDS = [
    "review", "reviews", "reviewer", "reviewers", "reviewed", "reviewing",
    "verdict", "approve", "approved", "approval",
]

# Phrases that make a message a correction, phrases that never
# do, and openings of messages a tool wrote on the user's behalf.
CORRECTION_PHRASES = [
    r"^no\b", r"not that", r"i said", r"\bagain\b", r"\bstop\b",
    r"(?:^|[.!?;:,]\s*|\bplease\s+)(?:don[’']?t|do not)\b",
    r"\bwrong\b", r"\bnein\b", r"\bfalsch\b", r"\bnochmal\b", r"hab doch gesagt",
]
NOT_CORRECTIONS = [r"don't worry", r"no problem", r"stop on green"]
INJECTED_OPENINGS = [r"^Plannotator Inbox:", r"^You are working inside Orca\b"]

# Openings after an abort that mean a change of course.
COURSE_CORRECTION = r"^(?:no|nope|wait|stop|not that|instead|actually|hold on)\b"

# Word budgets per report field (section, list, field, words, ellipsis).
WORD_BUDGETS = [
    ("friction_analysis", "ongoing", "description", 40, True),
    ("what_works", "impressive_workflows", "description", 40, True),
    ("suggestions", "stop_doing", "why", 40, True),
    ("suggestions", "config_additions", "why", 40, True),
    ("suggestions", "features_to_try", "why_for_you", 40, True),
    ("suggestions", "usage_patterns", "detail", 40, True),
    ("on_the_horizon", "opportunities", "whats_possible", 40, True),
    ("interaction_style", "blocks", "body", 60, True),
    ("interaction_style", None, "key_pattern", 30, True),
    ("suggestions", "config_additions", "title", 10, False),
    ("suggestions", "features_to_try", "title", 10, False),
    ("suggestions", "usage_patterns", "title", 10, False),
    ("suggestions", "stop_doing", "title", 10, False),
    ("friction_analysis", "ongoing", "title", 10, False),
]

WORDS = r"[A-Za-z0-9_]+"
BLANKS = " \t\n\x0b\f\r"  # fixed value: white space that parts words


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches_any(text: Column, patterns: Sequence[str], ignore_case: bool = True) -> Column:
    """True if any pattern is found; alternation keeps it one regex per row."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return F.coalesce(text.rlike(("(?i)" if ignore_case else "") + joined), F.lit(False))


def trimmed(text: Column, blanks: str = BLANKS) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(text, F.lit(blanks))


def is_human_message(role: Column, attribution: Column, text: Column) -> Column:
    """User role, attributed to the user or to nobody, and not blank."""
    return (
        (role == "user")
        & F.coalesce(attribution == "user", F.lit(True))
        & F.coalesce(text.rlike(r"\S"), F.lit(False))
    )


def is_correction(text: Column) -> Column:
    body = trimmed(text)
    return (
        matches_any(body, CORRECTION_PHRASES)
        & ~matches_any(body, NOT_CORRECTIONS)
        & ~matches_any(body, INJECTED_OPENINGS, ignore_case=False)
    )


def word_parts(text: Column) -> Column:
    """Lower-case parts split at punctuation, camel humps and digits."""
    parts = F.regexp_extract_all(text, F.lit(r"([A-Z]*[a-z]+|[A-Z]+|[0-9]+)"), 1)
    return F.transform(parts, F.lower)


def names_any(text: Column, words: Sequence[str]) -> Column:
    """A whole part of the text is one of `words`."""
    return F.coalesce(F.arrays_overlap(word_parts(text), F.array(*[F.lit(w) for w in words])), F.lit(False))


def names_review(text: Column) -> Column:
    return names_any(text, REVIEW_WORDS)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({WORDS})"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of the two word sets; 0 when both are empty."""
    left, right = word_set(a), word_set(b)
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))


def display_label(key: Column, labels: dict[str, str]) -> Column:
    """Mapped label, else the key in title case with underscores as blanks."""
    words = F.split(F.regexp_replace(key, "_", " "), " ")
    title = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    fallback = F.array_join(title, " ")
    return F.coalesce(lookup(key, labels), fallback)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a fixed table (a literal map: no join, no shuffle)."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def word_count(text: Column, blanks: str = BLANKS) -> Column:
    body = trimmed(text, blanks)
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, f"[{blanks}]+")))


def first_words(text: Column, limit: Column | int, blanks: str = BLANKS) -> Column:
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.array_join(F.slice(F.split(trimmed(text, blanks), f"[{blanks}]+"), F.lit(1), limit), " ")


def fit_words(text: Column, limit: Column | int, ellipsis: Column | bool = True, blanks: str = BLANKS) -> Column:
    """Cut to whole sentences within the budget, else to the first words.

    A sentence ends at . ! or ? followed by white space, so a decimal point
    does not end one.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    ellipsis = F.lit(ellipsis) if isinstance(ellipsis, bool) else ellipsis
    return let(trimmed(text, blanks), lambda body: F.when(word_count(body, blanks) <= limit, text).otherwise(
        F.when(ellipsis, _whole_sentences(body, limit, blanks)).otherwise(first_words(body, limit, blanks))
    ))


def fit_report_fields(fields: DataFrame) -> DataFrame:
    """Cut the text of report fields (section, list, field, text, ...) to their budgets."""
    budgets = {"|".join((section, of or "", field)): (words, ellipsis) for section, of, field, words, ellipsis in WORD_BUDGETS}
    key = F.concat_ws("|", "section", F.coalesce("list", F.lit("")), "field")
    fitted = F.col("text")
    for words, ellipsis in sorted(set(budgets.values())):
        names = [k for k, v in budgets.items() if v == (words, ellipsis)]
        fitted = F.when(key.isin(*names), fit_words(F.col("text"), words, ellipsis)).otherwise(fitted)
    return fields.withColumn("text", fitted)


def _whole_sentences(body: Column, limit: Column, blanks: str = BLANKS) -> Column:
    """The longest run of leading sentences that fits, else the first words."""
    marked = F.regexp_replace(body, f"([.!?])[{blanks}]+", "$1\u0001")
    sentences = F.filter(F.transform(F.split(marked, "\u0001"), lambda s: trimmed(s, blanks)), lambda s: s != "")

    def fitting(parts: Column) -> Column:
        # Running word count and number of sentences taken; NULL words: closed.
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("taken"))
        step = lambda acc, n: F.struct(
            F.when(acc["words"] + n <= limit, acc["words"] + n).alias("words"),
            F.when(acc["words"] + n <= limit, acc["taken"] + 1).otherwise(acc["taken"]).alias("taken"),
        )
        taken = F.aggregate(F.transform(parts, lambda s: word_count(s, blanks)), start, step)["taken"]
        return let(taken, lambda k: F.when(k > 0, F.array_join(F.slice(parts, F.lit(1), k), " ")).otherwise(
            F.concat(first_words(body, limit, blanks), F.lit("…"))
        ))

    return let(sentences, fitting)


def last_segment(path: Column) -> Column:
    """Text after the last slash, the whole path if that is empty."""
    tail = F.regexp_replace(path, r"^.*/", "")
    return F.when(tail == "", path).otherwise(tail)


def project_slug(cwd: Column) -> Column:
    """Short project name; a worktree path gives repository-worktree."""
    clean = F.regexp_replace(F.coalesce(cwd, F.lit("")), r"/+", "/")
    worktree = r"(?:^|/)([^/]+)/(?:\.orca/worktrees|\.worktrees)/([^/]+)"
    repo, name = F.regexp_extract(clean, worktree, 1), F.regexp_extract(clean, worktree, 2)
    plain = F.regexp_extract(clean, r"([^/]+)/?$", 1)
    raw = F.when(repo != "", F.concat_ws("-", repo, name)).otherwise(plain)
    slug = F.regexp_replace(F.regexp_replace(F.lower(raw), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    slug = F.substring(slug, 1, 40)
    return F.when(slug == "", F.lit("unknown")).otherwise(slug)


def category_slug(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(label), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def json_reply(text: Column) -> Column:
    """The outermost braces of a model reply as a variant, NULL if not JSON."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(body != "", F.try_parse_json(body))
