"""URL filtering by list rules and by mined association rules.

A list rule such as `example.com/en/` fits its host and all subdomains where
the path starts with the rule's; the longest wins. Urls that no list rule fits
are judged by rules of the form token set -> verdict, which Spark's FP-growth
mines from labelled urls. Mined rules are pruned by support and confidence,
and kept in an inverted index under their rarest token: a url's tokens look
up only rules that can match, and the whole set is then compared. A url is
blocked where its surest matching rule says so; without one, or on a tie, it
is allowed.

Hosts lose A-Z case only. A null url, or one without `://`, has an empty host
and path, has no tokens and is allowed. An empty path fits no rule. Repeated
rows and ids are judged each by its url; other columns are left out. Without
labelled urls nothing is mined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.llm.common import fold_ascii, stored

BLOCK, ALLOW = "y:block", "y:allow"


def host_of(url: Column) -> Column:
    return fold_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def list_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, action) of the longest list rule that fits, else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=len):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(rules[text])).otherwise(action)
    return rule, action


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: host labels, path segments with digits as #, query keys."""
    segments = F.split(F.regexp_replace(path, "[0-9]+", "#"), "/")
    keys = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    full = lambda prefix, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    return F.array_sort(F.array_distinct(F.concat(
        full("h:", F.split(host, r"\.")), full("p:", segments), full("q:", F.transform(keys, lambda x: F.split_part(x, F.lit("="), F.lit(1)))),
    )))


def mine(labelled: DataFrame, min_support: float, min_confidence: float, most_tokens: int) -> DataFrame:
    """(tokens, blocks, confidence, support) of the rules mined from rows (tokens, action)."""
    label = F.when(F.col("action") == "block", BLOCK).otherwise(ALLOW)
    transactions = stored(labelled.select(F.array_append("tokens", label).alias("items")))
    found = stored(FPGrowth(itemsCol="items", minSupport=min_support).fit(transactions).freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    labels = F.array(F.lit(ALLOW), F.lit(BLOCK))
    plain = found.select(F.col("items").alias("tokens"), F.col("freq").alias("all_freq"))
    rules = found.where(F.arrays_overlap("items", labels)).select(
        F.array_except("items", labels).alias("tokens"), F.array_contains("items", BLOCK).alias("blocks"), "freq",
    )
    rules = rules.where(F.size("tokens").between(1, most_tokens)).join(plain, "tokens")
    return rules.select("tokens", "blocks", (F.col("freq") / F.col("all_freq")).alias("confidence"), F.col("freq").alias("support")).where(F.col("confidence") >= min_confidence)


def inverted_index(rules: DataFrame) -> DataFrame:
    """(token, tokens, blocks, confidence): each rule under the token that fewest rules have."""
    each = rules.select("*", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(counts, "token").groupBy("tokens", "blocks", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return rarest.select("token", "tokens", "blocks", "confidence")


def match(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, block_confidence, allow_confidence) of the token sets that some rule matches."""
    index = inverted_index(rules).withColumnRenamed("tokens", "wanted")
    looked_up = token_sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    hits = looked_up.where(F.size(F.array_except("wanted", "tokens")) == 0)
    best = lambda blocks: F.coalesce(F.max(F.when(F.col("blocks") == blocks, F.col("confidence"))), F.lit(0.0))
    return hits.groupBy("tokens").agg(best(True).alias("block_confidence"), best(False).alias("allow_confidence"))


def judge(
    pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None, *,
    min_support: float = 0.01, min_confidence: float = 0.9, most_tokens: int = 3,
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    `labelled` has (url, action: block or allow); by default the urls of
    `pages` that list rules fit, so that what is mined carries the list over to
    urls it doesn't name.
    """
    def taken_apart(df, column, *others):
        url = F.col(column)
        split = df.select(*others, url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
        return split.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))

    rule, action = list_rule(F.col("host"), F.col("path"), rules)
    rows = stored(taken_apart(pages, url_col, F.col(id_col).alias("id")).select("id", "host", "path", "tokens", rule.alias("rule"), action.alias("action")))
    known = rows.where("action is not null") if labelled is None else taken_apart(labelled.where("action is not null"), "url", "action")
    mined = stored(mine(known.select("tokens", "action"), min_support, min_confidence, most_tokens))
    matched = stored(match(rows.where("action is null").select("tokens").distinct(), mined))
    open_rows = rows.where("action is null").join(matched, "tokens", "left").withColumn(
        "action", F.when(F.col("block_confidence") > F.col("allow_confidence"), "block").otherwise("allow")
    )
    columns = [F.col("id").alias(id_col), "host", "path", "rule", F.col("action").alias("verdict")]
    return rows.where("action is not null").select(*columns).union(open_rows.select(*columns))
