"""Queries over text: predicates, transcripts, budgets, report upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.catalog import mapping as m
from worktrail.catalog.mapping import table
from worktrail.catalog.registry import query
from worktrail.functions import text as tx
from worktrail.functions.labels import LABELS
from worktrail.operators import filters, reports, transcripts

# --- messages of the conversations table --------------------------------------------

ATTRIBUTION = "CASE conv_id % 7 WHEN 0 THEN 'agent' WHEN 1 THEN NULL ELSE 'user' END"
SAID = "CASE WHEN conv_id % 11 = 0 AND turn = 0 THEN concat(' ', chr(10)) ELSE text END"
query("f1_human_messages", "conv_id:l turn:l",
      f"SELECT conv_id, turn FROM (SELECT conv_id, turn, role, {ATTRIBUTION} AS a, {SAID} AS t FROM conversations) WHERE role = 'user' AND coalesce(a = 'user', true) AND regexp_matches(t, '\\S')")(
    lambda s, d: table(s, d, "conversations").where(tx.is_human_message(F.col("role"), F.expr(ATTRIBUTION), F.expr(SAID))))
MARKED = "CASE WHEN conv_id % 13 = turn % 13 THEN concat(text, ' record_facets') ELSE text END"
query("f2_self_generated", "conv_id:l",
      f"SELECT DISTINCT conv_id FROM (SELECT conv_id, {MARKED} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') WHERE n <= 3 AND contains(t, 'record_facets')")(
    lambda s, d: filters.self_generated(table(s, d, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), (F.col("role") == "user").alias("is_human"), F.expr(MARKED).alias("text"))).withColumnRenamed("session_id", "conv_id"))
OPENING = m.pick("(conv_id + turn) % 9", ["No, ", "please do not ", "I know. ", "again: ", "Do not worry ", "no problem, ", "Plannotator Inbox: stop ", "that is FALSCH ", "Fine; don''t "])
CORRECTED = f"concat({OPENING}, text)"
query("f11_corrections", "conv_id:l turn:l",
      "SELECT conv_id, turn FROM (SELECT conv_id, turn, " + CORRECTED + " AS t FROM conversations WHERE role = 'user') WHERE "
      "(regexp_matches(t, '(?i)^no\\b|not that|i said|\\bagain\\b|\\bstop\\b|\\bwrong\\b|\\bnein\\b|\\bfalsch\\b|\\bnochmal\\b|hab doch gesagt') OR regexp_matches(t, '(?i)(^|[.!?;:,]\\s*|\\bplease\\s+)(don[’'']?t|do not)\\b')) "
      "AND NOT regexp_matches(t, '(?i)don''t worry|no problem|stop on green') AND NOT starts_with(t, 'Plannotator Inbox:')")(
    lambda s, d: table(s, d, "conversations").where("role = 'user'").where(tx.is_correction(F.expr(CORRECTED.replace("don''t", "don\\'t")))))
query("f12_text_cuts", "doc_id:l first_prompt:s prompt:s",
      "SELECT doc_id, left(t, 300) AS first_prompt, left(t, 120) AS prompt FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.substring(tx.trimmed(F.col("text")), 1, 300).alias("first_prompt"), F.substring(tx.trimmed(F.col("text")), 1, 120).alias("prompt")))
query("f10_human_turns_flat", "conv_id:l turn:l",
      "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id % 5 <> 0 AND turn % 3 <> 2 AND (conv_id + turn) % 4 <> 1 AND regexp_matches(text, '\\S')")(
    lambda s, d: flat_humans(s, d))


def flat_humans(spark, d):
    from worktrail.sources.dialect_b import human_turn

    c = table(spark, d, "conversations")
    return c.where(human_turn(F.col("role") == "user", F.expr("conv_id % 5 = 0"), F.expr("turn % 3 = 2"), F.expr("(conv_id + turn) % 4 = 1"), F.col("text")))


W = "list_distinct(regexp_extract_all(lower({x}), '([A-Za-z0-9_]+)', 1))"
query("c5_jaccard", "conv_id:l turn:l overlap:d",
      "SELECT conv_id, turn, CASE WHEN len(u) > 0 THEN len(i)::DOUBLE / len(u) ELSE 0 END AS overlap FROM (SELECT conv_id, turn, list_intersect(a, b) AS i, list_distinct(list_concat(a, b)) AS u FROM "
      "(SELECT x.conv_id, x.turn, " + W.format(x="x.text") + " AS a, " + W.format(x="y.text") + " AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1))")(
    lambda s, d: next_turn(s, d).select("conv_id", "turn", tx.jaccard(F.col("text"), F.col("next_text")).alias("overlap")))


def next_turn(spark, d):
    c = table(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return c.join(after, ["conv_id", "turn"])


KEYS = m.pick("p_size % 6", ["fix_bug", "tool_failed", "warmup_minimal", "my_own_label", "wrong_file_or_location", "multi_file_changes"])
query("c6_display_labels", "label:s n:l",
      "SELECT CASE p_size % 6 WHEN 0 THEN 'Fix Bug' WHEN 1 THEN 'Tool Failed' WHEN 2 THEN 'Cache Warmup' WHEN 3 THEN 'My Own Label' WHEN 4 THEN 'Wrong File / Location' ELSE 'Multi-file Changes' END AS label, count(*) AS n FROM part GROUP BY 1")(
    lambda s, d: table(s, d, "part").groupBy(tx.display_label(F.expr(KEYS), LABELS).alias("label")).agg(F.count("*").alias("n")))
query("c8_word_budget", "doc_id:l words:l fits:l hard:s",
      "SELECT doc_id, len(w) AS words, CASE WHEN len(w) <= 40 THEN 1 ELSE 0 END AS fits, CASE WHEN len(w) <= 10 THEN text ELSE array_to_string(w[1:10], ' ') END AS hard FROM (SELECT doc_id, text, regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') AS w FROM documents)")(
    lambda s, d: budgets(s, d))


def budgets(spark, d):
    """As in the SQL: a vertical tab parts no words, blank text is one (empty) word, no text does not fit."""
    blanks = tx.BLANKS.replace("\x0b", "")
    words = tx.word_count(F.col("text"), blanks)
    return table(spark, d, "documents").select(
        "doc_id", F.when(words == 0, 1).otherwise(words).alias("words"), F.coalesce(words <= 40, F.lit(False)).alias("fits"), tx.fit_words(F.col("text"), 10, False, blanks).alias("hard"))


query("c8_sentence_budget", "doc_id:l cut:s",
      "SELECT doc_id, CASE WHEN total <= 40 THEN text WHEN whole IS NOT NULL THEN whole ELSE concat(hard, '…') END AS cut FROM (SELECT doc_id, any_value(text) AS text, sum(n) AS total, string_agg(s, ' ' ORDER BY i) FILTER (cum <= 40) AS whole, "
      "array_to_string(regexp_split_to_array(regexp_replace(any_value(text), '^\\s+|\\s+$', '', 'g'), '\\s+')[1:40], ' ') AS hard FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS cum FROM (SELECT doc_id, text, i, s, len(regexp_split_to_array(s, '\\s+')) AS n FROM "
      "(SELECT doc_id, text, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM documents)) WHERE s <> '')) GROUP BY doc_id)")(
    lambda s, d: table(s, d, "documents").select("doc_id", tx.fit_words(F.col("text"), 40).alias("cut")))
CWD = m.pick("c_custkey % 5", ["/home/a/Shop API", "/home/a/shop/.worktrees/Fix_1", "/srv//shop/.orca/worktrees/try-2/src", "", "/"])
query("c9_project_slug", "c_custkey:l slug:s",
      "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'shop-api' WHEN 1 THEN 'shop-fix-1' WHEN 2 THEN 'shop-try-2' ELSE 'unknown' END AS slug FROM customer")(
    lambda s, d: table(s, d, "customer").withColumn("slug", tx.project_slug(F.expr(CWD))))
REPLY = "concat('Sure! ', CASE WHEN c_custkey % 4 = 0 THEN '{oops' ELSE concat('{\"id\": ', c_custkey, ', \"seg\": {\"name\": \"', c_mktsegment, '\"}}') END, ' done')"
query("c12_json_reply", "c_custkey:l id:l seg:s",
      "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS id, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS seg FROM customer")(
    lambda s, d: table(s, d, "customer").withColumn("v", tx.json_reply(F.expr(REPLY))).select(
        "c_custkey", F.try_variant_get("v", "$.id", "bigint").alias("id"), F.try_variant_get("v", "$.seg.name", "string").alias("seg")))
CONFIG = "concat('{\"model\": {\"plan\": \"', c_mktsegment, '\", \"limits\": {\"max\": ', c_custkey, '}}, \"list\": [1, 2], \"on\": ', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, '}')"
query("c11_flat_config", "c_custkey:l key:s value:s",
      "SELECT c_custkey, 'model.plan' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'model.limits.max', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'on', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END FROM customer")(
    lambda s, d: reports.flatten_config(table(s, d, "customer").select("c_custkey", F.expr(CONFIG).alias("config")), ["c_custkey"]))

# --- transcripts ---------------------------------------------------------------------


def conversation_lines(spark, d):
    """Conversation turns as messages with text blocks."""
    c = table(spark, d, "conversations")
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit("").alias("name")))
    rows = c.select(
        F.concat(F.lit("c"), "conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text",
        ((F.col("role") == "user") & F.col("text").rlike(r"\S")).alias("is_human"), block.alias("blocks"))
    heads = c.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("c"), "conv_id").alias("session_id"), F.lit("2024-01-01").alias("start_time"), F.lit("/p").alias("project_path"), F.col("n").alias("duration_minutes"))
    return transcripts.header_lines(heads).unionByName(transcripts.transcript_lines(rows))


TRANSCRIPT = (
    "lines AS (SELECT conv_id, -1 AS turn, concat('Session: ', left(concat('c', conv_id), 8), chr(10), 'Date: 2024-01-01', chr(10), 'Project: /p', chr(10), 'Duration: ', count(*), ' min', chr(10)) AS line FROM conversations GROUP BY 1 "
    "UNION ALL SELECT conv_id, turn, CASE role WHEN 'user' THEN concat('[User]: ', left(text, 500)) ELSE concat('[Assistant]: ', left(text, 300)) END FROM conversations WHERE role IN ('user', 'assistant') AND (role <> 'user' OR regexp_matches(left(text, 500), '\\S')) AND text <> ''), "
    "tr AS (SELECT concat('c', conv_id) AS session_id, string_agg(line, chr(10) ORDER BY turn) AS text FROM lines GROUP BY 1)"
)
query("a40_transcript", "session_id:s part:l parts:l text:s", "SELECT session_id, 0 AS part, 1 AS parts, text FROM tr", [], [TRANSCRIPT])(
    lambda s, d: transcripts.transcript_parts(conversation_lines(s, d)))
query("a41_transcript_chunks", "session_id:s part:l parts:l text:s",
      "SELECT session_id, p AS part, n AS parts, substr(text, CAST(p * w + 1 AS BIGINT), w) AS text FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) AS p FROM (SELECT session_id, text, CASE WHEN length(text) > 1200 THEN 1000 ELSE 1201 END AS w, "
      "ceil(length(text)::DOUBLE / CASE WHEN length(text) > 1200 THEN 1000 ELSE 1201 END) AS n FROM tr))", [], [TRANSCRIPT])(
    lambda s, d: transcripts.transcript_parts(conversation_lines(s, d), limit=1200, chunk=1000))


def word_scores(spark, d):
    """A stand-in scorer: words and corrections per part."""
    def scorer(batch):
        return batch.assign(words=batch["text"].str.split().str.len().astype("int64"))[["session_id", "part", "words"]]

    return transcripts.score_parts(transcripts.transcript_parts(conversation_lines(spark, d)), scorer, "session_id string, part bigint, words bigint")


query("u2_part_scorer", "session_id:s part:l words:l",
      "SELECT session_id, 0 AS part, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM tr", [], [TRANSCRIPT])(word_scores)

# --- report upkeep -------------------------------------------------------------------

ENTITY = m.pick("c_custkey % 6", ["memory_backend", "model_role", "skill", "hook", "agents_md_hash", "config_hash"])
SNAP = (
    "snap AS (SELECT concat('o', c_custkey % 41) AS owner, " + ENTITY + " AS entity, concat('k', c_custkey) AS key, c_mktsegment AS a, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS b, "
    "c_custkey % 5 <> 1 AS ina, c_custkey % 5 <> 2 AS inb FROM customer)"
)


def snapshots(spark, d):
    c = table(spark, d, "customer").select(
        F.expr("concat('o', c_custkey % 41)").alias("owner"), F.expr(ENTITY).alias("entity"), F.expr("concat('k', c_custkey)").alias("key"), "c_mktsegment", "c_custkey")
    old = c.where("c_custkey % 5 <> 1").withColumn("value", F.col("c_mktsegment")).withColumn("taken_ms", F.lit(1000).cast("bigint"))
    new = c.where("c_custkey % 5 <> 2").withColumn("value", F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END"))
    return old, new


DIFF = SNAP + (", diff AS (SELECT owner, entity, key, CASE WHEN NOT ina AND inb THEN 'added' WHEN ina AND NOT inb THEN 'removed' WHEN a <> b THEN 'changed' END AS status FROM snap WHERE ina OR inb)")
query("j19_snapshot_diff", "owner:s entity:s key:s status:s", "SELECT * FROM diff WHERE status IS NOT NULL", [], [DIFF])(lambda s, d: reports.snapshot_diff(*snapshots(s, d)))
query("j19_harness_changes", "owner:s type:s key:s too_recent:l",
      "SELECT owner, key, 1 AS too_recent, CASE entity WHEN 'memory_backend' THEN 'memory_backend' WHEN 'model_role' THEN 'model_roles_changed' WHEN 'agents_md_hash' THEN 'agents_md_updated' WHEN 'config_hash' THEN 'config_changed' ELSE concat(entity, '_', status) END AS type "
      "FROM diff x WHERE status IS NOT NULL AND (entity IN ('memory_backend', 'model_role', 'agents_md_hash') OR (entity = 'config_hash' AND NOT EXISTS (SELECT 1 FROM diff y WHERE y.owner = x.owner AND y.status IS NOT NULL AND y.entity IN ('memory_backend', 'model_role'))) "
      "OR (entity IN ('skill', 'hook') AND status <> 'changed'))", [], [DIFF])(
    lambda s, d: reports.harness_changes(reports.snapshot_diff(*snapshots(s, d)), snapshots(s, d)[1].select("owner").distinct().withColumn("window_end_ms", F.lit(2000).cast("bigint"))))
query("j19_config_diff", "p_partkey:l live:s proposed:s",
      "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_brand END, '(unset)') AS live, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS proposed FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 3 = 0")(
    lambda s, d: reports.config_diff(
        table(s, d, "part").where("p_partkey % 4 <> 0").select("p_partkey", F.col("p_brand").alias("value")),
        table(s, d, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END").alias("value")), ["p_partkey"]).withColumnsRenamed({"from": "live", "to": "proposed"}))
query("j19_report_diff", "l_suppkey:l category:s status:s",
      "SELECT l_suppkey, category, CASE WHEN was AND now THEN 'persisting' WHEN now THEN 'new' ELSE 'resolved' END AS status FROM (SELECT l_suppkey, concat('c', l_partkey % 20) AS category, bool_or(l_shipdate < TIMESTAMP '1998-01-01') AS was, bool_or(l_shipdate >= TIMESTAMP '1998-01-01') AS now FROM lineitem GROUP BY 1, 2)")(
    lambda s, d: reports.category_diff(categories(s, d).where("l_shipdate < timestamp'1998-01-01'"), categories(s, d).where("l_shipdate >= timestamp'1998-01-01'"), ["l_suppkey"]))


def categories(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", F.expr("concat('c', l_partkey % 20)").alias("category"), "l_shipdate")


# Items: line items of an order; evidence: two session ids each.
EVIDENCE = "array(concat('s', l_partkey % 6), concat('s', l_suppkey % 6))"
SECTION = m.pick("l_linenumber % 3", ["Friction", "Next Steps", "Future Workflows"])


def items(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey")).select(
        F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("item_no"), F.expr(SECTION).alias("section"), F.expr(EVIDENCE).alias("evidence"))


ITEMS = f"items AS (SELECT l_orderkey AS report_id, l_linenumber AS item_no, {SECTION} AS section, [concat('s', min(l_partkey) % 6), concat('s', min(l_suppkey) % 6)] AS ev FROM lineitem GROUP BY l_orderkey, l_linenumber)"
# The same pass in item order, one item of every report per step.
GREEDY = (
    "walk AS (SELECT report_id, 0::BIGINT AS rk, 0::BIGINT AS item_no, NULL::VARCHAR AS owner, MAP {'': ''} AS claimed FROM (SELECT DISTINCT report_id FROM items) "
    "UNION ALL SELECT w.report_id, r.rk, r.item_no, coalesce(w.claimed[r.ev[1]], w.claimed[r.ev[2]]), "
    "CASE WHEN w.claimed[r.ev[1]] IS NOT NULL OR w.claimed[r.ev[2]] IS NOT NULL THEN w.claimed ELSE map_concat(w.claimed, MAP {r.ev[1]: r.section}, MAP {r.ev[2]: r.section}) END "
    "FROM walk w JOIN (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY item_no) AS rk FROM items) r ON r.report_id = w.report_id AND r.rk = w.rk + 1)"
)
query("j21_incident_claims", "report_id:l item_no:l owner:s", "SELECT report_id, item_no, owner FROM walk WHERE rk > 0", [], [ITEMS, GREEDY])(
    lambda s, d: reports.claim_incidents(items(s, d)))
query("j20_evidence_links", "report_id:l item_no:l place:l session_id:s href:s",
      "SELECT report_id, item_no, i - 1 AS place, s AS session_id, concat('file:///logs/', s, '.jsonl') AS href FROM (SELECT report_id, item_no, unnest(ev) AS s, generate_subscripts(ev, 1) AS i FROM items) WHERE s IN ('s0', 's2', 's4')", [], [ITEMS])(
    lambda s, d: reports.evidence_links(items(s, d), items(s, d).select(F.explode("evidence").alias("session_id")).distinct().withColumn(
        "path", F.when(F.col("session_id").isin("s0", "s2", "s4"), F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl"))).otherwise("")), ["report_id", "item_no"]))
TITLE = "CASE WHEN l_partkey % 9 = 0 THEN '!!' ELSE concat('Use  the-', " + m.pick("l_partkey % 4", ["Parser", "parser!", "Linter", "LINTER "]) + ") END"
RECS = f"recs AS (SELECT l_orderkey AS report_id, l_linenumber % 4 AS list_no, l_linenumber AS position, {TITLE} AS title, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS dup FROM lineitem)"


def recs(spark, d):
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min_by("l_partkey", F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("l_partkey"))
    return one.select(F.col("l_orderkey").alias("report_id"), F.expr("l_linenumber % 4").alias("list_no"), F.col("l_linenumber").alias("position"), F.expr(TITLE).alias("title"))


query("j22_distinct_recommendations", "report_id:l title_key:s list_no:l position:l",
      "SELECT * FROM (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM recs WHERE dup = 1) WHERE title_key <> '' QUALIFY row_number() OVER (PARTITION BY report_id, title_key ORDER BY list_no, position) = 1", [], [RECS])(
    lambda s, d: reports.distinct_recommendations(recs(s, d)))
CATEGORY = m.pick("p_partkey % 5", ["User Rejected Action / overreach", "wrong approach", "Big buggy code, again", "Slow", "tool failed"])
CURRENT = m.pick("p_size % 3", ["user_rejected_action", "buggy_code", "tool"])
query("j23_still_present", "p_brand:s category:s present:l",
      f"SELECT c.p_brand, c.category, max(CASE WHEN contains(concat('-', c.sl, '-'), concat('-', k.sl, '-')) THEN 1 ELSE 0 END) AS present FROM (SELECT DISTINCT p_brand, {CATEGORY} AS category, regexp_replace(regexp_replace(lower({CATEGORY}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS sl FROM part) c "
      f"LEFT JOIN (SELECT DISTINCT p_brand, replace({CURRENT}, '_', '-') AS sl FROM part WHERE p_size > 25) k ON k.p_brand = c.p_brand GROUP BY 1, 2")(
    lambda s, d: reports.still_present(table(s, d, "part").select("p_brand", F.expr(CATEGORY).alias("category")).distinct(), table(s, d, "part").where("p_size > 25").select("p_brand", F.expr(CURRENT).alias("key")), ["p_brand"]))
SOURCE = m.pick("list_no", ["usage_patterns", "features_to_try", "stop_doing", "config_additions"])
query("s15_first_actions", "report_id:l source:s position:l rank:l",
      f"SELECT report_id, source, position, row_number() OVER (PARTITION BY report_id ORDER BY CASE source WHEN 'config_additions' THEN 0 WHEN 'stop_doing' THEN 1 ELSE 2 END, position) AS rank FROM (SELECT *, {SOURCE} AS source FROM recs WHERE dup = 1) WHERE source <> 'features_to_try' QUALIFY rank <= 5", [], [RECS])(
    lambda s, d: reports.first_actions(recs(s, d).withColumn("source", F.expr(SOURCE))))
