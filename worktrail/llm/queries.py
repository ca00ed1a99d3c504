"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.llm import ann, bpe, chat, conversation, exact_dedup, langid, mixing, quality, simhash, substring, topk, url_rules, variants
from worktrail.llm.common import held_out, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# The list rules of the contract.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


@query
def op1_url_filter(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op1_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS args FROM cut),
r(rule, action) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM u JOIN r ON ('.' || host LIKE '%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY page_id),
v AS (
  SELECT page_id, host, path, rule, action, list_sort(list_distinct(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x)
    || list_transform(list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> ''), lambda x: 'p:' || x)
    || list_transform(list_filter(list_transform(string_split(args, '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'q:' || x))) AS tokens
  FROM u LEFT JOIN fit USING (page_id)),
one AS (SELECT page_id, action, unnest(tokens) AS t FROM v),
sets AS (
  SELECT page_id, action, [t] AS w FROM one
  UNION ALL SELECT a.page_id, a.action, [a.t, b.t] FROM one a JOIN one b ON a.page_id = b.page_id AND a.t < b.t
  UNION ALL SELECT a.page_id, a.action, [a.t, b.t, c.t] FROM one a JOIN one b ON a.page_id = b.page_id AND a.t < b.t JOIN one c ON b.page_id = c.page_id AND b.t < c.t),
mined AS (
  SELECT w, count(*) AS n, count(*) FILTER (action = 'block') AS blocks, count(*) FILTER (action = 'allow') AS allows FROM sets WHERE action IS NOT NULL GROUP BY w),
least AS (SELECT ceil(0.01::DOUBLE * count(*)) AS n FROM v WHERE action IS NOT NULL),
best AS (
  SELECT page_id,
    coalesce(max(CASE WHEN blocks >= least.n AND blocks / mined.n >= 0.9::DOUBLE THEN blocks / mined.n END), 0) AS b,
    coalesce(max(CASE WHEN allows >= least.n AND allows / mined.n >= 0.9::DOUBLE THEN allows / mined.n END), 0) AS a
  FROM sets JOIN mined USING (w), least GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN b > a THEN 'block' ELSE 'allow' END) AS verdict FROM v LEFT JOIN best USING (page_id)
"""


@query
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op3_chat_rotation(spark, sf_dir):
    span = lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))
    rotated = chat.rotate(table(spark, sf_dir, "conversations"))
    return rotated.withColumn("mask", F.array_join(F.transform("mask", span), ","))


ORACLES["op3_chat_rotation"] = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(10) || text), role, text) - 1 AS position FROM t),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
p AS (
  SELECT o.conv_id, speaker, position // 64 AS part, position, o.role = speaker AS own,
    CASE WHEN o.role = speaker THEN '<|assistant|>' WHEN o.role = 'system' THEN '<|system|>' ELSE '<|user name=' || replace(o.role, '<|', '< |') || '|>' END || chr(10) AS head,
    replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM o JOIN s ON o.conv_id IS NOT DISTINCT FROM s.conv_id),
q AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p)
SELECT conv_id, speaker, part, count(*)::INTEGER AS n_turns, string_agg(head || body, '' ORDER BY position) AS text,
  coalesce(string_agg((start + length(head))::VARCHAR || '-' || (start + length(head) + length(body))::VARCHAR, ',' ORDER BY position) FILTER (own), '') AS mask
FROM q GROUP BY conv_id, speaker, part
"""


@query
def op4_substring_dedup(spark, sf_dir):
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op4_substring_dedup"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM words WHERE len(w) >= 50),
windows AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM windows JOIN firsts USING (h) WHERE doc_id > first),
gone AS (SELECT doc_id, list(i) AS gone FROM covered GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS k
  FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""


@query
def op5_exact_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op5_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op6_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).taken().drop("own").withColumnRenamed("id", "doc_id")


ORACLES["op6_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(no - 1) % 3 + 1] AS weight, 3 * s AS most, sum(s) OVER () AS total FROM s),
o AS (
  SELECT *, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left, total - coalesce(sum(most) OVER before, 0) AS words_left
  FROM w WINDOW before AS (ORDER BY most::DOUBLE / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most * weight_left < weight * words_left AS is_full FROM o),
g AS (SELECT *, sum(CASE WHEN is_full THEN most ELSE 0 END) OVER () AS full_words, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS open_weight FROM f),
t AS (
  SELECT source, s AS source_size,
    CASE WHEN is_full THEN most::DOUBLE ELSE (weight * (total - full_words))::DOUBLE / open_weight::DOUBLE END AS target FROM g),
p AS (
  SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS quota,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE quota // source_size * size + least(greatest(quota % source_size - off, 0), size) END::BIGINT AS taken
FROM p
"""


@query
def op7_quality(spark, sf_dir):
    stats = stored(quality.document_statistics(table(spark, sf_dir, "documents")))
    model = quality.fit(stats, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    score = F.col("score")
    return quality.score(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score, (score >= 0.5).cast("int").alias("predicted"))


@query
def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


ORACLES["op8_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


@query
def op9_byte_bpe(spark, sf_dir):
    import public_tokenizers

    paths = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    return bpe.round_trip(table(spark, sf_dir, "documents"), *paths).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as the contract damages them; `present` is false where a row is dropped."""
    blank = F.lit(" ")
    filled = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    code = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), code.alias("code"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy"),
    )


@query
def op11_conversation_repair(spark, sf_dir):
    rows = damaged(table(spark, sf_dir, "conversations"))
    return conversation.summaries(rows, present=F.col("present")).withColumnRenamed("conv", "conv_id")


def crc32_sql(points: str) -> str:
    """CRC-32 of a list of bytes in SQL; `crc` is a row with the table of the byte steps."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {points}), lambda c, b: xor(c >> 8, crc.steps[(xor(c, b) & 255) + 1])), 4294967295)"


CRC = (
    "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), "
    "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"
)
ASCII_BYTES = "list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)"


def repair_sql() -> str:
    """Cheapest edits by the costs and audits of whole beginnings, in a recursive query."""
    add = lambda q, role: f"{{'c': {q}.c + 2, 'a': {q}.a || 'I', 'o': list_append({q}.o, '{role}:')}}"
    least = lambda *xs: f"list_sort(list_filter([{', '.join(xs)}], lambda x: x.c IS NOT NULL))[1]"
    # An added turn leads from states 0, 1 and 3 to 2, and from 2 to 3.
    added = lambda: f"q0, q1, {least('q2', add('q0', 'user'), add('q1', 'user'), add('q3', 'user'))} AS q2, {least('q3', add('q2', 'assistant'))} AS q3"
    drop = lambda q: f"{{'c': {q}.c + 3, 'a': {q}.a || 'D', 'o': {q}.o}}"
    stay = lambda q, test: f"{{'c': CASE WHEN {test} AND NOT must THEN {q}.c + extra END, 'a': {q}.a || 'K', 'o': list_append({q}.o, role || ':' || text)}}"
    name = lambda q, role: f"{{'c': CASE WHEN NOT must THEN {q}.c + extra + 2 END, 'a': {q}.a || 'R', 'o': list_append({q}.o, '{role}:' || text)}}"
    to_user = [x for q in ("q0", "q1", "q3") for x in (stay(q, "first = 'u'"), name(q, "user"))]
    typed = "{'c': NULL::BIGINT, 'a': ''::VARCHAR, 'o': []::VARCHAR[]}"
    start = typed.replace("NULL::BIGINT", "0::BIGINT")
    return f"""
WITH RECURSIVE {CRC}, raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql(ASCII_BYTES.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))} % 20 AS code FROM conversations, crc),
hurt AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE code <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
faulty AS (
  SELECT *, substr(role, 1, 1) AS first, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
rows_ AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS must, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS extra FROM faulty),
convs AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {start} AS q0, {typed} AS q1, {typed} AS q2, {typed} AS q3 FROM convs
  UNION ALL
  SELECT w.conv_id, r.i, {drop('q0')} AS q0, {least(drop('q1'), stay('q0', "first = 's'"))} AS q1, {least(drop('q2'), *to_user)} AS q2,
    {least(drop('q3'), stay('q2', "first = 'a'"), name('q2', 'assistant'))} AS q3
  FROM (SELECT conv_id, i, {added()} FROM (SELECT conv_id, i, {added()} FROM walk)) w
  JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
ends AS (
  SELECT conv_id, {least('q0', 'q3')} AS best FROM (
    SELECT conv_id, i, {added()} FROM (SELECT conv_id, i, {added()} FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1))),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLES["op11_conversation_repair"] = repair_sql()


def altered(doc_id: Column, word: Column) -> Column:
    """The contract's change of a run: one code point goes where 97 divides the CRC-32."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


@query
def op12_spelling_variants(spark, sf_dir):
    return variants.variants(table(spark, sf_dir, "documents"), alter=altered)


# Letters are one or two bytes in UTF-8. Near words: the words, or a word and
# the other, are the same without one letter.
LETTER_BYTES = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END))"
ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE {CRC},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
distinct_ AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql(LETTER_BYTES.format("id || ':' || run"))} AS h FROM distinct_, crc),
changed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT w.word, w.n, count(near.other) AS n_near, list_sort(list({{'r': -o.n, 'w': near.other}}) FILTER (near.other IS NOT NULL))[1] AS b
  FROM words w LEFT JOIN near ON near.word = w.word LEFT JOIN words o ON o.word = near.other GROUP BY w.word, w.n),
formed AS (SELECT word, n, n_near, CASE WHEN -b.r >= 2 * n THEN b.w END AS form, CASE WHEN -b.r >= 2 * n THEN -b.r END AS form_n FROM best),
chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM formed JOIN ends USING (word)
"""


@query
def op13_nearest_neighbours(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
