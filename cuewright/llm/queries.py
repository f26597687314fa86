"""The operators' registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, filter_audit, hard_negatives, jaccard_join, line_dedup, lm_scoring, mixing, quality, substring_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = line_dedup.dedup(docs.select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines")))
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.length(F.coalesce("text", F.lit(""))).alias("kept_chars"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents")).drop("text_hash")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("text_hash")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(spark, _table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_chats(turns))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
"""

OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
s AS (SELECT *, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS w FROM l),
d AS (SELECT w, len(w) AS n, min((doc_id, i)) AS first FROM s WHERE len(w) > 0 GROUP BY w),
f AS (SELECT word, count(*) AS c FROM (SELECT unnest(w) AS word FROM d) GROUP BY word),
o AS (
  SELECT w, n, first, word, row_number() OVER (PARTITION BY w ORDER BY c, word) AS k
  FROM (SELECT w, n, first, unnest(w) AS word FROM d) JOIN f USING (word)),
p AS (SELECT * FROM o WHERE k <= n - ceil(n * 0.8 - 1e-9) + 1),
c AS (
  SELECT DISTINCT a.w AS w, b.w AS v FROM p a JOIN p b
    ON a.word = b.word AND b.first < a.first AND a.n * 0.8 - 1e-9 <= b.n AND b.n * 0.8 - 1e-9 <= a.n),
g AS (SELECT DISTINCT w FROM c WHERE len(list_intersect(w, v)) >= 0.8 * (len(w) + len(v) - len(list_intersect(w, v))) - 1e-9),
k AS (
  SELECT s.doc_id, s.i, s.line, len(s.w) = 0 OR ((s.doc_id, s.i) = d.first AND g.w IS NULL) AS stays
  FROM s LEFT JOIN d ON s.w = d.w LEFT JOIN g ON s.w = g.w),
r AS (SELECT doc_id, count(*)::INT AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '') AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(len(kept), 0)::INT AS kept_chars
FROM documents LEFT JOIN r USING (doc_id)
"""

OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS word
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents)),
g AS (
  SELECT doc_id, i, word, CASE WHEN count(*) OVER r = 35 THEN md5(string_agg(word, ' ') OVER r) END AS h
  FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
m AS (SELECT doc_id, i, word, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS again FROM g),
k AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
s AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN s USING (doc_id)
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, list_extract([5.0, 2.0, 1.0], (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE AS weight,
    source_size::DOUBLE * 2 AS cap FROM s),
f AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER o, 0) AS capped, coalesce(sum(weight) OVER o, 0) AS spent
  FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - capped) / (all_weight - spent) AS level, (budget - capped) / (all_weight - spent) * weight >= cap AS over FROM f),
t AS (
  SELECT source, source_size, CASE WHEN over OR m IS NULL THEN cap ELSE m * weight END AS target
  FROM (SELECT *, (SELECT arg_min(level, cap / weight) FROM l WHERE NOT over) AS m FROM l)),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS due FROM t),
r AS (SELECT *, least(floor(due), 2)::BIGINT AS sure FROM p),
j AS (
  SELECT d.doc_id, d.size, r.source, r.source_size, r.target, r.sure, r.target - r.sure * r.source_size AS rest, r.due - r.sure AS p,
    ((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':17'), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM j),
c AS (SELECT *, coalesce(sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM q),
x AS (SELECT *, CASE WHEN size > 0 THEN sure + (q IS NOT NULL AND done + size / 2.0 <= rest)::BIGINT ELSE 0 END AS copies FROM c)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM x
"""


def _sql_literal(text: str) -> str:
    return text.replace("'", "''")


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, len(regexp_replace(role, '(CONTROL)', '\\\1', 'g')) + len(regexp_replace(text, '(CONTROL)', '\\\1', 'g')) + MARKS AS n FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS a,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS b, sum(n)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(a) AS turns_sha256, len(b)::BIGINT AS loss_chars, sha256(b) AS loss_sha256, formatted_chars FROM g
""".replace("CONTROL", _sql_literal("|".join("".join(f"\\{c}" if not c.isalnum() and c not in "_<>/" else c for c in x) for x in (*chat.CONTROL, "\\")))).replace("MARKS", str(len(chat.TURN + chat.BODY + chat.END)))

OP12_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, label, generate_subscripts(v, 1) AS i, floor(256 * unnest(v)::DOUBLE)::BIGINT AS c FROM e),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, sum(a.c * b.c)::BIGINT AS score
  FROM x a JOIN x b ON a.i = b.i WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad,
    map(['A', 'B', 'C', 'D', 'E'], [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * len(text),
      regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)]) AS fails
  FROM t LEFT JOIN l USING (doc_id)),
c AS (
  SELECT part, fails, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: fails[f]) AS failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM d GROUP BY ALL),
f(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS before FROM o, range(1, 6) r(step)),
x AS (
  SELECT part, filter_order, step, own, list_contains(failed, own) AS fails_own, len(list_intersect(failed, before)) > 0 AS gone, len(failed) = 1 AS alone, n, good, bad
  FROM c, s),
g AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT fails_own THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND fails_own THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND fails_own THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails_own AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND fails_own THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND fails_own THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM g
"""

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_chat_format": op10_chat_format,
    "op11_token_counts": op11_token_counts,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE = {"op1_exact_dedup": OP1_SQL, "op2_line_dedup": OP2_SQL, "op7_substring_dedup": OP7_SQL, "op9_mixing": OP9_SQL, "op10_chat_format": OP10_SQL, "op12_hard_negatives": OP12_SQL, "op13_filter_audit": OP13_SQL}
