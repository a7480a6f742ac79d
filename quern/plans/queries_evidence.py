"""Registered queries of the remaining per-row operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import retrieval as R
from ..operators.index import current_chunks
from ..sources.io import table
from .queries_ops import LOG, log
from .queries_retrieval import FULL, hybrid_rows, pool
from .queries_verify import EVIDENCE, TURNS, evidence, turns

BOXES = ((1, [(10.0, 100.0, 10.0, "world", 0.9), (0.0, 101.0, 10.0, "hello", 0.9), (0.0, 130.0, 10.0, "next", 0.9), (5.0, 131.0, 10.0, "low", 0.1)]), (2, []), (3, [(0.0, 5.0, 4.0, " ", 0.9), (None, 5.0, 4.0, "bad", 0.9), (1.0, 5.0, 4.0, "ok", None)]), (4, None))


def ocr_lines(spark, sf):
    df = spark.createDataFrame([(k, None if b is None else [dict(zip(("x", "y", "h", "text", "score"), d)) for d in b]) for k, b in BOXES], "page_id bigint, boxes array<struct<x: double, y: double, h: double, text: string, score: double>>")
    return E.ocr_pages(df, least=0.5)


TAGGED = (
    (1, "A [Source: Plan.docx, page 2; b.pdf | Page 10] and 【Source: 'c d.pdf'】"), (2, "none"), (3, "open [Sou"), (4, "It renews in May.\n\n- *Source:* plan.docx, Page 1 [Source: plan.docx | Page 1]\n2. [Source: b.pdf, pp. 3]\nMore."), (5, "[Source: lone.md]\nText"), (6, ""),
)


def _tagged(spark):
    return spark.createDataFrame(TAGGED, "id bigint, answer string")


_TV = ", ".join("({}, '{}')".format(i, a.replace("'", "''")) for i, a in TAGGED)
_TAGGED = f"v AS (SELECT CAST(id AS BIGINT) AS id, answer FROM (VALUES {_TV}) v(id, answer))"


def citation_rows(spark, sf):
    return E.citations(_tagged(spark)).select("id", "cited_file", "cited_page")


_NAME = lambda x: f"lower(trim(regexp_replace(regexp_replace({x}, '[‐-―−]', '-', 'g'), '\\s+', ' ', 'g')))"
CITATION_ROWS = f"""WITH {_TAGGED}, t AS (SELECT id, unnest(flatten(list_transform(regexp_extract_all(answer, $${E.TAG}$$, 1), lambda x: string_split(x, ';')))) AS part FROM v),
p AS (SELECT id, {_NAME("regexp_replace(regexp_extract(part, '" + E.TAG_PART + "', 1), $$^\\s*[\"']|[\"']\\s*$$, '', 'g')")} AS cited_file, TRY_CAST(regexp_extract(part, '{E.TAG_PART}', 2) AS BIGINT) AS cited_page FROM t)
SELECT * FROM p WHERE cited_file <> ''"""


def citation_folding(spark, sf):
    """Answers with tags alone on their line, and with a tag that is still open."""
    return _tagged(spark).select("id", E.fold_source_lines(F.col("answer")).alias("folded"), E.drop_open_tag(F.col("answer")).alias("closed"))


_LINE = "(?i)(\\S)[ \\t]*((?:\\n[ \\t]*)*)\\n[ \\t]*(?:[-*+]|\\d+[.)])?[ \\t]*((?:[ \\t]*[\\[【]\\s*Source:[^\\]】]*[\\]】])+)[ \\t]*(\\n|$)"
_FOLD = lambda x: f"regexp_replace({x}, '{_LINE}', '\\1 \\3\\2\\4', 'g')"
CITATION_FOLDING = f"""WITH {_TAGGED}, o AS (SELECT *, lower(regexp_extract(answer, '{E.OPEN_TAIL}', 1)) AS tail FROM v)
SELECT id, {_FOLD(_FOLD("regexp_replace(answer, '(?i)(?:\\*\\*|\\*|_)Sources?:(?:\\*\\*|\\*|_)?[^\\n\\[【]*([\\[【]\\s*Source:)', '\\1', 'g')"))} AS folded,
 CASE WHEN regexp_matches(answer, '{E.OPEN_TAIL}') AND (starts_with('source:', tail) OR starts_with(tail, 'source:')) THEN regexp_replace(answer, '{E.OPEN_TAIL}', '') ELSE answer END AS closed FROM o"""


def passage_highlights(spark, sf):
    """What of each cited page its answer repeats."""
    rows = evidence(spark, sf).filter("source IS NOT NULL")
    return E.highlight(rows, "source", "answer").select("session_id", "turn", F.size("spans").cast("bigint").alias("n_spans"))


_HW = lambda x: f"regexp_extract_all(coalesce({x}, ''), $${E.WORD}$$)"
_HP = lambda w: f"regexp_replace(lower({w}), '[.,]', '', 'g')"
_HC = f"({_HP('w')} NOT IN ({', '.join(repr(w) for w in E.COMMON)}))"
PASSAGE_HIGHLIGHTS = f"""WITH {EVIDENCE}, w AS (SELECT session_id, turn, {_HW('source')} AS ws, string_split_regex(source, $${E.WORD}$$) AS gs, list_distinct(list_transform({_HW('answer')}, lambda w: {_HP('w')})) AS said FROM ev WHERE source IS NOT NULL),
c AS (SELECT session_id, turn, array_to_string(list_transform(ws, lambda w, i: CASE WHEN regexp_matches(gs[i], '{E.RUN_GAP}') THEN '' ELSE '|' END || CASE WHEN NOT list_contains(said, {_HP('w')}) THEN 'o'
 WHEN regexp_matches({_HP('w')}, '\\d') AND length({_HP('w')}) >= 2 OR length({_HP('w')}) >= 6 AND {_HC} OR regexp_matches(w, '^[A-Z]{{3,}}$') THEN 'T' WHEN {_HC} THEN 'C' ELSE 'S' END), '') AS code FROM w)
SELECT session_id, turn, len(list_filter(regexp_extract_all(code, '[TCS]+'), lambda r: contains(r, 'T') OR contains(r, 'C') AND length(r) > 1)) AS n_spans FROM c"""


def next_questions(spark, sf):
    """The golden queries as suggestions for every session, by topic of their first keyword."""
    order = Window.orderBy("query")  # 40 fixed rows
    p = table(spark, sf, "golden_queries").select("query", "expected_keywords").distinct().select(F.coalesce(F.get("expected_keywords", F.lit(0)), F.lit("other")).alias("label"), F.col("query").alias("prompt"), F.row_number().over(order).cast("bigint").alias("ord"))
    t = turns(spark, sf).groupBy("session_id").agg(F.collect_list("query").alias("asked"), F.max_by(F.concat_ws(" ", "query", "answer"), "turn").alias("last"))
    return E.next_questions(p, t)


_W = lambda x: f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')), lambda w: length(w) > 2 AND NOT list_contains([{', '.join(repr(w) for w in E.COMMON_TOPICS)}], w))"
NEXT_QUESTIONS = f"""WITH {TURNS}, p AS (SELECT coalesce(expected_keywords[1], 'other') AS label, query AS prompt, row_number() OVER (ORDER BY query) AS ord FROM (SELECT DISTINCT query, expected_keywords FROM golden_queries)),
s AS (SELECT session_id, list(query) AS asked, max_by(concat_ws(' ', query, answer), turn) AS last FROM t GROUP BY 1),
b AS (SELECT *, len(list_intersect({_W("concat_ws(' ', label, prompt)")}, {_W('last')})) AS score FROM s, p WHERE len(list_filter(asked, lambda a: lower(trim(regexp_replace(a, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(prompt, '\\s+', ' ', 'g'))))) = 0),
n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY session_id, label ORDER BY score DESC, ord) <= 2)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, ord) AS place, label, prompt, score FROM n QUALIFY place <= 3"""


def source_projection(spark, sf):
    rows = R.top_k(hybrid_rows(spark, sf).drop("rank"), 5).join(pool(spark, sf), "chunk_id")
    return rows.select("query_id", "chunk_id", "filename", "page", F.substring("text", 1, 200).alias("text"), F.round("score", 4).alias("score"))


SOURCE_PROJECTION = f"{FULL}, r AS (SELECT query_id, chunk_id, score FROM hyb QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5) SELECT query_id, chunk_id, filename, page, substring(text, 1, 200) AS text, round(score, 4) AS score FROM r JOIN pool USING (chunk_id)"


def log_payload(spark, sf):
    d = {"model": "none", "failure_type": "NONE", "healing_action": "NONE", "reflection_reason": ""}
    return log(spark, sf).select("event_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in d.items()], E.model_tier(F.col("model")).alias("tier"), F.coalesce("attempts", F.lit(1)).cast("bigint").alias("attempts"))


LOG_PAYLOAD = f"""WITH {LOG} SELECT event_id, coalesce(model, 'none') AS model, coalesce(failure_type, 'NONE') AS failure_type, coalesce(healing_action, 'NONE') AS healing_action, coalesce(reflection_reason, '') AS reflection_reason,
 CASE WHEN coalesce(model, '') IN ('', 'none') THEN 'none' WHEN regexp_matches(lower(model), '8b|mini|small|instant|20b') THEN 'fast' ELSE 'strong' END AS tier, coalesce(attempts, 1) AS attempts FROM log"""


def lru_cache(spark, sf):
    """Caches of 5 questions a failure type, by last use; repeated feedback rows are further uses."""
    e = table(spark, sf, "feedback_logs").filter("query IS NOT NULL").select(F.coalesce("failure_type", F.lit("NONE")).alias("cache"), F.col("query").alias("key"), F.col("created_at").alias("used"))
    return E.lru_keep(e, 5).select("cache", "key")


LRU_CACHE = "WITH e AS (SELECT coalesce(failure_type, 'NONE') AS cache, query AS key, max(created_at) AS used FROM feedback_logs WHERE query IS NOT NULL GROUP BY 1, 2) SELECT cache, key FROM e QUALIFY row_number() OVER (PARTITION BY cache ORDER BY used DESC NULLS LAST, key) <= 5"


def best_attempt(spark, sf):
    """Of each question's feedback in order the last result stays, however good an earlier one was."""
    r = table(spark, sf, "feedback_logs").dropDuplicates(["id"]).filter("query IS NOT NULL")
    at = F.struct("created_at", "id")
    return r.groupBy("query").agg(F.count("*").alias("attempts"), F.max_by("success", at).alias("last"), F.max_by("fix_applied", at).alias("fix"))


BEST_ATTEMPT = "WITH r AS (SELECT * FROM feedback_logs WHERE query IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1) SELECT query, count(*) AS attempts, arg_max_null(success, (created_at, id)) AS last, arg_max_null(fix_applied, (created_at, id)) AS fix FROM r GROUP BY 1"


def refreshed_files(spark, sf):
    """Registered names that several files share: a refresh of the name touches all of them."""
    r = table(spark, sf, "file_register").filter("filename IS NOT NULL AND NOT coalesce(is_deleted, false)")
    n = r.groupBy("filename").agg(F.count("*").alias("files"))
    return current_chunks(table(spark, sf, "chunks")).groupBy("filename").agg(F.count("*").alias("chunks")).join(n, "filename")


REFRESHED_FILES = "WITH n AS (SELECT filename, count(*) AS files FROM file_register WHERE filename IS NOT NULL AND NOT coalesce(is_deleted, false) GROUP BY 1), c AS (SELECT filename, count(*) AS chunks FROM (SELECT chunk_id, min(metadata.filename) AS filename FROM chunks GROUP BY 1) GROUP BY 1) SELECT filename, chunks, files FROM c JOIN n USING (filename)"

JOBS = ((1, 1, "queued"), (1, 2, "started"), (1, 3, "page"), (1, 4, "done"), (1, 5, "failed"), (2, 1, "queued"), (2, 2, "cancelled"), (2, 3, "started"), (3, 1, "queued"), (3, 2, "failed"), (3, 3, "started"), (4, 1, "odd"))
KEYS = (("p", "a", 5, None), ("p", "b", 3, 50), ("p", "c", 9, 200), ("q", "d", 1, 300), ("q", "e", 1, 250))


def background_jobs(spark, sf):
    return E.job_states(spark.createDataFrame(JOBS, "job bigint, seq bigint, event string"))


def key_choice(spark, sf):
    return E.pick_key(spark.createDataFrame(KEYS, "pool string, key string, uses bigint, blocked_until bigint"), F.lit(100))


_JV = ", ".join(f"({j}, {q}, '{e}')" for j, q, e in JOBS)
BACKGROUND_JOBS = f"""WITH RECURSIVE e AS (SELECT CAST(job AS BIGINT) AS job, row_number() OVER (PARTITION BY job ORDER BY seq) AS n, event FROM (VALUES {_JV}) v(job, seq, event)),
s AS (SELECT job, CAST(0 AS BIGINT) AS n, 'unknown' AS state FROM (SELECT DISTINCT job FROM e) UNION ALL SELECT e.job, e.n, CASE WHEN state IN ('ready', 'cancelled') THEN state WHEN event = 'queued' THEN 'pending' WHEN event IN ('started', 'page') THEN 'processing'
 WHEN event = 'done' THEN 'ready' WHEN event = 'failed' THEN 'failed' WHEN event = 'cancelled' THEN 'cancelled' ELSE state END FROM s JOIN e ON e.job = s.job AND e.n = s.n + 1)
SELECT job, state FROM s QUALIFY row_number() OVER (PARTITION BY job ORDER BY n DESC) = 1"""
_KV = ", ".join(f"('{p}', '{k}', {u}, {'NULL' if b is None else b})" for p, k, u, b in KEYS)
KEY_CHOICE = f"""WITH v AS (SELECT *, blocked_until IS NULL OR blocked_until <= 100 AS free FROM (VALUES {_KV}) v(pool, key, uses, blocked_until))
SELECT pool, key, free FROM v QUALIFY row_number() OVER (PARTITION BY pool ORDER BY free DESC, CASE WHEN free THEN uses END, CASE WHEN NOT free THEN blocked_until END, key) = 1"""


def queries():
    fs = (ocr_lines, citation_rows, citation_folding, passage_highlights, next_questions, source_projection, log_payload, lru_cache, best_attempt, refreshed_files, background_jobs, key_choice)
    return {f.__name__: f for f in fs}


def oracle_sql():
    g = globals()
    return {n: g[n.upper()] for n in queries() if n.upper() in g}
