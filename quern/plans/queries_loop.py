"""Registered queries of the answer loop: outcomes on planted answers, plans of several steps, suggestions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.index import parent_texts
from ..plugins import NOT_FOUND, UNAVAILABLE, Plugins, first_sentence
from ..sources.io import table
from . import pipeline
from .queries_retrieval import BASE, _rank, gold, pool, query_vectors, vectors
from .queries_text import WORDS
from .queries_verify import _HEAL, EVIDENCE, REFLECT_DECISION

_SRC = "the storage crew pays for every move of the office and keeps all records of it for seven years"
_GOOD = "the storage crew pays for every move of the office and keeps all records of it"
_THIN = "the storage crew said alpha beta gamma delta epsilon zeta eta theta iota"
#: (query_id, attempt, strong, answer, context, best score, chunks): what a generator would say, by attempt and model.
PLANTED = (
    (1, 0, False, _GOOD, _SRC, 2.0, 3), (2, 0, False, _THIN, _SRC, 2.0, 3), (2, 1, False, _THIN, _SRC, 2.0, 3), (2, 2, False, _THIN, _SRC, 2.0, 3),
    (3, 0, False, "Not found in the document.", _SRC, 4.2, 3), (3, 1, True, _GOOD, _SRC, 4.2, 3), (4, 0, False, "Not found in the document.", _SRC, 1.0, 3),
    (5, 0, False, None, None, None, 0), (5, 1, False, None, None, None, 0), (5, 2, False, None, None, None, 0), (6, 0, False, None, None, None, 0), (6, 1, False, _GOOD, _SRC, 2.0, 3),
    (7, 0, False, "short", _SRC, 2.0, 3), (7, 1, False, UNAVAILABLE, _SRC, 2.0, 3), (8, 0, False, _GOOD + " 99", _SRC, 2.0, 3), (8, 1, True, _GOOD + " 98", _SRC, 2.0, 3),
    (9, 0, False, "doubtful crew pays office move, surely with alpha beta gamma delta", _SRC, 2.0, 3), (9, 1, False, _GOOD, _SRC, 2.0, 3),
    (10, 0, False, "too short", _SRC, 2.0, 3), (10, 1, False, "too short", _SRC, 2.0, 3), (10, 2, False, "too short", _SRC, 2.0, 3),
    (11, 0, False, "nothing said here was ever true about birds or trees or lakes", _SRC, 2.0, 3), (11, 1, False, "nothing said here was ever true about birds or trees or lakes", _SRC, 2.0, 3), (11, 2, False, "nothing said here was ever true about birds or trees or lakes", _SRC, 2.0, 3),
    (12, 0, False, _GOOD + " 77", _SRC, 2.0, 3), (12, 1, True, _GOOD, _SRC, 2.0, 3), (13, 0, False, "Not found in the document.", _SRC, 9.0, 3), (13, 1, True, "Not found in the document.", _SRC, 9.0, 3),
)
ASKED = "who pays for it?"


def loop_outcomes(spark, sf):
    """Every outcome of the loop: accepted, refused, asked again, healed, doubted by the judge, nothing found, outage."""
    planted = spark.createDataFrame(PLANTED, "query_id bigint, attempt int, strong boolean, answer string, context string, score double, n_chunks bigint")
    asked = planted.select("query_id").distinct().withColumn("query", F.lit(ASKED))

    def attempt_of(open_, k):
        mine = planted.filter(F.col("attempt") == k).drop("attempt").withColumnRenamed("strong", "force_strong")
        return open_.join(mine, ["query_id", "force_strong"]).withColumn("model", F.when(F.col("force_strong"), "strong").otherwise("fast"))

    judge = lambda rows: rows.select("query_id", (~F.contains(F.col("answer"), F.lit("doubtful"))).alias("faithful"))
    out = pipeline.heal(pipeline.start_state(asked, F.lit("qa")), attempt_of, Plugins(judge=judge))
    return out.select("query_id", "answer", "reason", F.round("confidence", 6).alias("confidence"), "failure_type", F.col("attempts").cast("bigint").alias("attempts"), "reflected", "model", "action")


def _literal(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


_PV = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in PLANTED)
_CORE = REFLECT_DECISION[len(f"WITH {EVIDENCE}, ") : REFLECT_DECISION.index("\nSELECT session_id, turn, CAST(attempt")]
_CORE = _CORE.replace("k AS (SELECT h.*, attempt, strong FROM h, (VALUES (0), (1), (2)) a(attempt), (VALUES (false), (true)) s(strong))", "k AS (SELECT * FROM h)")
LOOP_OUTCOMES = f"""WITH RECURSIVE ev AS (SELECT CAST(query_id AS BIGINT) AS query_id, attempt, strong, answer, source, score, n_chunks, '{ASKED}' AS query FROM (VALUES {_PV}) v(query_id, attempt, strong, answer, source, score, n_chunks)), {_CORE},
e AS (SELECT *, coalesce(answer, '') = '{UNAVAILABLE}' AS outage, coalesce(n_chunks, 0) = 0 AS nothing, reason = 'passed_all_checks' AND confidence >= 0.4 AS passed, attempt = 0 AND reason = 'passed_all_checks' AND confidence >= 0.4 AND confidence < 0.7 AND contains(answer, 'doubtful') AS doubted FROM d),
x AS (SELECT *, CASE WHEN outage THEN 'UNKNOWN' WHEN nothing THEN 'RETRIEVAL_FAILURE' WHEN doubted THEN 'HALLUCINATION' ELSE failure_type END AS failure FROM e),
y AS (SELECT * EXCLUDE (failure_type), failure AS failure_type FROM x),
w AS (SELECT query_id, CAST(0 AS INT) AS attempt, false AS strong, false AS rechecked, 'NONE' AS last_action, '' AS outcome FROM (SELECT DISTINCT query_id FROM ev)
 UNION ALL SELECT query_id, attempt + 1, strong OR again = 'recheck' OR action = 'STRICT_PROMPT' AND decision = 'retry_model' AND NOT strong, rechecked OR again = 'recheck', CASE WHEN again = 'recheck' THEN last_action ELSE action END, '' FROM
  (SELECT w.*, y.decision, {_HEAL} AS action, CASE WHEN outage THEN 'end' WHEN nothing THEN 'nothing' WHEN reason = 'explicit_not_found' AND NOT rechecked AND NOT w.strong AND score >= 3 AND w.attempt < 2 THEN 'recheck'
    WHEN reason IN ('explicit_not_found', 'no_chunks_retrieved', 'answer_too_short_max_attempts', 'ungrounded_numbers_strong_model_failed') THEN 'end' WHEN passed AND NOT doubted THEN 'end' ELSE 'again' END AS again
   FROM w JOIN y ON y.query_id = w.query_id AND y.attempt = w.attempt AND y.strong = w.strong) s WHERE again <> 'end' AND attempt < 2),
z AS (SELECT w.query_id, w.attempt, w.strong, w.last_action, y.* EXCLUDE (query_id, attempt, strong) FROM w JOIN y ON y.query_id = w.query_id AND y.attempt = w.attempt AND y.strong = w.strong QUALIFY row_number() OVER (PARTITION BY w.query_id ORDER BY w.attempt DESC) = 1),
o AS (SELECT *, CASE WHEN outage THEN 'outage' WHEN nothing THEN 'nothing' WHEN reason IN ('explicit_not_found', 'no_chunks_retrieved', 'answer_too_short_max_attempts', 'ungrounded_numbers_strong_model_failed') THEN 'refused' WHEN passed AND NOT doubted THEN 'accepted' ELSE 'again' END AS fin FROM z)
SELECT query_id, CASE WHEN fin IN ('refused', 'nothing') THEN '{NOT_FOUND}' ELSE answer END AS answer, CASE fin WHEN 'outage' THEN 'provider_unavailable' WHEN 'nothing' THEN 'no_results_after_retry' WHEN 'again' THEN reason || '_max_attempts_reached' ELSE reason END AS reason,
 CASE WHEN fin IN ('nothing', 'outage') THEN 0.0 ELSE round(confidence, 6) END AS confidence, failure_type, CAST(attempt + 1 AS BIGINT) AS attempts, fin = 'again' OR attempt > 0 AS reflected, CASE WHEN fin = 'nothing' THEN 'none' WHEN strong THEN 'strong' ELSE 'fast' END AS model, last_action AS action FROM o"""

_A1, _A2 = "Acme supplies the Atlas system for the storage crew in every office", "The contract of Acme is renewed in May after the storage crew agreed"
#: (plan, step, text) and, by the question a step comes to, what the generator says.
PLANS = (
    (1, 1, "Which vendor supplies Atlas?"), (1, 2, "When does that vendor's contract renew?"), (1, 3, "Is that before the audit?"), (2, 1, "Which disk creates VM-1?"), (2, 2, "What zone must {1} be in?"), (2, 3, "What happens if {2} is wrong?"), (2, 4, "Which vendor supplies Atlas?"),
    (3, 1, "Which vendor supplies Atlas?"), (4, 1, "Which vendor supplies Atlas?"), (4, 2, "Do they answer {7}?"), (4, 3, "Which vendor supplies Atlas?"),
)
SAID = (
    ("Which vendor supplies Atlas?", _A1), (f"When does ({_A1})'s contract renew?", _A2), (f"Is ({_A2}) before the audit?", "Yes, the renewal of the contract comes before the audit of the storage crew"), ("Which disk creates VM-1?", NOT_FOUND), (f"Do they answer the previous result? (referring to: {_A1})", UNAVAILABLE),
)


def decomposed_answers(spark, sf):
    """Plans with a chain of references, with a step that nothing answers, with one step, and with an outage on the way."""
    plans = spark.createDataFrame([(*p, "qa") for p in PLANS], "query_id bigint, step bigint, text string, intent string")
    said = spark.createDataFrame(SAID, "query string, answer string")

    def attempt_of(open_, _k):
        return open_.join(F.broadcast(said), "query", "left").select(*open_.columns, "answer", F.col("answer").alias("context"), F.lit(1.0).alias("score"), F.lit(1).alias("n_chunks"), F.lit("fast").alias("model"))

    return pipeline.answer_steps(plans, attempt_of, Plugins())


_SV = ", ".join(f"({p}, {s}, {_literal(t)})" for p, s, t in PLANS)
_TV = ", ".join(f"({_literal(q)}, {_literal(a)})" for q, a in SAID)
#: References are written out as the plan linker leaves them.
DECOMPOSED_ANSWERS = f"""WITH RECURSIVE said AS (SELECT * FROM (VALUES {_TV}) v(query, answer)),
p AS (SELECT CAST(plan AS BIGINT) AS plan, CAST(step AS BIGINT) AS step, replace(replace(replace(text, 'that vendor', '{{1}}'), 'Is that before', 'Is {{2}} before'), '{{7}}', 'the previous result') AS text FROM (VALUES {_SV}) v(plan, step, text)),
w AS (SELECT plan, CAST(1 AS BIGINT) AS step, text, CAST([] AS VARCHAR[]) AS answers, CAST([] AS BIGINT[]) AS open, '' AS prior FROM p WHERE step = 1
 UNION ALL SELECT s.plan, p.step, p.text, list_append(s.answers, s.answer), CASE WHEN s.bad THEN list_append(s.open, s.step) ELSE s.open END, CASE WHEN len(s.missing) > 0 THEN '' ELSE s.answer END FROM
 (SELECT q.*, CASE WHEN len(missing) > 0 THEN 'Could not answer this step because it depends on step ' || array_to_string(missing, ', ') || ', which was not found in the documents.' ELSE said.answer END AS answer, len(missing) > 0 OR said.answer = '{NOT_FOUND}' AS bad FROM
  (SELECT w.*, list_filter(list_transform(regexp_extract_all(text, '\\{{(\\d)\\}}', 1), lambda x: CAST(x AS BIGINT)), lambda x: list_contains(open, x)) AS missing,
    CASE WHEN regexp_matches(text, '\\{{\\d\\}}') THEN replace(replace(replace(text, '{{1}}', '(' || coalesce(answers[1], '') || ')'), '{{2}}', '(' || coalesce(answers[2], '') || ')'), '{{3}}', '(' || coalesce(answers[3], '') || ')') WHEN prior <> '' AND regexp_matches(lower(text), '\\b(it|its|they|their|them)\\b') THEN text || ' (referring to: ' || prior || ')' ELSE text END AS question FROM w) q LEFT JOIN said ON said.query = q.question) s
 JOIN p ON p.plan = s.plan AND p.step = s.step + 1 WHERE s.answer <> '{UNAVAILABLE}'),
r AS (SELECT plan, step, text, regexp_matches(text, '\\{{\\d\\}}') AS dep, list_filter(list_transform(regexp_extract_all(text, '\\{{(\\d)\\}}', 1), lambda x: CAST(x AS BIGINT)), lambda x: list_contains(open, x)) AS missing,
 CASE WHEN regexp_matches(text, '\\{{\\d\\}}') THEN replace(replace(replace(text, '{{1}}', '(' || coalesce(answers[1], '') || ')'), '{{2}}', '(' || coalesce(answers[2], '') || ')'), '{{3}}', '(' || coalesce(answers[3], '') || ')') WHEN prior <> '' AND regexp_matches(lower(text), '\\b(it|its|they|their|them)\\b') THEN text || ' (referring to: ' || prior || ')' ELSE text END AS question FROM w),
f AS (SELECT r.*, CASE WHEN len(missing) > 0 THEN 'Could not answer this step because it depends on step ' || array_to_string(missing, ', ') || ', which was not found in the documents.' ELSE said.answer END AS answer, CASE WHEN dep THEN regexp_replace(text, '\\{{(\\d)\\}}', 'the answer to step \\1', 'g') ELSE text END AS header,
 CASE WHEN len(missing) > 0 THEN 'none' ELSE 'fast' END AS model, CASE WHEN len(missing) > 0 OR said.answer IN ('{NOT_FOUND}', '{UNAVAILABLE}') THEN 0.0 ELSE 1.0 END AS confidence, CASE WHEN len(missing) > 0 OR said.answer = '{NOT_FOUND}' THEN 'RETRIEVAL_FAILURE' ELSE 'UNKNOWN' END AS failure,
 CASE WHEN len(missing) > 0 THEN 0 ELSE len({WORDS('said.answer')}) * 4 // 3 END AS tokens FROM r LEFT JOIN said ON said.query = r.question),
g AS (SELECT plan, bool_or(answer = '{UNAVAILABLE}') AS out, count(*) AS n FROM f GROUP BY 1), l AS (SELECT plan, string_agg(model, '+' ORDER BY step) AS models FROM (SELECT plan, model, min(step) AS step FROM f GROUP BY ALL) GROUP BY 1)
SELECT f.plan AS query_id, CASE WHEN any_value(out) THEN '{UNAVAILABLE}' WHEN any_value(n) = 1 THEN any_value(answer) ELSE string_agg('**' || header || '**' || chr(10) || answer, chr(10) || chr(10) ORDER BY step) END AS answer, CASE WHEN any_value(out) THEN 'fast' ELSE any_value(models) END AS model_used,
 CAST(1 AS BIGINT) AS attempts, false AS reflected, round(CASE WHEN any_value(out) THEN 0.0 ELSE CAST(min(confidence) AS DOUBLE) END, 3) AS confidence, CASE WHEN any_value(out) THEN 'UNKNOWN' ELSE coalesce(min(failure) FILTER (failure <> 'UNKNOWN'), 'UNKNOWN') END AS failure_type, 'NONE' AS healing_action,
 CAST(CASE WHEN any_value(out) THEN max(tokens) FILTER (answer = '{UNAVAILABLE}') ELSE sum(tokens) END AS BIGINT) AS tokens_used, CASE WHEN any_value(out) THEN 'provider_unavailable' WHEN any_value(n) = 1 THEN 'passed_all_checks' ELSE 'decomposed_' || any_value(n) || '_subquestions' END AS reason FROM f JOIN g ON g.plan = f.plan JOIN l ON l.plan = f.plan GROUP BY f.plan"""


def suggestion_cards(spark, sf):
    """Cards whose prompts are golden queries and one that no text answers."""
    g = gold(spark, sf).filter("query_id <= 20")
    made = g.groupBy(((F.col("query_id") - 1) / 4).cast("int").alias("topic")).agg(F.transform(F.sort_array(F.collect_list(F.struct("query_id", "query"))), lambda x: x["query"]).alias("prompts"))  # 20 fixed rows
    odd = F.when(F.col("topic") == 1, F.concat(F.array(F.lit("zzqx wvvq")), "prompts")).otherwise(F.col("prompts"))
    cards = made.select("topic", F.concat(F.lit("A label far longer than thirty characters "), F.col("topic").cast("string")).alias("label"), F.when(F.col("topic") == 2, F.lit("📊📊📊📊📊📊")).alias("icon"), F.when(F.col("topic") == 3, F.lit("#3f7350")).otherwise("red").alias("color"), odd.alias("prompts"))
    out = pipeline.suggestions(cards, pool(spark, sf))
    return out.select(F.col("topic").cast("bigint").alias("topic"), "label", "icon", "color", F.array_join("prompts", " | ").alias("prompts"))


SUGGESTION_CARDS = f"""{BASE}, hit AS (SELECT DISTINCT query_id FROM scored), g AS (SELECT query_id, query, (query_id - 1) // 4 AS topic, (query_id - 1) % 4 AS place FROM gold WHERE query_id <= 16),
k AS (SELECT * FROM g JOIN hit USING (query_id) WHERE NOT (topic = 1 AND place = 3))
SELECT CAST(topic AS BIGINT) AS topic, 'A label far longer than thirty' AS label, CASE WHEN topic = 2 THEN '📊📊📊📊' ELSE '📄' END AS icon, CASE topic WHEN 3 THEN '#3f7350' ELSE [{', '.join(repr(c) for c in pipeline.PALETTE)}][topic + 1] END AS color, string_agg(query, ' | ' ORDER BY place) AS prompts FROM k GROUP BY topic"""


def answer_questions(spark, sf):
    """The golden questions with their vectors through the whole loop, with the generator that needs no model."""
    mine = query_vectors(spark, sf)
    embed = lambda texts: mine.join(texts.select("query_id"), "query_id", "left_semi")
    chunks = table(spark, sf, "chunks")
    return pipeline.answer(gold(spark, sf).select("query_id", "query"), pool(spark, sf), vectors(chunks), Plugins(embed=embed, generate=first_sentence), parent_texts(chunks))


def parent_context(spark, sf):
    """The five best chunks of each question with the text of their parent where one is known."""
    from ..operators import context as C
    from ..operators import retrieval as R

    rows = R.top_k(R.bm25(gold(spark, sf), pool(spark, sf)), 5).join(pool(spark, sf), "chunk_id")
    return C.expand_parents(rows, parent_texts(table(spark, sf, "chunks"))).select("query_id", "chunk_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))


PARENT_CONTEXT = f"""{BASE}, par AS (SELECT metadata.parent_id AS parent_id, min(metadata.parent_text) AS parent_text FROM chunks WHERE metadata.parent_id IS NOT NULL AND metadata.parent_text <> '' GROUP BY 1)
SELECT query_id, chunk_id, sha256(coalesce(parent_text, text, '')) AS text_hash FROM ({_rank('scored', 5)}) JOIN pool USING (chunk_id) LEFT JOIN par USING (parent_id)"""


def queries():
    fs = (loop_outcomes, decomposed_answers, suggestion_cards, answer_questions, parent_context)
    return {f.__name__: f for f in fs}


def oracle_sql():
    g = globals()
    return {n: g[n.upper()] for n in queries() if n.upper() in g}
