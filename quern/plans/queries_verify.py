"""Registered session, verification, evaluation and planning queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import understand as U
from ..functions import verify as V
from ..operators import context as C
from ..operators import sessions as S
from ..operators import steps as P
from ..operators.index import current_chunks
from ..sources.io import table
from .queries_text import POOL, STRIP, WORDS

TURNS = """t AS (SELECT session_id, updated_at, i - 1 AS turn, e[i].query AS query, e[i].answer AS answer, e[i].intent AS intent, e[i].sources AS sources, e[i].timestamp AS timestamp FROM (
 SELECT *, unnest(range(1, len(e) + 1)) AS i FROM (SELECT session_id, updated_at, from_json(entries, '[{"query":"VARCHAR","answer":"VARCHAR","intent":"VARCHAR","sources":[{"filename":"VARCHAR","page":"BIGINT","score":"DOUBLE"}],"timestamp":"VARCHAR"}]') AS e FROM chat_sessions WHERE json_valid(entries))))"""


def turns(spark, sf):
    return S.turns(table(spark, sf, "chat_sessions"))


def session_turns(spark, sf):
    return turns(spark, sf).select("session_id", "turn", "query", "answer", "intent", F.coalesce(F.size("sources"), F.lit(0)).cast("bigint").alias("n_sources"))


SESSION_TURNS = f"WITH {TURNS} SELECT session_id, turn, query, answer, intent, coalesce(len(sources), 0) AS n_sources FROM t"


def last_turns(spark, sf):
    return S.last_turns(turns(spark, sf), 3).select("session_id", "turn", "query")


LAST_TURNS = f"WITH {TURNS} SELECT session_id, turn, query FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 3"


def list_sessions(spark, sf):
    return S.summaries(turns(spark, sf)).select("session_id", "title", "turns").orderBy("session_id")


LIST_SESSIONS = f"WITH {TURNS}, k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 10) SELECT session_id, min_by(query, turn) AS title, count(*) AS turns FROM k GROUP BY session_id"


def followup_rewrite(spark, sf):
    t = S.with_previous(turns(spark, sf))
    return t.select("session_id", "turn", U.followup_query(F.col("query"), F.col("last_query"), F.col("last_answer")).alias("rewritten"))


_FOLLOW = f"(regexp_matches(lower(query), '^\\W*(?:{'|'.join(U.FOLLOWUP_OPENERS)})\\b') OR regexp_matches(lower(query), '\\b(?:{'|'.join(U.FOLLOWUP_SIGNALS)})\\b'))"
FOLLOWUP_REWRITE = f"""WITH {TURNS}, p AS (SELECT *, lag(query) OVER w AS lq, lag(answer) OVER w AS la FROM t WINDOW w AS (PARTITION BY session_id ORDER BY turn))
SELECT session_id, turn, CASE WHEN {_FOLLOW} AND lq IS NOT NULL AND la IS NOT NULL THEN query || ' (context: previous question was "' || lq || '" - your previous answer was "' || substring(la, 1, 300) || '")' ELSE query END AS rewritten FROM p"""


def export_markdown(spark, sf):
    return S.markdown(turns(spark, sf))


EXPORT_MARKDOWN = f"""WITH {TURNS}, k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 10),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS n, list_transform(coalesce(sources, []), lambda s: '- ' || s.filename || CASE WHEN coalesce(s.page, 0) <> 0 THEN ', page ' || s.page ELSE '' END) AS names FROM k),
u AS (SELECT *, list_filter(list_transform(range(1, len(names) + 1), lambda i: CASE WHEN list_position(names, names[i]) = i THEN names[i] END), lambda x: x IS NOT NULL) AS once FROM n)
SELECT session_id, string_agg('## ' || n || '. ' || coalesce(query, '') || chr(10) || chr(10) || coalesce(answer, '') || CASE WHEN len(once) > 0 THEN chr(10) || chr(10) || '**Sources:**' || chr(10) || array_to_string(once, chr(10)) ELSE '' END || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY n) AS markdown FROM u GROUP BY session_id"""


def chat_messages(spark, sf):
    return S.messages(turns(spark, sf))


CHAT_MESSAGES = f"WITH {TURNS} SELECT session_id, 2 * turn AS seq, 'user' AS role, query AS content FROM t UNION ALL SELECT session_id, 2 * turn + 1, 'bot', answer FROM t"


def stream_frames(spark, sf):
    return S.frames(turns(spark, sf))


STREAM_FRAMES = f"WITH {TURNS} SELECT session_id, turn, seq, substring(answer, CAST(seq * 4 + 1 AS BIGINT), 4) AS frame FROM (SELECT *, unnest(range(CAST(ceil(length(answer) / 4) AS BIGINT))) AS seq FROM t WHERE length(answer) > 0)"


def token_metering(spark, sf):
    """Estimated tokens of all answers, by intent and in all."""
    n = F.floor(F.size(T.words(F.coalesce("answer", F.lit("")))) * 4 / 3).cast("bigint")
    return turns(spark, sf).select(F.coalesce("intent", F.lit("none")).alias("intent"), n.alias("n")).rollup("intent").agg(F.sum("n").alias("tokens"), F.count("*").alias("turns"))


TOKEN_METERING = f"WITH {TURNS} SELECT intent, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS turns FROM (SELECT coalesce(intent, 'none') AS intent, len({WORDS("coalesce(answer, '')")}) * 4 // 3 AS n FROM t) GROUP BY ROLLUP (intent)"


def intent_counts(spark, sf):
    """Turns by known intent, unknown and missing ones apart."""
    known = F.col("intent").isin("qa", "explain", "summarize", "compare")
    return turns(spark, sf).groupBy(F.when(known, F.col("intent")).otherwise(F.lit("other")).alias("intent")).agg(F.count("*").alias("n"))


INTENT_COUNTS = f"WITH {TURNS} SELECT CASE WHEN intent IN ('qa', 'explain', 'summarize', 'compare') THEN intent ELSE 'other' END AS intent, count(*) AS n FROM t GROUP BY 1"


# ---- answers against the text of the pages they cite
def evidence(spark, sf):
    """(session_id, turn, query, answer, source): source is the text of the cited pages, null without any."""
    t = turns(spark, sf)
    cited = t.select("session_id", "turn", F.explode("sources").alias("s")).select("session_id", "turn", F.col("s.filename").alias("filename"), F.col("s.page").alias("page")).distinct()
    pages = current_chunks(table(spark, sf, "chunks")).filter("text IS NOT NULL").select("filename", "page", "chunk_id", "text")
    # A page has few chunks and an answer few sources, so these lists are short.
    text = cited.join(pages, ["filename", "page"]).groupBy("session_id", "turn").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("chunk_id", "text"))), lambda x: x["text"]), " ").alias("source"))
    return t.select("session_id", "turn", "query", "answer").join(text, ["session_id", "turn"], "left")


EVIDENCE = f"""{TURNS}, {POOL}, cited AS (SELECT DISTINCT session_id, turn, s.filename AS filename, s.page AS page FROM (SELECT session_id, turn, unnest(sources) AS s FROM t)),
src AS (SELECT session_id, turn, string_agg(text, ' ' ORDER BY chunk_id) AS source FROM (SELECT DISTINCT session_id, turn, chunk_id, text FROM cited JOIN pool USING (filename, page) WHERE text IS NOT NULL) GROUP BY ALL),
ev AS (SELECT t.session_id, t.turn, query, answer, source FROM t LEFT JOIN src USING (session_id, turn))"""
_STOP = "[" + ", ".join(f"'{w}'" for w in V.STOPWORDS) + "]"
CW = lambda x: f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z]+')), lambda w: NOT list_contains({_STOP}, w))"
CLAIMS = lambda x: f"regexp_replace({x}, '(?i)[\\[【]\\s*Source:[^\\]】]*[\\]】]', ' ', 'g')"
OVER = lambda a, s: f"(len(list_intersect({CW(a)}, {CW(s)})) / greatest(len({CW(a)}), 1))"
STRUCT = lambda x: f"regexp_replace(regexp_replace({x}, '{V.LABEL}', ' ', 'g'), '(?m)^\\s*(?:[-*•]\\s+)?\\d{{1,2}}[.)](\\s)', ' \\1', 'g')"
NORM = lambda x: f"replace(regexp_replace({x}, '(\\d)\\s+%', '\\1%', 'g'), ',', '')"
NUMS = lambda x: f"regexp_extract_all({x}, '{V.NUMBER}')"
VAL = lambda x: f"(CASE WHEN regexp_matches(regexp_replace({x}, '%+$', ''), '^\\d+(\\.\\d+)?$') THEN CAST(regexp_replace({x}, '%+$', '') AS DOUBLE) END)"
SUMS = lambda v: f"list_reduce(list_prepend([CAST(0 AS DOUBLE)], list_transform(({v})[1:12], lambda v: [v])), lambda s, v: list_distinct(s || list_transform(s, lambda x: x + v[1])))"


def overlap_confidence(spark, sf):
    ratio = V.overlap(T.drop_citations(F.col("answer")), F.coalesce("source", F.lit("")))
    return evidence(spark, sf).select("session_id", "turn", F.round(ratio, 6).alias("overlap"), *[F.round(V.confidence(ratio, F.lit(k)), 6).alias(f"confidence_{k}") for k in range(3)])


OVERLAP_CONFIDENCE = f"""WITH {EVIDENCE}, o AS (SELECT session_id, turn, {OVER(CLAIMS('answer'), "coalesce(source, '')")} AS r FROM ev)
SELECT session_id, turn, round(r, 6) AS overlap, {", ".join(f"round(greatest(0.1, least(1.0, r * 3.0) - 0.2 * {k}), 6) AS confidence_{k}" for k in range(3))} FROM o"""


def number_grounding(spark, sf):
    a, s = V.normalise_numbers(F.col("answer")), V.normalise_numbers(F.lower(F.coalesce("source", F.lit(""))))
    open_ = V.ungrounded(a, s)
    return evidence(spark, sf).select("session_id", "turn", F.array_join(open_, ",").alias("ungrounded"), F.size(V.numbers(a)).cast("bigint").alias("n_numbers"))


NUMBER_GROUNDING = f"""WITH {EVIDENCE}, n AS (SELECT *, {NUMS(NORM('answer'))} AS ns, {NORM("lower(coalesce(source, ''))")} AS s FROM ev)
SELECT session_id, turn, array_to_string(list_filter(ns, lambda n: NOT contains(s, n)), ',') AS ungrounded, len(ns) AS n_numbers FROM n"""

SUM_ROWS = ((1, "80000,85000,90000,95000", 350000.0), (2, "80000,85000,90000,95000", 350001.0), (3, "1.5,2.5", 4.0), (4, "", 0.0), (5, "1,2,3,4,5,6,7,8,9,10,11,12,1000", 1000.0), (6, "7", 7.0))
_SUM_VALUES = ", ".join(f"({i}, '{v}', {t})" for i, v, t in SUM_ROWS)


def subset_sum_grounding(spark, sf):
    df = spark.createDataFrame(SUM_ROWS, "id bigint, listed string, target double")
    vals = F.transform(F.filter(F.split("listed", ","), lambda x: x != ""), lambda x: x.cast("double"))
    sums = V.subset_sums(vals)
    return df.select("id", F.exists(sums, lambda t: F.abs(F.col("target") - t) <= 1e-6).alias("reachable"), F.size(F.array_distinct(sums)).cast("bigint").alias("n_sums"))


SUBSET_SUM_GROUNDING = f"""WITH v AS (SELECT CAST(id AS BIGINT) AS id, target, list_transform(list_filter(string_split(listed, ','), lambda x: x <> ''), lambda x: CAST(x AS DOUBLE)) AS vals FROM (VALUES {_SUM_VALUES}) v(id, listed, target)),
s AS (SELECT id, target, {SUMS('vals')} AS sums FROM v) SELECT id, len(list_filter(sums, lambda t: abs(target - t) <= 1e-6)) > 0 AS reachable, len(sums) AS n_sums FROM s"""


def reflect_decision(spark, sf):
    """Every answer judged on each of three attempts, by the weaker and the stronger model."""
    tries = F.explode(F.array(*[F.struct(F.lit(a).alias("attempt"), F.lit(s).alias("strong")) for a in range(3) for s in (False, True)]))
    seen = evidence(spark, sf).select("session_id", "turn", V.features(F.col("query"), F.col("answer"), F.col("source")).alias("f"))
    e = seen.withColumn("x", tries).select("session_id", "turn", "f", "x.*")
    d = e.withColumn("d", V.decide(F.col("f"), F.col("attempt"), F.col("strong")))
    failure = V.failure_type(F.col("d.reason"), F.col("attempt"))
    force = (F.col("d.decision") == "retry_model") & ~F.col("strong")
    return d.select("session_id", "turn", F.col("attempt").cast("bigint").alias("attempt"), "strong", "d.decision", "d.reason", "d.confidence", failure.alias("failure_type"), V.healing_action(failure).alias("action"), force.alias("force_strong"))


_FAIL = """CASE WHEN reason IN ('no_results_found', 'explicit_not_found', 'no_chunks_retrieved', 'answer_too_short', 'answer_too_short_max_attempts') THEN 'RETRIEVAL_FAILURE'
 WHEN reason = 'low_overlap' THEN CASE WHEN attempt = 0 THEN 'RETRIEVAL_FAILURE' ELSE 'INSUFFICIENT_CONTEXT' END WHEN reason = 'low_overlap_retry_model' THEN 'INSUFFICIENT_CONTEXT'
 WHEN reason IN ('ungrounded_numbers', 'ungrounded_numbers_strong_model_failed', 'possible_contradiction') THEN 'HALLUCINATION' WHEN reason = 'answer_too_long' THEN 'FORMAT_ERROR' ELSE 'UNKNOWN' END"""
_HEAL = "CASE failure_type WHEN 'RETRIEVAL_FAILURE' THEN 'REWRITE_QUERY' WHEN 'INSUFFICIENT_CONTEXT' THEN 'INCREASE_TOP_K' WHEN 'HALLUCINATION' THEN 'STRICT_PROMPT' WHEN 'FORMAT_ERROR' THEN 'STRICT_PROMPT' WHEN 'OUTDATED_DATA' THEN 'REINGEST' ELSE 'NONE' END"
REFLECT_DECISION = f"""WITH {EVIDENCE}, b AS (SELECT *, {STRIP("coalesce(answer, '')")} AS a, lower(coalesce(source, '')) AS low FROM ev),
m AS (SELECT *, len({WORDS('a')}) AS n, len(list_intersect(list_filter({CW('a')}, lambda w: NOT list_contains({CW('query')}, w)), {CW('low')})) > 0 AS fresh, {OVER(CLAIMS('a'), 'low')} AS ratio,
  {NUMS(NORM(STRUCT(CLAIMS('a'))))} AS an, {NORM('low')} AS ns FROM b),
g AS (SELECT *, list_filter(an, lambda x: NOT contains(ns, x)) AS op, list_filter(list_transform({NUMS('ns')}, lambda x: {VAL('x')}), lambda v: v IS NOT NULL) AS vals FROM m),
h AS (SELECT *, CASE WHEN len(op) = 0 THEN true WHEN len(vals) = 0 THEN false ELSE len(list_filter(op, lambda x: NOT coalesce(len(list_filter({SUMS('vals')}, lambda q: abs({VAL('x')} - q) <= greatest(1e-6, 1e-9 * greatest(abs({VAL('x')}), abs(q))))) > 0, false))) = 0 END AS grounded FROM g),
k AS (SELECT h.*, attempt, strong FROM h, (VALUES (0), (1), (2)) a(attempt), (VALUES (false), (true)) s(strong)),
r AS (SELECT *, CASE WHEN contains(lower(a), 'not found in the document') THEN 'explicit_not_found' WHEN n < 8 AND NOT fresh AND attempt < 2 THEN 'answer_too_short' WHEN n < 8 AND NOT fresh THEN 'answer_too_short_max_attempts' WHEN source IS NULL THEN 'no_chunks_retrieved'
  WHEN ratio < 0.15 AND attempt < 2 THEN 'low_overlap' WHEN ratio < 0.15 THEN 'low_overlap_retry_model' WHEN NOT grounded AND NOT strong THEN 'ungrounded_numbers' WHEN NOT grounded THEN 'ungrounded_numbers_strong_model_failed'
  WHEN n > 500 AND NOT strong THEN 'answer_too_long' ELSE 'passed_all_checks' END AS reason FROM k),
d AS (SELECT *, CASE WHEN reason IN ('answer_too_short', 'low_overlap') THEN 'retry_search' WHEN reason IN ('low_overlap_retry_model', 'ungrounded_numbers', 'answer_too_long') THEN 'retry_model' WHEN reason = 'passed_all_checks' THEN 'accept' ELSE 'refuse' END AS decision,
  CASE WHEN reason = 'passed_all_checks' THEN round(greatest(0.1, least(1.0, ratio * 3.0) - 0.2 * attempt), 6) ELSE CAST(0 AS DOUBLE) END AS confidence, {_FAIL} AS failure_type FROM r)
SELECT session_id, turn, CAST(attempt AS BIGINT) AS attempt, strong, decision, reason, confidence, failure_type, {_HEAL} AS action, decision = 'retry_model' AND NOT strong AS force_strong FROM d"""


def validator(spark, sf):
    v = V.validate(F.col("answer"), F.coalesce("source", F.lit("")))
    return evidence(spark, sf).select("session_id", "turn", v["flagged"].alias("flagged"), v["reason"].alias("reason"))


_VNUM = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '\\b(?:\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d+(?:\\.\\d+)?(?:%|ms|s|gb|mb|kb)?)\\b'))"
VALIDATOR = f"""WITH {EVIDENCE}, c AS (SELECT *, {CLAIMS('answer')} AS c, coalesce(source, '') AS s FROM ev),
r AS (SELECT *, list_filter([CASE WHEN len({WORDS('c')}) > 500 THEN 'answer_too_long' END, CASE WHEN len(list_intersect({CW('c')}, {CW('s')})) < least(8, greatest(1, len({CW('c')}) // 2)) THEN 'low_overlap' END,
 CASE WHEN len(list_filter({_VNUM(STRUCT('c'))}, lambda x: NOT list_contains({_VNUM('s')}, x))) > 0 THEN 'ungrounded_numbers' END], lambda x: x IS NOT NULL) AS rs FROM c)
SELECT session_id, turn, CASE WHEN contains(lower(answer), 'not found') THEN false ELSE len(rs) > 0 END AS flagged, CASE WHEN contains(lower(answer), 'not found') THEN 'not_found_response' WHEN len(rs) = 0 THEN 'ok' ELSE array_to_string(rs, '|') END AS reason FROM r"""


def contradiction(spark, sf):
    e = evidence(spark, sf).filter("source IS NOT NULL")
    return e.select("session_id", "turn", V.contradicts(F.col("query"), F.col("answer"), F.col("source")).alias("contradicts"))


_STEM = "CASE " + " ".join(f"WHEN ends_with(k, '{x}') AND length(k) >= {len(x) + 3} THEN left(k, length(k) - {len(x)})" for x in V.SUFFIXES) + " ELSE k END"
_SAID = lambda c: f"list_filter(list_distinct(flatten(list({c}))), lambda w: w IS NOT NULL)"
CONTRADICTION = f"""WITH {EVIDENCE}, x AS (SELECT session_id, turn, 'a' AS side, answer AS text FROM ev WHERE source IS NOT NULL UNION ALL SELECT session_id, turn, 'q', query FROM ev WHERE source IS NOT NULL UNION ALL SELECT session_id, turn, 's', source FROM ev WHERE source IS NOT NULL),
c AS (SELECT session_id, turn, side, regexp_extract_all(unnest(string_split_regex(lower(text), $${V.CLAUSE_BREAK}$$)), $${V.CLAUSE_WORD}$$) AS ws FROM x),
d AS (SELECT session_id, turn, side, ws, list_transform(ws, lambda w, i: CASE WHEN len(list_filter(ws[greatest(i - 3, 1):i - 1], lambda b: regexp_matches(b, '{V.NEGATION.replace(chr(39), chr(39)*2)}'))) > 0 OR regexp_matches(array_to_string(ws[i + 1:i + 5], ' '), $${V.TRAILING_NEGATION}$$) THEN w END) AS no FROM c),
g AS (SELECT session_id, turn, side, {_SAID('ws')} AS held, {_SAID('no')} AS denied FROM d GROUP BY ALL),
k AS (SELECT session_id, turn, unnest({CW('query')}) AS k FROM ev WHERE source IS NOT NULL AND query IS NOT NULL),
f AS (SELECT session_id, turn, list_transform([{', '.join(repr(e) for e in V.INFLECTIONS)}], lambda e: {_STEM} || e) AS forms FROM k),
y AS (SELECT DISTINCT f.session_id, f.turn FROM f JOIN g a ON a.side = 'a' AND a.session_id = f.session_id AND a.turn = f.turn JOIN g q ON q.side = 'q' AND q.session_id = f.session_id AND q.turn = f.turn JOIN g s ON s.side = 's' AND s.session_id = f.session_id AND s.turn = f.turn
 WHERE list_has_any(a.denied, forms) AND NOT list_has_any(q.denied, forms) AND list_has_any(s.held, forms) AND NOT list_has_any(s.denied, forms))
SELECT session_id, turn, (session_id, turn) IN (SELECT (session_id, turn) FROM y) AS contradicts FROM ev WHERE source IS NOT NULL"""


def evidence_verdict(spark, sf):
    """What to show beside each answer: an answer without sources counts as two attempts, one with several as a merged one."""
    n = F.coalesce(F.size("sources"), F.lit(0))
    attempts = F.when(n == 0, 2).otherwise(1)
    reason = F.when(n > 2, F.concat(F.lit("decomposed_"), n.cast("string"), F.lit("_subquestions"))).when(F.col("intent").isNull(), F.lit("low_overlap_max_attempts_reached")).otherwise(F.lit("passed_all_checks"))
    kind = (
        F.when(F.col("answer").startswith("Service temporarily unavailable"), F.lit("error")).when(F.contains(F.lower("answer"), F.lit("not found in the document")), F.lit("notfound"))
        .when(reason.endswith("_max_attempts_reached"), F.lit("unverified")).when(reason.startswith("decomposed_"), F.lit("grounded")).when(attempts > 1, F.lit("healed")).otherwise(F.lit("grounded"))
    )
    return turns(spark, sf).select("session_id", "turn", kind.alias("kind"), F.coalesce(F.size(F.array_distinct(F.transform("sources", lambda s: s["filename"]))), F.lit(0)).cast("bigint").alias("files"))


EVIDENCE_VERDICT = f"""WITH {TURNS} SELECT session_id, turn, CASE WHEN starts_with(answer, 'Service temporarily unavailable') THEN 'error' WHEN contains(lower(answer), 'not found in the document') THEN 'notfound' WHEN coalesce(len(sources), 0) <= 2 AND intent IS NULL THEN 'unverified'
 WHEN coalesce(len(sources), 0) > 2 THEN 'grounded' WHEN coalesce(len(sources), 0) = 0 THEN 'healed' ELSE 'grounded' END AS kind, coalesce(len(list_distinct(list_transform(sources, lambda s: s.filename))), 0) AS files FROM t"""

CITED = ((1, "Yes [Source: a‑b.pdf, page 1].", "a-b.pdf"), (1, "Yes [Source: a‑b.pdf, page 1].", "c.pdf"), (2, "No citation.", "d.pdf"), (2, "No citation.", "e.pdf"), (3, "See 【Source: Plan X.docx | Page 2】", "plan x.docx"), (3, "See 【Source: Plan X.docx | Page 2】", "other.docx"), (4, "[source: zzz]", "f.pdf"))


def cited_sources(spark, sf):
    return C.cited_sources(spark.createDataFrame(CITED, "answer_id bigint, answer string, filename string")).select("answer_id", "filename")


_CV = ", ".join(f"({i}, '{a}', '{f}')" for i, a, f in CITED)
_PLAIN = lambda x: f"lower(regexp_replace(regexp_replace({x}, '[‐-―−]', '-', 'g'), '[\\s  ]+', ' ', 'g'))"
CITED_SOURCES = f"""WITH v AS (SELECT CAST(i AS BIGINT) AS answer_id, a AS answer, f AS filename FROM (VALUES {_CV}) v(i, a, f)),
m AS (SELECT *, len(list_filter(regexp_extract_all({_PLAIN('answer')}, '[\\[【]\\s*source:([^\\]】]*)[\\]】]', 1), lambda t: contains(t, {_PLAIN('filename')}))) > 0 AS cited FROM v)
SELECT answer_id, filename FROM m QUALIFY cited OR NOT bool_or(cited) OVER (PARTITION BY answer_id)"""

# ---- grading and evaluation
CASES = (
    ("c1", "answer", "It renews on 3 May 2026.", [["3 may 2026", "2026-05-03"]], ["2025"], False), ("c2", "answer", "**Not found** in the document.", [["x"]], [], False), ("c3", "not_found", "Not found in the document.", [], [], False),
    ("c4", "not_found", "It is 5.", [], [], False), ("c5", "partial", "Step 1 ok. Could not answer this step. Not found in the document.", [["ok"]], [], False), ("c6", "answer", "The zone‑2 disk", [["zone-2"], ["re:disk$"]], [], True),
    ("c7", "answer", "The cost is 12", [["re:1[0-9]"]], ["re:cost"], False), ("c8", "partial", "all done", [["done"]], [], False),
)


def grade_cases(spark, sf):
    df = spark.createDataFrame(CASES, "id string, expect string, answer string, must array<array<string>>, must_not array<string>, flagged boolean")
    norm = lambda c: F.lower(T.strip(F.regexp_replace(F.regexp_replace(T.ascii_lookalikes(c), r"[*_`]+", ""), r"[ \t\r\n\f]+", " ")))
    text = norm(F.col("answer"))
    match = lambda a: F.when(a.startswith("re:"), F.regexp_like(text, F.substring(a, F.lit(4), F.lit(1000)))).otherwise(F.contains(text, norm(a)))
    nf = F.contains(text, F.lit("not found in the document"))
    kind_ok = F.when(F.col("expect") == "not_found", nf).when(F.col("expect") == "partial", nf & F.contains(text, F.lit("could not answer this step"))).otherwise(~nf)
    groups_ok = (F.col("expect") == "not_found") | F.forall("must", lambda g: F.exists(g, match))
    clean = ~F.exists("must_not", match)
    return df.select("id", kind_ok.alias("kind_ok"), groups_ok.alias("groups_ok"), clean.alias("clean"), (kind_ok & groups_ok & clean & ~F.col("flagged")).alias("passed"))


_CASEV = ", ".join(
    "('" + i + "', '" + e + "', '" + a.replace("'", "''") + "', " + ("CAST([" + ", ".join("[" + ", ".join(f"'{x}'" for x in g) + "]" for g in m) + "] AS VARCHAR[][])") + ", " + ("CAST([" + ", ".join(f"'{x}'" for x in n) + "] AS VARCHAR[])") + f", {str(f).lower()})"
    for i, e, a, m, n, f in CASES
)
_GN = lambda x: f"lower({STRIP(f'regexp_replace(regexp_replace(translate({x}, $${T.LOOKALIKE_FROM}$$, $${T.LOOKALIKE_TO}$$), $$[*_`]+$$, $$$$, $$g$$), $$[ {chr(92)}t{chr(92)}r{chr(92)}n{chr(92)}f]+$$, $$ $$, $$g$$)')})"
_GM = lambda a: f"(CASE WHEN starts_with({a}, 're:') THEN regexp_matches(x, substring({a}, 4)) ELSE contains(x, {_GN(a)}) END)"
GRADE_CASES = f"""WITH v AS (SELECT *, {_GN('answer')} AS x FROM (VALUES {_CASEV}) v(id, expect, answer, must, must_not, flagged)),
g AS (SELECT *, contains(x, 'not found in the document') AS nf, expect = 'not_found' OR len(list_filter(must, lambda g: len(list_filter(g, lambda a: {_GM('a')})) = 0)) = 0 AS groups_ok, len(list_filter(must_not, lambda a: {_GM('a')})) = 0 AS clean FROM v),
k AS (SELECT *, CASE expect WHEN 'not_found' THEN nf WHEN 'partial' THEN nf AND contains(x, 'could not answer this step') ELSE NOT nf END AS kind_ok FROM g)
SELECT id, kind_ok, groups_ok, clean, kind_ok AND groups_ok AND clean AND NOT flagged AS passed FROM k"""


def runs(spark, sf):
    """Feedback rows as evaluation records, each id once."""
    return table(spark, sf, "feedback_logs").groupBy("id").agg(F.min("query").alias("query"), F.min("failure_type").alias("failure_type"), F.min("fix_applied").alias("fix_applied"), F.bool_or("success").alias("success"), F.min("created_at").alias("created_at"))


RUNS = "runs AS (SELECT id, min(query) AS query, min(failure_type) AS failure_type, min(fix_applied) AS fix_applied, bool_or(success) AS success, min(created_at) AS created_at FROM feedback_logs GROUP BY id)"


def eval_summary(spark, sf):
    r = runs(spark, sf).withColumn("category", F.coalesce("failure_type", F.lit("none")))
    return r.groupBy("category").agg(F.count("*").alias("cases"), F.count_if("success").alias("passed"), F.round(F.avg(F.col("success").cast("double")), 3).alias("pass_rate"), F.max_by("id", F.struct(F.char_length("query"), F.col("id"))).alias("heaviest"))


EVAL_SUMMARY = f"WITH {RUNS} SELECT coalesce(failure_type, 'none') AS category, count(*) AS cases, count(*) FILTER (success) AS passed, round(avg(CAST(success AS DOUBLE)), 3) AS pass_rate, max_by(id, (length(query), id)) AS heaviest FROM runs GROUP BY 1"


def baseline_diff(spark, sf):
    """The first run of each question against its last: what broke, what was fixed."""
    at = F.struct("created_at", "id")
    d = runs(spark, sf).groupBy("query").agg(F.min_by("success", at).alias("first"), F.max_by("success", at).alias("last"), F.count("*").alias("n"))
    return d.filter("n > 1").select("query", F.when(F.col("first") & ~F.col("last"), "regression").when(~F.col("first") & F.col("last"), "fixed").otherwise("same").alias("change"))


BASELINE_DIFF = f"WITH {RUNS}, d AS (SELECT query, arg_min(success, (created_at, id)) AS f, arg_max(success, (created_at, id)) AS l, count(*) AS n FROM runs GROUP BY query) SELECT query, CASE WHEN f AND NOT l THEN 'regression' WHEN NOT f AND l THEN 'fixed' ELSE 'same' END AS change FROM d WHERE n > 1"

# ---- plans of several steps
STEPS = (
    (1, 1, "Which vendor supplies Atlas?", True), (1, 2, "When does {1} renew?", False), (1, 3, "Is {2} before the audit?", True), (1, 4, "Who signs for {1}?", True), (2, 1, "Which disk creates VM-1?", False), (2, 2, "What zone must {1} be in?", True), (2, 3, "What happens if {2} is wrong?", True),
    (3, 1, "Which vendor supplies Atlas?", True), (3, 2, "When does that vendor's contract renew?", True), (3, 3, "Is that before the audit?", True), (3, 4, "Who are the people that sign those contracts?", True), (4, 1, "Is it {3}?", True), (4, 2, "Use {2} and {1}", True),
)
_STEPV = ", ".join("({}, {}, '{}', {})".format(p, s, t.replace("'", "''"), str(a).lower()) for p, s, t, a in STEPS)
STEPS_SQL = f"steps AS (SELECT CAST(plan_id AS BIGINT) AS plan_id, CAST(step AS BIGINT) AS step, text, answered FROM (VALUES {_STEPV}) v(plan_id, step, text, answered))"


def steps(spark):
    return spark.createDataFrame(STEPS, "plan_id bigint, step bigint, text string, answered boolean")


def plan_dependencies(spark, sf):
    return P.blocked_steps(steps(spark))


PLAN_DEPENDENCIES = f"""WITH RECURSIVE {STEPS_SQL}, edges AS (SELECT plan_id, step, CAST(unnest(regexp_extract_all(text, '\\{{(\\d+)\\}}', 1)) AS BIGINT) AS dep FROM steps),
bad AS (SELECT plan_id, step FROM steps WHERE NOT answered UNION SELECT e.plan_id, e.step FROM edges e JOIN bad b ON b.plan_id = e.plan_id AND b.step = e.dep)
SELECT s.plan_id, s.step, EXISTS (SELECT 1 FROM edges e JOIN bad b ON b.plan_id = e.plan_id AND b.step = e.dep WHERE e.plan_id = s.plan_id AND e.step = s.step) AS blocked FROM steps s"""


def plan_back_references(spark, sf):
    return P.back_references(steps(spark)).drop("by_noun")


_KEY = lambda w: f"(CASE WHEN {w} LIKE '%''s' AND length({w}) >= 5 THEN {w}[:-3] WHEN {w} LIKE '%es' AND length({w}) >= 5 THEN {w}[:-3] WHEN {w} LIKE '%s' AND length({w}) >= 4 THEN {w}[:-2] ELSE {w} END)"
PLAN_BACK_REFERENCES = f"""WITH {STEPS_SQL}, f AS (SELECT *, regexp_extract(lower(text), '\\b(?:that|this|those|these|the same)\\s+([a-z][a-z0-9-]*)', 1) AS n FROM steps WHERE step > 1 AND NOT regexp_matches(text, '\\{{\\d+\\}}')),
e AS (SELECT plan_id, step AS e, list_transform(regexp_extract_all(lower(text), '[a-z][a-z0-9-]*'), lambda w: {_KEY('w')}) AS ws FROM steps),
l AS (SELECT f.plan_id, f.step, f.text, max(e) FILTER (n <> '' AND list_contains(ws, {_KEY('n')})) AS link FROM f JOIN e ON e.plan_id = f.plan_id AND e.e < f.step GROUP BY ALL)
SELECT plan_id, step, coalesce(link, step - 1) AS link FROM l WHERE link IS NOT NULL OR regexp_matches(lower(text), '^\\s*(?:is|was|are|were|does|did|will|can)\\s+(?:that|this|it)\\b')"""


def plan_wording(spark, sf):
    s = steps(spark)
    clean = U.sanitise_step(F.col("text"), F.col("step"))
    return s.select("plan_id", "step", clean.alias("clean"), U.display_step(clean).alias("shown"), U.anchor_pronoun(F.col("text"), F.lit("Acme")).alias("anchored"), F.array_join(F.transform(U.dependencies(F.col("text")), lambda x: x.cast("string")), ",").alias("deps"))


_DISPLAY = lambda x: f"regexp_replace({x}, '\\{{(\\d+)\\}}', 'the answer to step \\1', 'g')"
PLAN_WORDING = f"""WITH {STEPS_SQL}, w AS (SELECT plan_id, step, text, unnest(list_concat([''], regexp_extract_all(text, '\\{{\\d+\\}}'))) AS mark, unnest(string_split_regex(text, '\\{{\\d+\\}}')) AS rest, unnest(range(len(string_split_regex(text, '\\{{\\d+\\}}')))) AS i FROM steps),
c AS (SELECT plan_id, step, text, string_agg(CASE WHEN mark = '' THEN '' WHEN CAST(trim(mark, '{{}}') AS INT) = 0 OR CAST(trim(mark, '{{}}') AS INT) >= step THEN 'the previous result' ELSE mark END || rest, '' ORDER BY i) AS clean FROM w GROUP BY ALL)
SELECT plan_id, step, clean, {_DISPLAY('clean')} AS shown, CASE WHEN regexp_matches(lower(text), '\\b(it|its|they|their|them)\\b') THEN text || ' (referring to: Acme)' ELSE text END AS anchored, array_to_string(list_transform(regexp_extract_all(text, '\\{{(\\d+)\\}}', 1), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS deps FROM c"""

SUBS = (
    (1, 1, "a?", "one", "fast", 1, False, 0.9, "NONE", "NONE", 10, 100), (1, 2, "b?", "two", "strong", 3, True, 0.41239, "HALLUCINATION", "STRICT_PROMPT", 20, 200), (1, 3, "c?", "three", "fast", 2, True, 0.7, "FORMAT_ERROR", "REWRITE_QUERY", 5, 50),
    (2, 1, "x?", "only", "none", 1, False, 0.0, "UNKNOWN", "NONE", 7, 0),
)
_SUBV = ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in SUBS)


def sub_answer_merge(spark, sf):
    return P.merge_answers(spark.createDataFrame(SUBS, "plan_id bigint, step bigint, text string, answer string, model string, attempts int, reflected boolean, confidence double, failure_type string, healing_action string, latency_ms bigint, tokens bigint"))


SUB_ANSWER_MERGE = f"""WITH v AS (SELECT * FROM (VALUES {_SUBV}) v(plan_id, step, text, answer, model, attempts, reflected, confidence, failure_type, healing_action, latency_ms, tokens)), f AS (SELECT plan_id, model, min(step) AS s FROM v GROUP BY ALL)
SELECT CAST(v.plan_id AS BIGINT) AS plan_id, string_agg('**' || text || '**' || chr(10) || answer, chr(10) || chr(10) ORDER BY step) AS answer, (SELECT string_agg(model, '+' ORDER BY s) FROM f WHERE f.plan_id = v.plan_id) AS model_used, CAST(max(attempts) AS BIGINT) AS attempts, bool_or(reflected) AS reflected,
 round(CAST(min(confidence) AS DOUBLE), 3) AS confidence, coalesce(min(failure_type) FILTER (failure_type NOT IN ('UNKNOWN', 'NONE')), 'UNKNOWN') AS failure_type, coalesce(string_agg(DISTINCT healing_action, '+' ORDER BY healing_action) FILTER (healing_action <> 'NONE'), 'NONE') AS healing_action,
 CAST(sum(latency_ms) AS BIGINT) AS retrieval_latency_ms, CAST(sum(tokens) AS BIGINT) AS tokens_used, 'decomposed_' || count(*) || '_subquestions' AS reason FROM v GROUP BY v.plan_id"""


def queries():
    fs = (session_turns, last_turns, list_sessions, followup_rewrite, export_markdown, chat_messages, stream_frames, token_metering, intent_counts, overlap_confidence, number_grounding, subset_sum_grounding, reflect_decision, validator, contradiction,
          evidence_verdict, cited_sources, grade_cases, eval_summary, baseline_diff, plan_dependencies, plan_back_references, plan_wording, sub_answer_merge)
    return {f.__name__: f for f in fs}


def oracle_sql():
    g = globals()
    return {n: g[n.upper()] for n in queries() if n.upper() in g}
