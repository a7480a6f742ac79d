"""Question answering for a whole table of questions: retrieve, gate, rerank, assemble, generate, check, heal.

Each attempt is one plan over the questions that are still open, so later attempts work on ever fewer rows;
the state between attempts is a checkpointed table of one small row per question.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import understand as U
from ..functions import verify as V
from ..functions.text import words
from ..operators import context as C
from ..operators import retrieval as R
from ..operators import steps as P
from ..plugins import NOT_FOUND, UNAVAILABLE, Plugins, resolve_step, steps
from ..session import materialise

MOST_ATTEMPTS, MOST_TOP_K = 3, 20
#: Least confidence of an accepted answer; below the second a judge is asked; best score that makes "not found" doubtful.
LEAST_CONFIDENCE, JUDGED_BELOW, RECHECK_SCORE = 0.4, 0.7, 3.0
#: Reasons that end in "not found".
REFUSALS = ("explicit_not_found", "no_chunks_retrieved", "answer_too_short_max_attempts", "ungrounded_numbers_strong_model_failed")
#: Intents whose context should come from many files.
BALANCED = ("compare", "meta")


def attempt(open_: DataFrame, pool: DataFrame, vectors: DataFrame | None, plugins: Plugins, parents: DataFrame | None = None) -> DataFrame:
    """One answer a question: (query_id, answer, context, score, n_chunks), of the texts of the parents where these are known.

    Questions that compare, or ask about the documents themselves, fuse the best chunks of every file with the dense list.
    """
    q = open_.select("query_id", "query", "top_k")
    sparse = materialise(R.top_k(R.bm25(q.select("query_id", "query"), pool), R.TOP_BM25).select("query_id", "chunk_id", "score", "rank"))
    embedded = None
    if plugins.embed is not None and vectors is not None:
        embedded = materialise(plugins.embed(q.select("query_id", F.col("query").alias("text"))).select("query_id", "embedding"))
        dense = materialise(R.dense_top_k(embedded, vectors, R.TOP_DENSE, dimensions=plugins.dimensions).select("query_id", "chunk_id", "score", "rank"))
        rows = R.hybrid(sparse, dense, R.TOP_BM25).drop("mode")
    else:
        dense, rows = sparse.limit(0), sparse
    wide = open_.filter(F.col("intent").isin(*BALANCED)).select("query_id", "query")
    if not wide.isEmpty():
        ids = F.broadcast(wide.select("query_id")) if wide.limit(R.BROADCAST_ROWS + 1).count() <= R.BROADCAST_ROWS else wide.select("query_id")
        per_file = R.rank_all(R.balanced(wide, pool).drop("rank"))
        fused = R.fuse(per_file, dense.join(ids, "query_id", "left_semi"), long=True)
        rows = rows.join(ids, "query_id", "left_anti").unionByName(fused.select(*rows.columns))
    fallback = sparse.join(q.select("query_id", "top_k"), "query_id").filter(F.col("rank") <= F.col("top_k")).drop("top_k")
    gated = R.score_gate(rows, fallback).select("query_id", "chunk_id", "score")
    ranked = R.rank_all(gated).join(pool, "chunk_id")
    top = C.rerank(C.screen(ranked), scorer=plugins.rerank).drop("rank").withColumnRenamed("position", "rank")
    best = top.groupBy("query_id").agg(F.max("score").alias("score"))
    if embedded is not None:
        top = materialise(top)
        full = top.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left").join(embedded.withColumnRenamed("embedding", "query_vector"), "query_id", "left")
        picks = C.mmr(full.select("query_id", "chunk_id", "rank", "embedding", "query_vector"))
        top = top.drop("rank").join(picks, ["query_id", "chunk_id"]).withColumnRenamed("pick", "rank")
    picked = C.select_context(top)
    ctx = C.build_context(picked if parents is None else C.expand_parents(picked, parents))
    asked = open_.join(ctx, "query_id", "left").join(best, "query_id", "left")
    model = F.when(F.col("force_strong"), F.lit("strong")).otherwise(U.route(F.col("query"), F.coalesce("score", F.lit(0.0))))
    asked = asked.withColumn("model", model).withColumn("mode", F.when(F.col("strict"), "strict").otherwise("normal"))
    if plugins.generate is None:
        return asked.withColumn("answer", F.lit(UNAVAILABLE))
    return plugins.generate(asked)


def start_state(queries: DataFrame, intent: Column) -> DataFrame:
    """The loop's state before its first attempt; queries: (query_id, query)."""
    no = F.lit(False)
    return queries.select("query_id", "query", F.col("query").alias("original"), intent.alias("intent"), F.lit(C.FINAL_K).alias("top_k"), no.alias("strict"), no.alias("force_strong"), no.alias("rechecked"), F.lit("NONE").alias("last_action"))


def heal(open_: DataFrame, attempt_of: Callable[[DataFrame, int], DataFrame], plugins: Plugins) -> DataFrame:
    """Up to three attempts a question; one row each: (query_id, query, answer, decision, reason, confidence, failure_type,
    attempts, reflected, model, action, tokens).

    attempt_of gives the open questions an answer, its model, context, best score and n_chunks (null or 0: nothing found).
    An outage ends at once. "Not found" is asked once more of the stronger model where the best score is high. An answer
    that passes all checks with confidence enough is accepted, after a judge where confidence is middling at the first
    attempt. All else is healed and tried again; after the last attempt the last answer stays and its reason says so.
    """
    done: list[DataFrame] = []
    for k in range(MOST_ATTEMPTS):
        last = k == MOST_ATTEMPTS - 1
        got = attempt_of(open_, k).withColumn("f", V.features(F.col("query"), F.col("answer"), F.col("context")))
        got = materialise(got.withColumn("against", V.contradicts(F.col("query"), F.col("answer"), F.coalesce("context", F.lit("")))))
        strong, nothing = F.col("model") == "strong", F.coalesce(F.col("n_chunks"), F.lit(0)) == 0
        seen = got.withColumn("d", V.decide(F.col("f"), F.lit(k), strong, F.col("against")))
        passed = F.col("d.valid") & (F.col("d.confidence") >= LEAST_CONFIDENCE)
        if k == 0 and plugins.judge is not None:
            asked = seen.filter(passed & (F.col("d.confidence") < JUDGED_BELOW) & ~nothing & (F.col("answer") != UNAVAILABLE))
            seen = seen.join(plugins.judge(asked).select("query_id", "faithful"), "query_id", "left").withColumn("doubted", F.coalesce(~F.col("faithful"), F.lit(False))).drop("faithful")
        else:
            seen = seen.withColumn("doubted", F.lit(False))
        found = F.col("d.reason") == "explicit_not_found"
        recheck = found & ~F.col("rechecked") & ~strong & (F.coalesce("score", F.lit(0.0)) >= RECHECK_SCORE)
        outcome = F.when(F.col("answer") == UNAVAILABLE, "outage").when(nothing, "nothing")
        if not last:
            outcome = outcome.when(recheck, "recheck")
        outcome = outcome.when(F.col("d.reason").isin(*REFUSALS), "refused").when(passed & ~F.col("doubted"), "accepted").otherwise("again")
        failure = F.when(F.col("answer") == UNAVAILABLE, "UNKNOWN").when(nothing, "RETRIEVAL_FAILURE").when(F.col("doubted"), "HALLUCINATION").otherwise(V.failure_type(F.col("d.reason"), F.lit(k)))
        seen = materialise(seen.withColumn("outcome", outcome).withColumn("failure_type", failure))
        fin = seen if last else seen.filter(F.col("outcome").isin("outage", "refused", "accepted"))
        reason = F.when(F.col("outcome") == "outage", "provider_unavailable").when(F.col("outcome") == "nothing", "no_results_after_retry").when(F.col("outcome") == "again", F.concat("d.reason", F.lit("_max_attempts_reached"))).otherwise(F.col("d.reason"))
        said = F.when(F.col("outcome").isin("refused", "nothing"), F.lit(NOT_FOUND)).otherwise(F.col("answer"))
        silent = F.col("outcome").isin("nothing", "outage")
        done.append(
            fin.select(
                "query_id", F.col("original").alias("query"), said.alias("answer"), F.when(silent, "refuse").otherwise(F.col("d.decision")).alias("decision"), reason.alias("reason"), F.when(silent, 0.0).otherwise(F.col("d.confidence")).alias("confidence"),
                "failure_type", F.lit(k + 1).alias("attempts"), ((F.col("outcome") == "again") | F.lit(k > 0)).alias("reflected"), F.when(F.col("outcome") == "nothing", "none").otherwise(F.col("model")).alias("model"), F.col("last_action").alias("action"),
                F.floor(F.size(words(said)) * 4 / 3).cast("bigint").alias("tokens"),
            )
        )
        rest = seen.filter(F.col("outcome").isin("nothing", "recheck", "again"))
        if last or rest.isEmpty():
            break
        action = F.when(F.col("outcome") == "recheck", F.col("last_action")).otherwise(V.healing_action(F.col("failure_type")))
        rest = rest.withColumn("action", action).withColumn("heals", F.col("outcome") != "recheck")
        does = lambda name: F.col("heals") & (F.col("action") == name)
        rewritten = U.first_line(plugins.rewrite(F.col("original")), F.col("original")) if plugins.rewrite else F.col("query")
        open_ = rest.select(
            "query_id", F.when(does("REWRITE_QUERY"), rewritten).otherwise(F.col("query")).alias("query"), "original", "intent", F.when(does("INCREASE_TOP_K"), F.least(F.col("top_k") + 5, F.lit(MOST_TOP_K))).otherwise(F.col("top_k")).alias("top_k"),
            (F.col("strict") | does("STRICT_PROMPT")).alias("strict"), (F.col("force_strong") | (F.col("outcome") == "recheck") | does("STRICT_PROMPT") & (F.col("d.decision") == "retry_model") & ~strong).alias("force_strong"),
            (F.col("rechecked") | (F.col("outcome") == "recheck")).alias("rechecked"), F.col("action").alias("last_action"),
        )
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def reingest_queue(outcomes: DataFrame) -> DataFrame:
    """(query, reason) of the questions whose documents should be read anew; formats.append_jsonl keeps them."""
    return outcomes.filter("action = 'REINGEST'").select("query", "reason")


def answer_steps(plans: DataFrame, attempt_of: Callable[[DataFrame, int], DataFrame], plugins: Plugins) -> DataFrame:
    """plans: (query_id, step, text, intent), at most four steps each, in order. One merged row a plan.

    All plans take a step together. A step that needs one without an answer is refused; others get the answers they refer
    to in place of their numbers, or the answer before for a pronoun. An outage ends its plan with that result.
    """
    plans = materialise(P.promote(plans.withColumn("text", U.sanitise_step(F.col("text"), F.col("step")))))
    results: DataFrame | None = None
    ended: DataFrame | None = None
    for n in range(1, P.MOST_STEPS + 1):
        now = plans.filter(F.col("step") == n)
        if now.isEmpty():
            break
        if results is None:
            now = now.withColumn("answers", F.create_map().cast("map<bigint,string>")).withColumn("open", F.array().cast("array<int>")).withColumn("prior", F.lit(""))
        else:
            ready = F.col("answered")
            past = results.groupBy("query_id").agg(  # at most three steps a plan
                F.map_from_entries(F.collect_list(F.struct("step", "answer"))).alias("answers"), F.collect_list(F.when(~ready, F.col("step").cast("int"))).alias("open"),
                F.max(F.when((F.col("step") == n - 1) & (F.col("reason") != "dependency_unresolved"), F.col("answer"))).alias("prior"),
            )
            now = now.join(past, "query_id")
            now = now.join(ended.select("query_id"), "query_id", "left_anti")
        needs = U.dependencies(F.col("text"))
        missing = F.sort_array(F.array_intersect(needs, "open"))
        now = now.withColumn("missing", missing).withColumn("needs", F.size(needs) > 0)
        inlined = resolve_step(F.col("text"), {i: F.coalesce(F.element_at("answers", F.lit(i).cast("bigint")), F.lit("")) for i in range(1, n)})
        now = materialise(now.withColumn("question", F.when(F.col("needs"), inlined).otherwise(U.anchor_pronoun(F.col("text"), F.col("prior")))))
        header = F.when(F.col("needs"), U.display_step(F.col("text"))).otherwise(F.col("text")).alias("text")
        stuck = now.filter(F.size("missing") > 0)
        why = F.concat(F.lit("Could not answer this step because it depends on step "), F.array_join(F.transform("missing", lambda x: x.cast("string")), ", "), F.lit(", which was not found in the documents."))
        none = F.lit("NONE")
        blocked = stuck.select("query_id", "step", header, why.alias("answer"), F.lit("none").alias("model"), F.lit(1).alias("attempts"), F.lit(False).alias("reflected"), F.lit(0.0).alias("confidence"), F.lit("RETRIEVAL_FAILURE").alias("failure_type"), none.alias("healing_action"), F.lit(0).cast("bigint").alias("tokens"), F.lit("dependency_unresolved").alias("reason"), F.lit(False).alias("answered"))
        free = now.filter(F.size("missing") == 0)
        got = heal(start_state(free.select("query_id", F.col("question").alias("query"), "intent"), F.col("intent")), attempt_of, plugins)
        mine = free.select("query_id", "step", header).join(got.drop("query"), "query_id")
        mine = mine.select("query_id", "step", "text", "answer", "model", "attempts", "reflected", "confidence", "failure_type", F.col("action").alias("healing_action"), "tokens", "reason", ((F.col("answer") != NOT_FOUND) & (F.col("answer") != "")).alias("answered"))
        new = materialise(mine.unionByName(blocked))
        results = new if results is None else results.unionByName(new)
        over = new.filter("reason = 'provider_unavailable'")
        ended = over if ended is None else ended.unionByName(over)
    if results is None:
        raise ValueError("plans have no first step")
    cols = ["query_id", "answer", "model_used", "attempts", "reflected", "confidence", "failure_type", "healing_action", "tokens_used", "reason"]
    whole = results.join(ended.select("query_id"), "query_id", "left_anti")
    many = whole.groupBy("query_id").agg(F.count("*").alias("n"))
    whole = whole.join(many, "query_id")
    merged = P.merge_answers(whole.filter("n > 1").withColumnRenamed("query_id", "plan_id").withColumn("latency_ms", F.lit(0))).withColumnRenamed("plan_id", "query_id").select(*cols)
    single = whole.filter("n = 1").select(*results.columns).unionByName(ended)
    single = single.select("query_id", "answer", F.col("model").alias("model_used"), F.col("attempts").cast("bigint").alias("attempts"), "reflected", F.round("confidence", 3).alias("confidence"), "failure_type", "healing_action", F.col("tokens").alias("tokens_used"), "reason")
    return merged.unionByName(single.select(*cols))


def answer(queries: DataFrame, pool: DataFrame, vectors: DataFrame | None = None, plugins: Plugins | None = None, parents: DataFrame | None = None) -> DataFrame:
    """(query_id, query, answer, decision, reason, confidence, failure_type, attempts, reflected, model, action, tokens).

    Blocked questions are refused at once; without a generator nothing is retried. With a planner (Plugins.decompose)
    questions of several parts go through answer_steps instead and come out merged: decision and query as for any other.
    """
    plugins = plugins or Plugins()
    safe = U.safety(F.col("query"), plugins.unsafe(F.col("query")) if plugins.unsafe else None)
    start = queries.select("query_id", U.normalise(F.col("query")).alias("query")).withColumn("s", safe)
    refused = start.filter(~F.col("s.safe")).select("query_id", "query", F.lit("Blocked.").alias("answer"), F.lit("refuse").alias("decision"), F.col("s.reason").alias("reason"), F.lit(0.0).alias("confidence"), F.lit("UNKNOWN").alias("failure_type"), F.lit(0).alias("attempts"), F.lit(False).alias("reflected"), F.lit("none").alias("model"), F.lit("NONE").alias("action"), F.lit(0).cast("bigint").alias("tokens"))
    fine = start.filter("s.safe").select("query_id", "query")
    once = lambda open_, _k: attempt(open_, pool, vectors, plugins, parents)
    if plugins.decompose is None:
        return refused.unionByName(heal(start_state(fine, U.intent(F.col("query"))), once, plugins))
    parts = U.maybe_multipart(F.col("query"))
    single = heal(start_state(fine.filter(~parts), U.intent(F.col("query"))), once, plugins)
    many = fine.filter(parts)
    if many.isEmpty():
        return refused.unionByName(single)
    plans = steps(plugins, many).filter(F.col("step") <= P.MOST_STEPS).join(many.select("query_id", U.intent(F.col("query")).alias("intent")), "query_id")
    merged = answer_steps(plans, once, plugins).join(many, "query_id")
    merged = merged.select("query_id", "query", "answer", F.when(F.col("confidence") > 0, "accept").otherwise("refuse").alias("decision"), "reason", "confidence", "failure_type", F.col("attempts").cast("int").alias("attempts"), "reflected", F.col("model_used").alias("model"), F.col("healing_action").alias("action"), F.col("tokens_used").alias("tokens"))
    return refused.unionByName(single).unionByName(merged)


def suggestions(cards: DataFrame, pool: DataFrame, scorer=None, least: float = -5.0, k: int = 5) -> DataFrame:
    """(topic, label, icon, color, prompts): generated cards (topic INT, label, icon, color, prompts ARRAY<STRING>), sanitised and gated.

    The first four cards; labels to 30 characters, icons to 4, colours from the palette or by place, four prompts at most. A prompt
    stays if the best score of its top rows is at least `least`; without a scorer it is the retrieval score. Cards without a prompt go.
    """
    colour = F.when(F.col("color").isin(*PALETTE), F.col("color")).otherwise(F.element_at(F.array(*map(F.lit, PALETTE)), F.pmod(F.col("topic"), F.lit(len(PALETTE))) + 1))
    kept = F.slice(F.filter("prompts", lambda p: p.isNotNull()), 1, 4)
    label = F.substring(F.coalesce("label", F.concat(F.lit("Topic "), (F.col("topic") + 1).cast("string"))), 1, 30)
    clean = materialise(cards.filter(F.col("topic").between(0, 3)).select("topic", label.alias("label"), F.substring(F.coalesce("icon", F.lit("📄")), 1, 4).alias("icon"), colour.alias("color"), kept.alias("prompts")))
    asked = clean.select("topic", F.posexplode("prompts").alias("place", "query")).withColumn("query_id", F.col("topic").cast("bigint") * 4 + F.col("place"))
    rows = R.top_k(R.bm25(asked.select("query_id", "query"), pool), R.TOP_BM25).select("query_id", "chunk_id", "score", "rank").join(pool, "chunk_id")
    best = C.rerank(rows, k, scorer).groupBy("query_id").agg(F.max("score").alias("best")).filter(F.col("best") >= least)
    good = asked.join(best, "query_id").groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "query"))), lambda x: x["query"]).alias("prompts"))
    return clean.drop("prompts").join(good, "topic")


#: Colours of cards.
PALETTE = ("#8b4a12", "#3f7350", "#9c5a28", "#3d6b78", "#a1483a", "#8a5d14", "#6b5638", "#3d5c48")
