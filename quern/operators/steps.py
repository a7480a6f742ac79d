"""Multi-step questions: dependencies, blocked steps, back-references, merged answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.understand import dependencies, noun_key

MOST_STEPS = 4


def blocked_steps(steps: DataFrame, answered: str = "answered") -> DataFrame:
    """(plan_id, step, blocked): a step is blocked if one it depends on is blocked or has no answer.

    Plans have at most four steps, so three rounds reach the fixpoint.
    """
    edges = steps.select("plan_id", "step", F.explode(dependencies(F.col("text"))).alias("dep"))
    state = steps.select("plan_id", "step", answered, F.lit(False).alias("blocked"))
    for _ in range(MOST_STEPS - 1):
        bad = state.filter(F.col("blocked") | ~F.col(answered)).select("plan_id", F.col("step").alias("dep"))
        hit = edges.join(bad, ["plan_id", "dep"], "left_semi").select("plan_id", "step").distinct().withColumn("hit", F.lit(True))
        state = state.join(hit, ["plan_id", "step"], "left").select("plan_id", "step", answered, F.coalesce("hit", F.lit(False)).alias("blocked"))
    return state.select("plan_id", "step", "blocked")


def back_references(steps: DataFrame) -> DataFrame:
    """(plan_id, step, link, by_noun): the latest earlier step whose words hold the noun of "that/this/... noun"; else the step
    before for a bare pronoun that opens a yes/no step. Steps with a placeholder, and first steps, have no link."""
    words = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9-]*"), F.lit(0)), noun_key))
    noun = noun_key(F.regexp_extract(F.lower("text"), r"\b(?:that|this|those|these|the same)\s+([a-z][a-z0-9-]*)", 1))
    free = steps.filter((F.col("step") > 1) & (F.size(dependencies(F.col("text"))) == 0)).select("plan_id", "step", "text", noun.alias("noun"))
    earlier = steps.select("plan_id", F.col("step").alias("e"), words(F.col("text")).alias("words"))
    found = free.join(earlier, "plan_id").filter((F.col("e") < F.col("step")) & (F.col("noun") != "") & F.array_contains("words", F.col("noun")))
    link = found.groupBy("plan_id", "step").agg(F.max("e").alias("link"))
    bare = F.lower("text").rlike(r"^\s*(?:is|was|are|were|does|did|will|can)\s+(?:that|this|it)\b")
    out = free.join(link, ["plan_id", "step"], "left").withColumn("by_noun", F.col("link").isNotNull()).withColumn("link", F.coalesce("link", F.when(bare, F.col("step") - 1)))
    return out.filter("link IS NOT NULL").select("plan_id", "step", "link", "by_noun")


def promote(steps: DataFrame, plan: str = "query_id") -> DataFrame:
    """Steps whose back-references (see back_references) are placeholders: "When does that vendor's ..." -> "When does {1}'s ..."."""
    named = steps.withColumnRenamed(plan, "plan_id")
    link = back_references(named.select("plan_id", "step", "text"))
    noun = F.regexp_extract(F.lower("text"), r"\b(?:that|this|those|these|the same)\s+([a-z][a-z0-9-]*)", 1)
    mark = F.concat(F.lit("{"), F.col("link").cast("string"), F.lit("}"))
    shown = F.regexp_replace(F.col("text"), F.concat(F.lit(r"(?i)\b(?:that|this|those|these|the same)\s+"), noun, F.lit(r"\b")), mark)
    bare = F.regexp_replace(F.col("text"), F.lit(r"(?i)^(\s*(?:is|was|are|were|does|did|will|can)\s+)(?:that|this|it)\b"), F.concat(F.lit("$1"), mark))
    text = F.when(F.col("link").isNull(), F.col("text")).when(F.col("by_noun"), shown).otherwise(bare)
    return named.join(link, ["plan_id", "step"], "left").withColumn("text", text).drop("link", "by_noun").withColumnRenamed("plan_id", plan)


def merge_answers(sub: DataFrame) -> DataFrame:
    """One row a plan: least confidence, summed work, models in the order they first ran, first real failure by name."""
    seq = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("step", c))), lambda x: x[c])
    real = lambda c, none: F.sort_array(F.collect_set(F.when(~F.col(c).isin(*none), F.col(c))))
    failures, actions = real("failure_type", ("UNKNOWN", "NONE")), real("healing_action", ("NONE",))
    return sub.groupBy("plan_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "text", "answer"))), lambda x: F.concat(F.lit("**"), x["text"], F.lit("**\n"), x["answer"])), "\n\n").alias("answer"),
        F.array_join(F.array_distinct(seq("model")), "+").alias("model_used"), F.max("attempts").cast("bigint").alias("attempts"), F.bool_or("reflected").alias("reflected"), F.round(F.min("confidence"), 3).alias("confidence"),
        F.when(F.size(failures) > 0, F.element_at(failures, 1)).otherwise("UNKNOWN").alias("failure_type"), F.when(F.size(actions) > 0, F.array_join(actions, "+")).otherwise("NONE").alias("healing_action"),
        F.sum("latency_ms").cast("bigint").alias("retrieval_latency_ms"), F.sum("tokens").cast("bigint").alias("tokens_used"), F.concat(F.lit("decomposed_"), F.count("*").cast("string"), F.lit("_subquestions")).alias("reason"),
    )
