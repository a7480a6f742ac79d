"""Where models plug in, and what happens without them.

Each hook is a function; None means the deterministic fallback: no vectors (retrieval is BM25 alone), input
order instead of a reranker, a fixed "unavailable" answer, the question itself as its only step, answers
inlined into dependent steps, the question unchanged on retry, every answer faithful, every question safe.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import compact_answer

UNAVAILABLE = "Service temporarily unavailable. Please try again."
NOT_FOUND = "Not found in the document."


@dataclass
class Plugins:
    """embed: texts (query_id, text) -> (query_id, embedding). rerank: ranked rows -> rows with `score`. generate: rows
    (query_id, query, context, mode, model) -> with `answer`. decompose: queries -> (query_id, step, text).
    rewrite: Column -> Column. judge: rows -> rows with `faithful`. unsafe: Column -> Column. dimensions: of the vectors. Parsers of formats are given to formats.read_documents."""

    embed: Callable[[DataFrame], DataFrame] | None = None
    rerank: Callable[[DataFrame], DataFrame] | None = None
    generate: Callable[[DataFrame], DataFrame] | None = None
    decompose: Callable[[DataFrame], DataFrame] | None = None
    rewrite: Callable[[Column], Column] | None = None
    judge: Callable[[DataFrame], DataFrame] | None = None
    unsafe: Callable[[Column], Column] | None = None
    dimensions: int = 64


def steps(plugins: Plugins, queries: DataFrame) -> DataFrame:
    """(query_id, step, text); without a planner each question is its own only step."""
    if plugins.decompose is not None:
        return plugins.decompose(queries)
    return queries.select("query_id", F.lit(1).cast("bigint").alias("step"), F.col("query").alias("text"))


def resolve_step(text: Column, answers: dict[int, Column]) -> Column:
    """The step with the compacted answers of earlier steps in place of their numbers."""
    for n, a in answers.items():
        text = F.replace(text, F.lit(f"{{{n}}}"), F.concat(F.lit("("), compact_answer(a), F.lit(")")))
    return text


def first_sentence(rows: DataFrame) -> DataFrame:
    """A generator without a model: the first two passages of the context, with its source. For tests and dry runs."""
    body = F.regexp_extract("context", r"(?s)^\[Source: [^\]]*\] ?(.*?)(?: \[Source: |$)", 1)
    return rows.withColumn("answer", F.when(F.coalesce("context", F.lit("")) == "", F.lit(NOT_FOUND)).otherwise(F.substring(body, 1, 400)))


def prompt(query: Column, context: Column, intent: Column, strict: Column) -> Column:
    """The text a generator is given: a rule for the kind of question, the context, the question."""
    rule = (
        F.when(intent == "compare", F.lit("Set the things asked about side by side and name their differences.")).when(intent == "summarize", F.lit("Summarise the main points in a few sentences."))
        .when(intent == "explain", F.lit("Explain step by step in plain words.")).when(intent == "meta", F.lit("Answer about the documents themselves.")).otherwise(F.lit("Answer the question from the context alone."))
    )
    tight = F.when(strict, F.lit(" Use only words and numbers the context holds; otherwise reply: Not found in the document.")).otherwise(F.lit(""))
    return F.concat(rule, tight, F.lit("\n\nContext:\n"), context, F.lit("\n\nQuestion: "), query)
