"""From ranked chunks to a prompt's context: dedup, rerank, diversity, selection, assembly, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citation_header, compress_words, strip, words
from ..functions.understand import injected

FINAL_K, PER_DOCUMENT, RERANK_N, MMR_LAMBDA, CONTEXT_WORDS = 5, 2, 20, 0.7, 6000


def dedup_prefix(ranked: DataFrame, by: tuple[str, ...] = ("query_id",), order: str = "rank") -> DataFrame:
    """The first of each query's rows with the same first 300 characters, without case and edges."""
    key = strip(F.lower(F.substring("text", 1, 300)))
    w = Window.partitionBy(*by, "prefix").orderBy(order)
    return ranked.withColumn("prefix", F.xxhash64(key)).withColumn("first", F.row_number().over(w)).filter("first = 1").drop("prefix", "first")


def rerank(ranked: DataFrame, k: int = FINAL_K, scorer=None) -> DataFrame:
    """The first 20 after dedup, by the scorer (a function of the DataFrame that adds `score`) or in input order; the k best."""
    w = Window.partitionBy("query_id").orderBy("rank")
    rows = dedup_prefix(ranked).withColumn("position", F.row_number().over(w).cast("bigint")).filter(F.col("position") <= RERANK_N)
    if scorer is not None:
        again = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "position")
        rows = scorer(rows).withColumn("position", F.row_number().over(again).cast("bigint"))
    return rows.filter(F.col("position") <= k)


def screen(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.filter(~F.coalesce(injected(F.col(text)), F.lit(False)))


def mmr(rows: DataFrame, k: int = FINAL_K, weight: float = MMR_LAMBDA) -> DataFrame:
    """(query_id, chunk_id, pick): greedy maximal marginal relevance over each query's few rows.

    rows: query_id, chunk_id, rank, embedding, query_vector; rows without a vector fill what is left, by rank.
    """
    kind = rows.schema["query_id"].dataType.simpleString()

    def pick(group):
        import numpy as np
        import pandas as pd

        group = group.sort_values("rank")
        has = [e is not None and len(e) > 0 for e in group["embedding"]]
        some, none = group[has], group[[not h for h in has]]
        query = next((v for v in group["query_vector"] if v is not None), None)
        if query is None or not len(some):
            order = group["chunk_id"].tolist()[:k]
        else:
            x = np.array(some["embedding"].tolist(), float)
            relevance, left, chosen = x @ np.array(query, float), list(range(len(x))), []
            while left and len(chosen) < k:
                if not chosen:
                    best = max(left, key=lambda i: (relevance[i], -i))
                else:
                    value = weight * relevance[left] - (1 - weight) * (x[left] @ x[chosen].T).max(1)
                    best = left[int(np.argmax(value))]
                chosen.append(best)
                left.remove(best)
            order = some["chunk_id"].iloc[chosen].tolist()
            order += none["chunk_id"].tolist()[: k - len(order)]
        return pd.DataFrame({"query_id": [group["query_id"].iloc[0]] * len(order), "chunk_id": order, "pick": range(1, len(order) + 1)})

    return rows.groupBy("query_id").applyInPandas(pick, f"query_id {kind}, chunk_id string, pick bigint")


def select_context(ranked: DataFrame, limit: int = FINAL_K, per_document: int = PER_DOCUMENT) -> DataFrame:
    """A parent once, at most two chunks a document, then what was skipped while there is room; `place` is the order."""
    parent = F.coalesce("parent_id", "chunk_id")
    once = ranked.withColumn("again", F.row_number().over(Window.partitionBy("query_id", parent).orderBy("rank"))).filter("again = 1")
    spread = once.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", F.coalesce("filename", F.lit(""))).orderBy("rank")))
    placed = spread.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("nth") > per_document, "rank")).cast("bigint"))
    return placed.filter((F.col("nth") <= per_document) | (F.col("place") <= limit)).drop("again", "nth")


def expand_parents(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """rows with the text of their parent in place of their own, where parents (parent_id, parent_text) has one that isn't empty."""
    full = parents.filter("parent_text <> ''").groupBy("parent_id").agg(F.min("parent_text").alias("parent_text"))
    return rows.join(full, "parent_id", "left").withColumn("text", F.coalesce("parent_text", "text")).drop("parent_text")


def with_citations(rows: DataFrame) -> DataFrame:
    """Text cut to 300 words under a header that names its source."""
    return rows.withColumn("text", F.concat(citation_header(F.col("filename"), F.col("page"), F.col("section")), F.lit("\n"), compress_words(F.col("text"))))


def build_context(rows: DataFrame, order: str = "place") -> DataFrame:
    """(query_id, context, n_chunks): labelled texts by file in the order files first occur, by page and index within."""
    first = F.min(order).over(Window.partitionBy("query_id", "filename"))
    label = F.concat(F.lit("[Source: "), F.col("filename"), F.lit(" | Page "), F.col("page").cast("string"), F.lit("]\n"), F.col("text"), F.lit("\n"))
    item = F.struct(F.col("first"), F.col("page"), F.col("chunk_index"), F.col("chunk_id"), label.alias("label"))
    packed = rows.withColumn("first", first).groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))  # at most a few rows a query
    text = F.array_join(F.transform("items", lambda x: x["label"]), "\n")
    return packed.select("query_id", F.array_join(F.slice(words(text), 1, CONTEXT_WORDS), " ").alias("context"), F.size("items").cast("bigint").alias("n_chunks"))


def relevance_bars(score, best):
    return F.when((best > 0) & (score > 0), F.greatest(F.lit(1), F.least(F.lit(5), F.round(score / best * 5).cast("int")))).otherwise(F.lit(1))


def cited_sources(rows: DataFrame) -> DataFrame:
    """Rows (answer_id, answer, filename, ...) whose file the answer cites; an answer that cites none of its files keeps all."""
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"[‐-―−]", "-"), r"[\s  ]+", " "))
    tags = F.regexp_extract_all(plain(F.col("answer")), F.lit(r"[\[【]\s*source:([^\]】]*)[\]】]"), F.lit(1))
    marked = rows.withColumn("cited", F.exists(tags, lambda t: F.contains(t, plain(F.col("filename")))))
    any_ = F.max("cited").over(Window.partitionBy("answer_id"))
    return marked.withColumn("any", any_).filter(F.col("cited") | ~F.col("any")).drop("any")
