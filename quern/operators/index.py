"""The sparse index: tokens, postings and corpus statistics.

Everything is aggregated by term with map-side combine; no posting list is ever collected into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import spread


#: Ids delivered more than once, up to this many, become a local table (a few MB); with more, all rows are merged by a shuffle.
LOCAL_IDS = 50_000


def current_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk_id however often it was delivered: (chunk_id, file_id, filename, page, chunk_index, section, parent_id, text).

    Ids alone are shuffled to find those delivered again; rows of the others pass through as they are scanned.
    """
    m = F.col("metadata")
    flat = chunks.select("chunk_id", "file_id", m["filename"].alias("filename"), m["page"].cast("bigint").alias("page"), m["chunk_index"].cast("bigint").alias("chunk_index"), m["section"].alias("section"), m["parent_id"].alias("parent_id"), "text")
    flat = spread(flat)
    merge = lambda d: d.groupBy("chunk_id").agg(*[F.min(c).alias(c) for c in flat.columns[1:]])
    again = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id")
    ids = again.limit(LOCAL_IDS + 1).toArrow()
    if ids.num_rows > LOCAL_IDS:
        return merge(flat)
    if not ids.num_rows:
        return flat
    again = F.broadcast(chunks.sparkSession.createDataFrame(ids))
    return flat.join(again, "chunk_id", "left_anti").unionByName(merge(flat.join(again, "chunk_id", "left_semi")))


def parent_texts(chunks: DataFrame) -> DataFrame:
    """(parent_id, parent_text): the parents that some chunk carries the text of."""
    m = F.col("metadata")
    rows = chunks.select(m["parent_id"].alias("parent_id"), m["parent_text"].alias("parent_text"))
    return rows.filter("parent_id IS NOT NULL AND parent_text <> ''").groupBy("parent_id").agg(F.min("parent_text").alias("parent_text"))


def sized(pool: DataFrame, id_: str = "chunk_id", text: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., id, toks, dl): tokens of each row and their number; rows without tokens count, with 0."""
    rows = pool.select(*keys, id_, tokens(F.col(text)).alias("toks"))
    return rows.withColumn("dl", F.coalesce(F.size("toks"), F.lit(0)).cast("bigint"))


def postings(rows: DataFrame, id_: str = "chunk_id", keys: tuple[str, ...] = (), terms: DataFrame | None = None) -> DataFrame:
    """(keys..., id, dl, term, tf) of sized rows; with terms (a small table) only those: other tokens go before the shuffle."""
    # An outer explode: for an inner one the optimiser adds filters that would tokenise every text again.
    post = rows.select(*keys, id_, "dl", F.explode_outer("toks").alias("term")).filter("term IS NOT NULL")
    if terms is not None:
        post = post.join(F.broadcast(terms), "term", "left_semi")
    return post.groupBy(*keys, id_, "dl", "term").agg(F.count("*").alias("tf"))


def term_stats(rows: DataFrame, keys: tuple[str, ...] = (), epsilon: float = 0.25) -> DataFrame:
    """(keys..., term, df, idf, avgdl): idf = ln(N - df + 0.5) - ln(df + 0.5); where negative, epsilon times the mean idf.

    A row's tokens are made distinct before they are exploded, so document counts need no shuffle of postings.
    """
    one = [] if keys else [F.lit(1).alias("one")]
    names = list(keys) or ["one"]
    small = (lambda d: d) if keys else F.broadcast  # without keys: one row
    size = rows.select(*keys, "dl", *one).groupBy(*names).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = rows.select(*keys, F.explode_outer(F.array_distinct("toks")).alias("term"), *one).filter("term IS NOT NULL").groupBy(*names, "term").agg(F.count("*").alias("df"))
    raw = df.join(small(size), names).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(*names).agg(F.avg("raw").alias("mean"))
    out = raw.join(small(mean), names)
    return out.select(*keys, "term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avgdl")
