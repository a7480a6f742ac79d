"""Batched retrieval: BM25, dense top-k, rank fusion, gates, caches. Queries are the small side of every join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.understand import expand
from ..session import materialise, parallelism
from .index import postings, sized, term_stats

K1, B, RRF_K = 1.5, 0.75, 60
TOP_BM25, TOP_DENSE, BM25_THRESHOLD, FUSED_THRESHOLD = 20, 20, 0.1, 0.01
#: Queries up to this many rows (a few MB of terms or vectors) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Query vectors multiplied at once (2 MB).
QUERY_BLOCK = 4_096


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, term, mult): tokens of the expanded query; a repeated token counts as often as it stands."""
    return queries.select(query_id, F.explode(tokens(expand(F.col(text)))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("mult"))


def bm25(queries: DataFrame, pool: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, keys..., chunk_id, score) for chunks with a term of the query; statistics by `keys` if given.

    Where the queries' terms are few (checked), tokens that no query has are dropped before any shuffle.
    """
    rows, q = sized(pool, keys=keys), query_terms(queries)
    few = q.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    post = postings(rows, keys=keys, terms=q.select("term").distinct() if few else None)
    stats = term_stats(rows, keys)
    if few:
        q = F.broadcast(q)
        stats = stats.join(F.broadcast(q.select("term").distinct()), "term", "left_semi")
    hit = post.join(stats, [*keys, "term"]).join(q, "term")
    part = F.col("mult") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query_id", *keys, "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), id_: str = "chunk_id") -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller id."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(id_))
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def rank_all(scored: DataFrame, id_: str = "chunk_id") -> DataFrame:
    """top_k without an end: ranks of lists of any length. Rows are cut by range; a task numbers its stretch of a list, and
    only the lengths of stretches are summed up a list."""
    order = [F.col("score").desc(), F.col(id_)]
    cut = materialise(scored.repartitionByRange("query_id", *order).withColumn("part", F.spark_partition_id()))
    size = cut.groupBy("query_id", "part").agg(F.count("*").alias("n"))
    ahead = size.withColumn("ahead", F.sum("n").over(Window.partitionBy("query_id").orderBy("part")) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))
    return cut.withColumn("nth", nth).join(ahead, ["query_id", "part"]).withColumn("rank", (F.col("ahead") + F.col("nth")).cast("bigint")).drop("part", "nth", "ahead")


def filtered_pool(pool: DataFrame, condition) -> DataFrame:
    """Whole files that have a chunk meeting the condition; nothing meets it: nothing comes out."""
    return pool.join(pool.filter(condition).select("file_id").distinct(), "file_id", "left_semi")


def balanced(queries: DataFrame, pool: DataFrame, per_file: int = 2) -> DataFrame:
    """Best chunks of every file, scored within the file; files whose best stays below the threshold drop out."""
    ranked = top_k(bm25(queries, pool, ("file_id",)), per_file, ("query_id", "file_id"))
    best = F.max("score").over(Window.partitionBy("query_id", "file_id"))
    return ranked.withColumn("best", best).filter(F.col("best") >= BM25_THRESHOLD).drop("best")


def dense_top_k(queries: DataFrame, pool: DataFrame, k: int, query_id: str = "query_id", id_: str = "chunk_id", vector: str = "embedding", skip_self: bool = False, dimensions: int = 64, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): exact cosine top k of every query against all rows, in blocks.

    Queries are numbered and packed into blocks; each block is multiplied with every slice of the pool in a task that keeps
    its k best rows a query, so k rows a query and slice are shuffled, never all pairs. A single block travels with the
    code; more of them are a table that is joined to the slices, so the driver holds one block at most. Vectors that are
    null, not of `dimensions` values, zero or not finite match nothing.
    """
    kind, qkind = pool.schema[id_].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    v = F.col(vector).cast("array<double>")
    fine = lambda d: d.filter(F.size(vector) == dimensions).filter(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    asked = fine(queries).select(F.col(query_id).alias("q"), v.alias("v"))
    rows = fine(pool).select(F.col(id_).alias("i"), v.alias("x"))
    schema = f"{query_id} {qkind}, {id_} {kind}, score double"
    most = k + int(skip_self)

    def best(q: np.ndarray, ids: list, keys: pa.Array, vectors: pa.Array) -> pa.RecordBatch:
        x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(keys), dimensions)
        s = np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
        names = keys.to_pylist()
        place = np.argsort(np.argsort(np.array(names, dtype=object)))  # ties go to the smaller id
        n = min(len(names), most)
        top = np.array([np.lexsort((place, -r))[:n] for r in s])
        j = top.ravel()
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in np.repeat(np.arange(len(q)), n).tolist()]).cast(_arrow(qkind)), pa.array([names[i] for i in j.tolist()]).cast(_arrow(kind)), pa.array(s[np.repeat(np.arange(len(q)), n), j])], names=[query_id, id_, "score"])

    unit = lambda vs: (lambda q: q / np.linalg.norm(q, axis=1, keepdims=True))(np.array(vs, np.float64).reshape(len(vs), dimensions))
    first = asked.limit(block + 1).toArrow()
    if first.num_rows <= block:
        held = first.sort_by("q")
        q, ids = unit(held.column("v").to_pylist()), held.column("q").to_pylist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(ids):
                    yield best(q, ids, batch.column(0), batch.column(1))

        out = rows.mapInArrow(run, schema)
    else:
        n_blocks = F.greatest(F.ceil(F.lit(asked.count()) / block), F.lit(1)).cast("int")
        packed = asked.withColumn("b", F.pmod(F.xxhash64("q"), n_blocks).cast("int"))
        slices = 4 * parallelism(pool.sparkSession)
        sliced = rows.withColumn("s", F.pmod(F.xxhash64("i"), F.lit(slices)).cast("int"))
        # Every block meets every slice: blocks are sent to each slice's key, slices to each block's.
        left = packed.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        right = sliced.withColumn("b", F.explode(F.sequence(F.lit(0), n_blocks - 1)))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({query_id: pa.array([], _arrow(qkind)), id_: pa.array([], _arrow(kind)), "score": pa.array([], pa.float64())})
            q, ids = unit(a.column("v").to_pylist()), a.column("q").to_pylist()
            return pa.Table.from_batches([best(q, ids, x.column("i"), x.column("x")) for x in b.combine_chunks().to_batches(8192)])

        out = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(meet, schema)
    if skip_self:
        out = out.filter(F.col(query_id) != F.col(id_))
    return top_k(out, k, (query_id,), id_)


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def fuse(a: DataFrame, b: DataFrame, k: int = RRF_K, id_: str = "chunk_id", long: bool = False) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: one shuffle of the union. (query_id, id, score, rank). long: lists of any length."""
    both = a.select("query_id", id_, "rank").unionByName(b.select("query_id", id_, "rank"))
    fused = both.groupBy("query_id", id_).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))
    return rank_all(fused, id_) if long else top_k(fused, 1 << 30, id_=id_)


def hybrid(sparse: DataFrame, dense: DataFrame, k: int, id_: str = "chunk_id") -> DataFrame:
    """Fused list where both sides have rows for a query, else the side that has; `mode` says which."""
    n_a = sparse.groupBy("query_id").agg(F.count("*").alias("a"))
    n_b = dense.groupBy("query_id").agg(F.count("*").alias("b"))
    sides = n_a.join(n_b, "query_id", "full_outer").select("query_id", F.when(F.col("a").isNull(), "dense").when(F.col("b").isNull(), "sparse").otherwise("fused").alias("mode"))
    parts = [fuse(sparse, dense, id_=id_).withColumn("from", F.lit("fused")), sparse.select("query_id", id_, "score", "rank").withColumn("from", F.lit("sparse")), dense.select("query_id", id_, "score", "rank").withColumn("from", F.lit("dense"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.join(sides, "query_id").filter((F.col("from") == F.col("mode")) & (F.col("rank") <= k)).drop("from")


def score_gate(fused: DataFrame, sparse: DataFrame) -> DataFrame:
    """Fused rows of 0.01 or more; a query without any falls back to its BM25 rows of 0.1 or more."""
    good = fused.filter(F.col("score") >= FUSED_THRESHOLD).select("query_id", "chunk_id", "score", F.lit("fused").alias("gate"))
    rest = sparse.filter(F.col("score") >= BM25_THRESHOLD).select("query_id", "chunk_id", "score", F.lit("fallback").alias("gate"))
    return good.unionByName(rest.join(good.select("query_id").distinct(), "query_id", "left_anti"))


def cache_lookup(lookups: DataFrame, cached: DataFrame, threshold: float = 0.97, id_: str = "vec_id", vector: str = "embedding", skip_self: bool = False) -> DataFrame:
    """(query_id, hit, cached_id, similarity): the most similar cached entry, the smaller id among equals."""
    near = dense_top_k(lookups, cached, 1, id_=id_, vector=vector, skip_self=skip_self)
    hit = F.col("score") >= threshold
    return near.select("query_id", hit.alias("hit"), F.when(hit, F.col(id_)).alias("cached_id"), F.col("score").alias("similarity"))
