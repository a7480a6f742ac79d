"""Registered retrieval and context queries over the chunk pool, with their SQL.

Questions are the golden queries, numbered in order. A question's vector is the embedding of the first
valid chunk of the file expected to answer it; questions without such a file have none and fall back to
BM25 alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import retrieval as R
from ..operators.index import current_chunks, sized, term_stats
from ..session import materialise
from ..sources.io import table
from .queries_text import EXPAND_SQL, POOL, TOKENS

GOLD = "gold AS (SELECT CAST(row_number() OVER (ORDER BY query, expected_filename NULLS FIRST) AS BIGINT) AS query_id, * FROM golden_queries)"


def gold(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.orderBy("query", F.col("expected_filename").asc_nulls_first())  # 40 fixed rows
    return table(spark, sf, "golden_queries").withColumn("query_id", F.row_number().over(w).cast("bigint"))


def pool(spark: SparkSession, sf: str) -> DataFrame:
    return current_chunks(table(spark, sf, "chunks"))


def _bm25_sql(pool_name: str = "pool", key: str = "") -> str:
    """CTEs up to scored(query_id, [key], chunk_id, score)."""
    k, on = (f"{key}, ", f"{key}, ") if key else ("", "")
    group = f"GROUP BY {key}" if key else ""
    use = f" JOIN size USING ({key})" if key else ", size"
    mean = f" JOIN mean USING ({key})" if key else ", mean"
    return f"""
tok AS (SELECT {k}chunk_id, unnest({TOKENS('text')}) AS term FROM {pool_name}),
post AS (SELECT {k}chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT {k}chunk_id, coalesce(len({TOKENS('text')}), 0) AS dl FROM {pool_name}),
size AS (SELECT {k}count(*) AS n_docs, avg(dl) AS avgdl FROM dl {group}),
df AS (SELECT {k}term, count(*) AS df FROM post GROUP BY ALL),
raw AS (SELECT df.*, n_docs, avgdl, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df{use}),
mean AS (SELECT {k}avg(raw) AS mean FROM raw {group}),
stats AS (SELECT {k}term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf, avgdl FROM raw{mean}),
qt AS (SELECT query_id, term, count(*) AS mult FROM (SELECT query_id, unnest({TOKENS('(' + EXPAND_SQL + ')')}) AS term FROM gold) GROUP BY ALL),
scored AS (SELECT query_id, {k}chunk_id, round(sum(mult * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN stats USING ({on}term) JOIN dl USING ({on}chunk_id) JOIN qt USING (term) GROUP BY ALL)"""


def _rank(frm: str, k: int, by: str = "query_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, chunk_id) AS rank FROM {frm} QUALIFY rank <= {k}"


_VALID = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0"
VECTORS = f"""emb AS (SELECT chunk_id, min(embedding) AS embedding FROM chunks WHERE {_VALID} GROUP BY chunk_id),
gvec AS (SELECT query_id, min_by(embedding, chunk_id) AS qv FROM gold JOIN pool ON filename = expected_filename JOIN emb USING (chunk_id) GROUP BY query_id),
dense_all AS (SELECT query_id, chunk_id, round(list_dot_product(qv, embedding) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(embedding, embedding))), 6) AS score FROM gvec, emb),
dense AS ({_rank('dense_all', 20)})"""
BASE = f"WITH {GOLD}, {POOL}, {_bm25_sql()}"
SPARSE = f"sparse AS ({_rank('scored', 20)})"
FUSED = f"""f0 AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM sparse UNION ALL SELECT query_id, chunk_id, rank FROM dense) GROUP BY ALL),
fused AS ({_rank('f0', 1 << 30)})"""
HYBRID = f"""sides AS (SELECT query_id, CASE WHEN a IS NULL THEN 'dense' WHEN b IS NULL THEN 'sparse' ELSE 'fused' END AS mode FROM (SELECT query_id, count(*) AS a FROM sparse GROUP BY 1) FULL JOIN (SELECT query_id, count(*) AS b FROM dense GROUP BY 1) USING (query_id)),
hyb AS (SELECT e.query_id, chunk_id, score, rank, mode FROM (SELECT query_id, chunk_id, score, rank, 'fused' AS src FROM fused UNION ALL SELECT query_id, chunk_id, score, rank, 'sparse' FROM sparse UNION ALL SELECT query_id, chunk_id, score, rank, 'dense' FROM dense) e JOIN sides s ON e.query_id = s.query_id AND src = mode WHERE rank <= 20)"""
FULL = f"{BASE}, {SPARSE}, {VECTORS}, {FUSED}, {HYBRID}"


def vectors(chunks: DataFrame) -> DataFrame:
    """(chunk_id, embedding) with 64 finite values that are not all zero, one row a chunk."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("embedding").isNotNull() & (F.size("embedding") == 64) & ~bad & F.exists("embedding", lambda x: x != 0)
    return chunks.filter(good).groupBy("chunk_id").agg(F.min("embedding").alias("embedding"))


def sparse_top(spark, sf):
    return R.top_k(R.bm25(gold(spark, sf), pool(spark, sf)), R.TOP_BM25).select("query_id", "chunk_id", "score", "rank")


def query_vectors(spark, sf):
    names = pool(spark, sf).select("chunk_id", F.col("filename").alias("expected_filename"))
    emb = vectors(table(spark, sf, "chunks"))
    mine = names.join(F.broadcast(gold(spark, sf)), "expected_filename").select("query_id", "chunk_id").join(emb, "chunk_id")
    return mine.groupBy("query_id").agg(F.min_by("embedding", "chunk_id").alias("embedding"))


def dense_top(spark, sf):
    return R.dense_top_k(query_vectors(spark, sf), vectors(table(spark, sf, "chunks")), R.TOP_DENSE).select("query_id", "chunk_id", "score", "rank")


def _sides(spark, sf):
    return materialise(sparse_top(spark, sf)), materialise(dense_top(spark, sf))


def bm25_term_stats(spark, sf):
    return term_stats(sized(pool(spark, sf))).select("term", "df", F.round("idf", 6).alias("idf"))


BM25_TERM_STATS = f"{BASE} SELECT term, df, round(idf, 6) AS idf FROM stats"


def bm25_topk(spark, sf):
    return R.top_k(R.bm25(gold(spark, sf), pool(spark, sf)), 5).filter(F.col("score") >= R.BM25_THRESHOLD).select("query_id", "chunk_id", "score", "rank")


BM25_TOPK = f"{BASE} SELECT query_id, chunk_id, score, rank FROM ({_rank('scored', 5)}) WHERE score >= 0.1"


def bm25_filtered_pool(spark, sf):
    """Statistics of the filtered pool only: whole files that have a chunk on page 3."""
    return R.top_k(R.bm25(gold(spark, sf), R.filtered_pool(pool(spark, sf), F.col("page") == 3)), 5).select("query_id", "chunk_id", "score", "rank")


BM25_FILTERED_POOL = f"WITH {GOLD}, {POOL}, part_pool AS (SELECT * FROM pool WHERE file_id IN (SELECT file_id FROM pool WHERE page = 3)), {_bm25_sql('part_pool')} SELECT query_id, chunk_id, score, rank FROM ({_rank('scored', 5)})"


def balanced_topk(spark, sf):
    return R.balanced(gold(spark, sf), pool(spark, sf)).select("query_id", "file_id", "chunk_id", "score", "rank")


BALANCED_TOPK = f"""WITH {GOLD}, {POOL}, {_bm25_sql('pool', 'file_id')}, r AS ({_rank('scored', 2, 'query_id, file_id')})
SELECT query_id, file_id, chunk_id, score, rank FROM r QUALIFY max(score) OVER (PARTITION BY query_id, file_id) >= 0.1"""


def dense_topk(spark, sf):
    """Every hundredth vector as a query against all the others."""
    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense_top_k(q, e, 10, id_="vec_id", skip_self=True).select("query_id", "vec_id", "score", "rank")


DENSE_TOPK = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10"""


def rrf_fusion(spark, sf):
    return R.fuse(*_sides(spark, sf)).select("query_id", "chunk_id", "score", "rank")


RRF_FUSION = f"{BASE}, {SPARSE}, {VECTORS}, {FUSED} SELECT query_id, chunk_id, score, rank FROM fused"


def hybrid_rows(spark, sf):
    return R.hybrid(*_sides(spark, sf), 20)


def hybrid_search(spark, sf):
    return hybrid_rows(spark, sf).select("query_id", "chunk_id", "score", "rank", "mode")


HYBRID_SEARCH = f"{FULL} SELECT * FROM hyb"


def score_gate(spark, sf):
    sparse, dense = _sides(spark, sf)
    # Questions without a vector have no fused rows: they fall back.
    return R.score_gate(R.hybrid(sparse, dense, 1 << 30).filter("mode = 'fused'"), sparse)


SCORE_GATE = f"""{BASE}, {SPARSE}, {VECTORS}, {FUSED}, good AS (SELECT query_id, chunk_id, score FROM fused WHERE query_id IN (SELECT query_id FROM gvec) AND query_id IN (SELECT query_id FROM sparse) AND score >= 0.01)
SELECT *, 'fused' AS gate FROM good UNION ALL SELECT query_id, chunk_id, score, 'fallback' FROM sparse WHERE score >= 0.1 AND query_id NOT IN (SELECT query_id FROM good)"""


def balanced_fusion(spark, sf):
    """Balanced lists fused with dense ones: no file crowds the others out."""
    ranked = R.balanced(gold(spark, sf), pool(spark, sf)).drop("rank")
    return R.fuse(R.rank_all(ranked), dense_top(spark, sf), long=True).select("query_id", "chunk_id", "score", "rank")


BALANCED_FUSION = f"""WITH {GOLD}, {POOL}, {_bm25_sql('pool', 'file_id')}, r AS ({_rank('scored', 2, 'query_id, file_id')}),
b AS (SELECT query_id, chunk_id, score FROM r QUALIFY max(score) OVER (PARTITION BY query_id, file_id) >= 0.1), sparse AS ({_rank('b', 1 << 30)}), {VECTORS}, {FUSED} SELECT query_id, chunk_id, score, rank FROM fused"""


def dedup_prefix(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", "text", F.lit(1).alias("query_id"))
    rows = d.withColumn("rank", F.col("doc_id"))
    # The prefix key spreads the rows: one query's whole corpus is never one group.
    return C.dedup_prefix(rows, by=()).select("doc_id")


DEDUP_PREFIX = "SELECT doc_id FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY regexp_replace(lower(substring(text, 1, 300)), '\\A[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+\\z', '', 'g') ORDER BY doc_id) = 1"


def ranked_rows(spark, sf):
    return materialise(hybrid_rows(spark, sf)).join(pool(spark, sf), "chunk_id")


_ROWS = "rows AS (SELECT * FROM hyb JOIN pool USING (chunk_id))"
_RERANK = """dd AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY query_id, regexp_replace(lower(substring(text, 1, 300)), '\\A[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+\\z', '', 'g') ORDER BY rank) = 1),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM dd QUALIFY position <= 5)"""
_SELECT = """one AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(parent_id, chunk_id) ORDER BY rank) = 1),
nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(filename, '') ORDER BY rank) AS nth FROM one),
sel AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY nth > 2, rank) AS place FROM nth QUALIFY nth <= 2 OR place <= 5)"""


def rerank_fallback(spark, sf):
    return C.rerank(ranked_rows(spark, sf)).select("query_id", "chunk_id", "position")


RERANK_FALLBACK = f"{FULL}, {_ROWS}, {_RERANK} SELECT query_id, chunk_id, position FROM rr"


def select_context(spark, sf):
    return C.select_context(ranked_rows(spark, sf)).select("query_id", "chunk_id", "place")


SELECT_CONTEXT = f"{FULL}, {_ROWS}, {_SELECT} SELECT query_id, chunk_id, place FROM sel"


def build_context(spark, sf):
    top = C.rerank(ranked_rows(spark, sf)).drop("rank").withColumnRenamed("position", "rank")
    return C.build_context(C.select_context(top))


_CTX_ROWS = "rows5 AS (SELECT * EXCLUDE (rank, position), position AS rank FROM rr)"
BUILD_CONTEXT = f"""{FULL}, {_ROWS}, {_RERANK}, {_CTX_ROWS}, {_SELECT.replace('FROM rows ', 'FROM rows5 ')}, o AS (SELECT *, min(place) OVER (PARTITION BY query_id, filename) AS first FROM sel),
t AS (SELECT query_id, string_agg('[Source: ' || filename || ' | Page ' || page || ']' || chr(10) || text || chr(10), chr(10) ORDER BY first, page NULLS FIRST, chunk_index NULLS FIRST, chunk_id) AS body, count(*) AS n_chunks FROM o GROUP BY query_id)
SELECT query_id, array_to_string(list_filter(string_split_regex(body, '[ \\t\\r\\n\\f]+'), lambda w: w <> '')[1:6000], ' ') AS context, n_chunks FROM t"""


def cite_and_compress(spark, sf):
    rows = C.with_citations(C.screen(pool(spark, sf).filter("text IS NOT NULL")))
    return rows.select("chunk_id", F.sha2("text", 256).alias("text_hash"), F.char_length("text").cast("bigint").alias("n_chars"))


_INJ = "ignore (previous|above|all) instructions|disregard (all|the) (previous|above|prior) (instructions|rules)|you are now (a|an|the)|pretend you are|act as if you (are|were)|forget (all|your) (previous|prior) instructions|jailbreak|new persona|reveal (the|your) system prompt"
CITE_AND_COMPRESS = f"""WITH {POOL}, s AS (SELECT *, list_filter(string_split_regex(text, '[ \\t\\r\\n\\f]+'), lambda w: w <> '') AS w FROM pool WHERE text IS NOT NULL AND NOT regexp_matches(lower(text), '{_INJ}')),
t AS (SELECT chunk_id, '[Source: ' || coalesce(filename, 'unknown') || ' | Page ' || coalesce(CAST(page AS VARCHAR), '?') || CASE WHEN coalesce(section, '') = '' THEN '' ELSE ' | ' || section END || ']' || chr(10) || CASE WHEN len(w) <= 300 THEN text ELSE array_to_string(w[1:300], ' ') || ' […]' END AS text FROM s)
SELECT chunk_id, sha256(text) AS text_hash, length(text) AS n_chars FROM t"""


def mmr_select(spark, sf):
    rows = hybrid_rows(spark, sf)
    q = query_vectors(spark, sf).withColumnRenamed("embedding", "query_vector")
    full = rows.join(vectors(table(spark, sf, "chunks")), "chunk_id", "left").join(F.broadcast(q), "query_id", "left")
    return C.mmr(full.select("query_id", "chunk_id", "rank", "embedding", "query_vector"))


MMR_SELECT = f"""{FULL.replace("WITH ", "WITH RECURSIVE ", 1)}, cand AS (SELECT h.query_id, h.chunk_id, h.rank, e.embedding AS v, qv FROM hyb h LEFT JOIN emb e USING (chunk_id) LEFT JOIN gvec USING (query_id)),
has AS (SELECT *, list_dot_product(v, qv) AS rel FROM cand WHERE v IS NOT NULL AND qv IS NOT NULL),
pick AS (SELECT query_id, 1 AS n, [chunk_id] AS ids, [v] AS vs FROM has QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) = 1
 UNION ALL SELECT query_id, n, ids, vs FROM (SELECT p.query_id, p.n + 1 AS n, list_append(p.ids, h.chunk_id) AS ids, list_append(p.vs, h.v) AS vs, row_number() OVER (PARTITION BY p.query_id ORDER BY 0.7 * h.rel - 0.3 * list_max(list_transform(p.vs, lambda x: list_dot_product(x, h.v))) DESC, h.rank) AS best
  FROM pick p JOIN has h ON h.query_id = p.query_id WHERE p.n < 5 AND NOT list_contains(p.ids, h.chunk_id)) WHERE best = 1),
last AS (SELECT query_id, max_by(ids, n) AS ids FROM pick GROUP BY 1), fill AS (SELECT query_id, list(chunk_id ORDER BY rank) AS rest FROM cand WHERE v IS NULL OR qv IS NULL GROUP BY 1),
whole AS (SELECT query_id, (list_concat(coalesce(ids, []), coalesce(rest, [])))[1:5] AS ids FROM last FULL JOIN fill USING (query_id))
SELECT query_id, unnest(ids) AS chunk_id, unnest(range(1, len(ids) + 1)) AS pick FROM whole"""


def semantic_cache_lookup(spark, sf):
    """Every hundredth vector looked up in a cache of all the others, and of slightly changed copies of some."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = e.filter("vec_id % 200 = 0").select((F.col("vec_id") + 10_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: F.when(i == 0, x * 1.01).otherwise(x)).alias("embedding"))
    return R.cache_lookup(q, e.unionByName(near), skip_self=True)


SEMANTIC_CACHE_LOOKUP = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT * FROM e UNION ALL SELECT vec_id + 10000000, list_transform(v, lambda x, i: CASE WHEN i = 1 THEN x * 1.01 ELSE x END) FROM e WHERE vec_id % 200 = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score FROM e a, c b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) = 1)
SELECT query_id, score >= 0.97 AS hit, CASE WHEN score >= 0.97 THEN vec_id END AS cached_id, score AS similarity FROM r"""


def relevance_bars(spark, sf):
    rows = hybrid_rows(spark, sf)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return rows.select("query_id", "chunk_id", C.relevance_bars(F.col("score"), best).cast("bigint").alias("bars"), F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("bigint").alias("passage"))


RELEVANCE_BARS = f"""{FULL} SELECT query_id, chunk_id, CAST(CASE WHEN max(score) OVER w > 0 AND score > 0 THEN greatest(1, least(5, round(score / max(score) OVER w * 5))) ELSE 1 END AS BIGINT) AS bars,
 row_number() OVER (PARTITION BY query_id ORDER BY rank) AS passage FROM hyb WINDOW w AS (PARTITION BY query_id)"""


def retrieval_eval(spark, sf):
    """A golden query is a hit if its top five hold the expected file and any expected keyword."""
    top = hybrid_rows(spark, sf).filter("rank <= 5").join(pool(spark, sf).select("chunk_id", "filename", "text"), "chunk_id")
    g = gold(spark, sf).filter(F.col("expected_filename").isNotNull())
    per = top.groupBy("query_id").agg(F.collect_set("filename").alias("files"), F.lower(F.array_join(F.collect_list("text"), " ")).alias("words"))
    j = g.join(per, "query_id", "left")
    word = F.exists("expected_keywords", lambda k: F.contains(F.col("words"), F.lower(k)))
    hit = F.coalesce(F.array_contains("files", F.col("expected_filename")) & word, F.lit(False))
    return j.select("query_id", hit.alias("hit")).groupBy().agg(F.count("*").alias("total"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("hit_rate"))


RETRIEVAL_EVAL = f"""{FULL}, top AS (SELECT query_id, list(DISTINCT filename) AS files, lower(string_agg(text, ' ')) AS words FROM hyb JOIN pool USING (chunk_id) WHERE rank <= 5 GROUP BY query_id),
h AS (SELECT coalesce(list_contains(files, expected_filename) AND len(list_filter(expected_keywords, lambda k: contains(words, lower(k)))) > 0, false) AS hit FROM gold LEFT JOIN top USING (query_id) WHERE expected_filename IS NOT NULL)
SELECT count(*) AS total, count(*) FILTER (hit) AS hits, round(avg(CAST(hit AS DOUBLE)), 4) AS hit_rate FROM h"""


def queries():
    fs = (bm25_term_stats, bm25_topk, bm25_filtered_pool, balanced_topk, dense_topk, rrf_fusion, hybrid_search, score_gate, balanced_fusion, dedup_prefix, rerank_fallback, select_context,
          build_context, cite_and_compress, mmr_select, semantic_cache_lookup, relevance_bars, retrieval_eval)
    return {f.__name__: f for f in fs}


def oracle_sql():
    g = globals()
    return {n: g[n.upper()] for n in queries() if n.upper() in g}
