"""The registered queries of this subpackage, and the SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import table
from . import encode, knn, mix, neardup, pii, scans, spam, split


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    cuts = split.split_texts(table(spark, sf, "chunks"), cuts_only=True)
    return cuts.select("chunk_id", F.col("start_at").alias("cut_at")).distinct()


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_texts(table(spark, sf, "chunks"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    links, members = neardup.links_and_members(table(spark, sf, "chunks"))
    return neardup.pairs_of_keys(links, members, ("chunk_a", "chunk_b"))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunk's group, named by its least chunk_id, and how many other sets of words it is linked to."""
    rows = neardup.near_duplicate_groups(table(spark, sf, "chunks"))
    names = rows.groupBy("group").agg(F.min("chunk_id").alias("name"))
    return rows.join(names, "group").select("chunk_id", F.col("name").alias("group"), "n_links")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = scans.faults(table(spark, sf, "chunks"), table(spark, sf, "file_register"))
    return found.select("chunk_id", "line_no", "fault", "repaired").distinct()


def p3_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return scans.repair(table(spark, sf, "chunks"), table(spark, sf, "file_register"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return knn.neighbour_pairs(table(spark, sf, "chunks"), ("chunk_a", "chunk_b"))


def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return knn.neighbours(table(spark, sf, "chunks"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    items = pii.find_items(table(spark, sf, "chunks"))
    return items.select("chunk_id", "start_at", F.col("kind").alias("pii_kind")).distinct()


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact_texts(table(spark, sf, "chunks")).dropDuplicates(["chunk_id"])


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_texts(table(spark, sf, "documents"), vocabulary=encode.vocabulary_path())


def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mix.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), encode.vocabulary_path())


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[1]


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    pages = spam.spam_pages(table(spark, sf, "documents"))
    return pages.filter("is_spam").select("doc_id").distinct()


def p8_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return spam.shape_groups(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_groups, p3_found, p3_repaired, p4_found, p4_neighbours, p5_found, p5_redacted, p6_ids, p7_mixture, p7_shares, p8_found, p8_shapes)}


P1_FOUND = r"""
WITH c AS (SELECT chunk_id, min(text) AS text FROM chunks WHERE length(text) > 1600 GROUP BY 1),
l AS (SELECT chunk_id, i, ls[i] AS l FROM (SELECT chunk_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT chunk_id, string_split(text, chr(10)) AS ls FROM c))),
o AS (SELECT *, coalesce(sum(length(l) + 1) OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, NOT regexp_matches(l, '[^ \t\r]') AS blank,
 regexp_matches(l, '^\[?(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|[A-Z][a-z]{2} [ \d]\d \d{2}:\d{2})') AS dated FROM l),
k AS (SELECT *, first_value(dated) OVER (PARTITION BY chunk_id ORDER BY blank, i) AS is_log, coalesce(lag(blank) OVER (PARTITION BY chunk_id ORDER BY i), true) AS after_blank FROM o),
u AS (SELECT *, sum(CASE WHEN is_log THEN CAST(dated AS INT) ELSE CAST(after_blank AND NOT blank AS INT) END) OVER (PARTITION BY chunk_id ORDER BY i) AS uid FROM k),
s AS (SELECT chunk_id, uid, min(off + length(l) - length(regexp_replace(l, '^[ \t\r]+', ''))) AS a, max(off + length(regexp_replace(l, '[ \t\r]+$', ''))) AS b FROM u WHERE NOT blank GROUP BY ALL),
p AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM s WINDOW w AS (PARTITION BY chunk_id ORDER BY uid))
SELECT chunk_id, CAST(a AS BIGINT) AS cut_at FROM p WHERE b - a <= 1600 AND pb - pa <= 1600 AND b - pa > 1600"""

#: Prefix filter: sets that are similar enough share one of their rarest words; what shares one is compared whole.
P2_FOUND = r"""
WITH w AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(min(text)), '[a-z0-9]+')) AS ws FROM chunks GROUP BY 1),
s AS (SELECT chunk_id, ws, len(ws) AS n FROM w WHERE len(ws) >= 20),
t AS (SELECT chunk_id, n, unnest(ws) AS word FROM s), d AS (SELECT word, count(*) AS df FROM t GROUP BY 1),
r AS (SELECT chunk_id, n, word FROM t JOIN d USING (word) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY df, word) <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b FROM r a JOIN r b ON a.word = b.word AND a.chunk_id < b.chunk_id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n),
j AS (SELECT c.*, len(list_intersect(x.ws, y.ws)) AS i, x.n + y.n AS m FROM c JOIN s x ON x.chunk_id = chunk_a JOIN s y ON y.chunk_id = chunk_b)
SELECT chunk_a, chunk_b FROM j WHERE i >= 0.8 * (m - i)"""


P2_GROUPS = (
    P2_FOUND.replace("WITH w AS", "WITH RECURSIVE w AS", 1).replace(")\nSELECT chunk_a, chunk_b FROM j WHERE i >= 0.8 * (m - i)", "),\n")
    + """p AS (SELECT chunk_a AS a, chunk_b AS b FROM j WHERE i >= 0.8 * (m - i)), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT chunk_id AS a, chunk_id AS b FROM s UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b), g AS (SELECT a, min(b) AS name FROM reach GROUP BY 1),
n AS (SELECT e.a, count(DISTINCT list_sort(y.ws)) AS k FROM e JOIN s x ON x.chunk_id = e.a JOIN s y ON y.chunk_id = e.b WHERE list_sort(x.ws) <> list_sort(y.ws) GROUP BY 1)
SELECT chunk_id, name AS "group", coalesce(k, 0) AS n_links FROM s JOIN g ON g.a = chunk_id LEFT JOIN n ON n.a = chunk_id"""
)


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_groups": P2_GROUPS}
