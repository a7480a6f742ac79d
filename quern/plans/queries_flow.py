"""Registered composites: chunking of whole documents, HTML, the self-healing loop, and streams with their batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import TIMESTAMP, is_log
from ..operators.chunking import chunk_pages, split_logs
from ..sources import formats
from ..sources.io import table
from ..streaming import streams as X


def chunk_documents(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    return chunk_pages(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_id"), F.lit(1).alias("page"), "text"))


def log_entries(spark, sf):
    logs = split_logs(table(spark, sf, "documents").filter(is_log(F.col("text"))))
    return logs.select("doc_id", F.posexplode("entries").alias("pos", "entry"))


PAGES = (
    (1, "<html><head><style>b{}</style><script>var t=\"</p>\";</script></head><body><h1>Cost &amp; plan</h1><p>One <b>two</b></p></body></html>"), (2, "plain text"), (3, "<p> </p>\n<!-- no --><div>a<br>b</div>"), (4, None), (5, ""),
)


def html_to_text(spark, sf):
    return formats.html_text(spark.createDataFrame(PAGES, "page_id bigint, html string"), "page_id", "html")


def stream_counters(spark, sf):
    return X.latest(X.drain(X.counters(X.source(spark, sf, "events")), "complete"))


STREAM_COUNTERS = "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1"


def stream_rate_limit(spark, sf):
    """Windows the watermark has closed: those that end an hour or more before the latest event."""
    return X.drain(X.rate_limits(X.source(spark, sf, "events")), "append").select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


STREAM_RATE_LIMIT = "SELECT user_id, date_trunc('minute', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1 AND date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def stream_last_events(spark, sf):
    return X.newest_per_key(X.drain(X.last_events(X.source(spark, sf, "events")), "update"), "user_id")


STREAM_LAST_EVENTS = "WITH k AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id FROM k"


def stream_distinct(spark, sf):
    return X.drain(X.distinct_events(X.source(spark, sf, "events").select("event_id", "ts", "user_id")), "append").groupBy("user_id").agg(F.count("*").alias("n"))


STREAM_DISTINCT = "SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY 1"


def stream_versions(spark, sf):
    """The feedback log as a change feed: each batch of files is a version of the table."""
    return X.versions(X.source(spark, sf, "feedback_logs").select("id", "query", "success"), "id")


STREAM_VERSIONS = "SELECT 0 AS version, count(DISTINCT id) AS changed, count(DISTINCT id) AS added FROM feedback_logs"


_TXT = lambda x: f"regexp_replace(regexp_replace({x}, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g')"
_HV = ", ".join("({}, {})".format(i, "NULL" if h is None else "'" + h.replace("'", "''") + "'") for i, h in PAGES)
HTML_TO_TEXT = f"""WITH v AS (SELECT CAST(page_id AS BIGINT) AS page_id, html FROM (VALUES {_HV}) v(page_id, html))
SELECT page_id, array_to_string(list_filter(list_transform(string_split({_TXT('html')}, chr(10)), lambda x: trim(replace(x, '&amp;', '&'))), lambda x: x <> ''), chr(10)) AS text FROM v"""

_LOGL = "list_filter(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: regexp_matches(x, '[^ \\t\\r\\n\\f\\v]'))"
LOG_ENTRIES = f"""WITH RECURSIVE d AS (SELECT doc_id, {_LOGL} AS ls FROM documents WHERE text IS NOT NULL), g AS (SELECT * FROM d WHERE len(ls) > 0 AND len(list_filter(ls[1:50], lambda x: regexp_matches(x[1:40], '{TIMESTAMP}'))) >= 0.3 * len(ls[1:50])),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM g),
m AS (SELECT doc_id, i, line, regexp_matches(line[1:40], '{TIMESTAMP}') AS stamped, regexp_matches(line, '(?i)\\b(ERROR|EXCEPTION|CRITICAL|FATAL|WARN)\\b') AS bad, regexp_matches(line, '(?i)^\\s+at\\s+|^\\s+File\\s+"|^\\s+Traceback') AS trace FROM l),
w AS (SELECT doc_id, i, 0 AS pos, bad AS tracing FROM m WHERE i = 1
 UNION ALL SELECT m.doc_id, m.i, w.pos + CASE WHEN m.stamped AND NOT w.tracing THEN 1 ELSE 0 END, CASE WHEN m.bad THEN true ELSE w.tracing AND NOT m.stamped AND m.trace END FROM w JOIN m ON m.doc_id = w.doc_id AND m.i = w.i + 1)
SELECT w.doc_id, w.pos, string_agg(line, chr(10) ORDER BY w.i) AS entry FROM w JOIN m ON m.doc_id = w.doc_id AND m.i = w.i GROUP BY ALL"""


def queries():
    fs = (chunk_documents, log_entries, html_to_text, stream_counters, stream_rate_limit, stream_last_events, stream_distinct, stream_versions)
    return {f.__name__: f for f in fs}


def oracle_sql():
    g = globals()
    return {n: g[n.upper()] for n in queries() if n.upper() in g}
