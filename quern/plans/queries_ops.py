"""Registered operational queries: counters, table maintenance, leases, limits, and analytic extensions; with their SQL.

The pipeline log is made of the events: the kind of event gives the verdict, its number the attempt.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import counters as K
from ..operators import store as D
from ..operators.index import current_chunks
from ..sources.io import table
from .queries_text import POOL


def log(spark, sf):
    e = table(spark, sf, "events")
    kind = lambda **m: F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in m.items()])
    return e.select(
        "event_id", "ts", "user_id", F.col("value").alias("latency_ms"), kind(error="regex", view="passed", click="passed", purchase="passed", signup="passed").alias("safety_decision"), (F.col("event_type") == "error").alias("flagged"),
        kind(view="fast", click="strong", purchase="fast").alias("model"), (F.col("event_id") % 4 + 1).cast("int").alias("attempts"), kind(click="low_overlap_max_attempts_reached", signup="explicit_not_found", error="no_chunks_retrieved", view="passed_all_checks").alias("reflection_reason"),
        kind(click="REWRITE_QUERY", signup="STRICT_PROMPT", error="INCREASE_TOP_K", purchase="odd").alias("healing_action"), kind(error="HALLUCINATION", signup="RETRIEVAL_FAILURE", click="strange").alias("failure_type"), (F.col("value") / 100).alias("confidence"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens_used"),
    )


def _case(**m):
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"


LOG = f"""log AS (SELECT event_id, ts, user_id, value AS latency_ms, {_case(error="regex", view="passed", click="passed", purchase="passed", signup="passed")} AS safety_decision, event_type = 'error' AS flagged, {_case(view="fast", click="strong", purchase="fast")} AS model,
 event_id % 4 + 1 AS attempts, {_case(click="low_overlap_max_attempts_reached", signup="explicit_not_found", error="no_chunks_retrieved", view="passed_all_checks")} AS reflection_reason, {_case(click="REWRITE_QUERY", signup="STRICT_PROMPT", error="INCREASE_TOP_K", purchase="odd")} AS healing_action,
 {_case(error="HALLUCINATION", signup="RETRIEVAL_FAILURE", click="strange")} AS failure_type, value / 100 AS confidence, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_used FROM events)"""


def pipeline_counters(spark, sf):
    return K.outcomes(log(spark, sf))


_REF = "(" + ", ".join(f"'{r}'" for r in K.REFUSED) + ")"
PIPELINE_COUNTERS = f"""WITH {LOG} SELECT count(*) AS total_queries, count(*) FILTER (safety_decision IN ('regex', 'classifier')) AS blocked, count(*) FILTER (flagged) AS flagged, count(*) FILTER (model = 'fast') AS fast, count(*) FILTER (model = 'strong') AS strong,
 count(*) FILTER (coalesce(model, 'none') NOT IN ('fast', 'strong')) AS none, count(*) FILTER (coalesce(reflection_reason, '') IN {_REF}) AS refused, count(*) FILTER (coalesce(reflection_reason, '') NOT IN {_REF} AND reflection_reason LIKE '%_max_attempts_reached') AS best_effort,
 count(*) FILTER (attempts > 1 AND healing_action IN ('REWRITE_QUERY', 'INCREASE_TOP_K')) AS retry_search, count(*) FILTER (attempts > 1 AND healing_action = 'STRICT_PROMPT') AS retry_model, {", ".join(f"count(*) FILTER (least(attempts, 3) = {k}) AS attempt_{k}" for k in (1, 2, 3))},
 round(avg(confidence), 4) AS avg_confidence, CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS tokens FROM log"""


def failure_histogram(spark, sf):
    return K.histogram(log(spark, sf), "failure_type", K.FAILURES, "UNKNOWN")


def _hist(col, buckets, unknown):
    return f"""WITH {LOG}, c AS (SELECT CASE WHEN coalesce({col}, '') = '' THEN 'NONE' WHEN {col} IN ({", ".join(f"'{b}'" for b in buckets)}) THEN {col} ELSE '{unknown}' END AS bucket, count(*) AS k FROM log GROUP BY 1)
SELECT b.bucket, coalesce(k, 0) AS n FROM (VALUES {", ".join(f"('{b}')" for b in buckets)}) b(bucket) LEFT JOIN c USING (bucket)"""


FAILURE_HISTOGRAM = _hist("failure_type", K.FAILURES, "UNKNOWN")


def healing_histogram(spark, sf):
    return K.histogram(log(spark, sf), "healing_action", K.ACTIONS, "NONE")


HEALING_HISTOGRAM = _hist("healing_action", K.ACTIONS, "NONE")


def feedback_failures(spark, sf):
    """Feedback by failure type as stored, with success rates; repeated rows count once."""
    f = table(spark, sf, "feedback_logs").dropDuplicates(["id"])
    return f.groupBy(F.coalesce("failure_type", F.lit("NONE")).alias("failure_type")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"), F.countDistinct("query").alias("queries"))


FEEDBACK_FAILURES = "WITH f AS (SELECT * FROM feedback_logs QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1) SELECT coalesce(failure_type, 'NONE') AS failure_type, count(*) AS n, round(avg(CAST(success AS DOUBLE)), 6) AS success_rate, count(DISTINCT query) AS queries FROM f GROUP BY 1"


def rolling_latency(spark, sf):
    return K.rolling_mean(log(spark, sf), "latency_ms", "user_id", ["ts", "event_id"]).select("event_id", "rolling")


ROLLING_LATENCY = f"WITH {LOG} SELECT event_id, round(avg(latency_ms) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 8) AS rolling FROM log"


def latest_latency(spark, sf):
    return K.latest_mean(log(spark, sf), "latency_ms", [F.col("ts").desc(), F.col("event_id").desc()])


LATEST_LATENCY = f"WITH {LOG} SELECT round(avg(latency_ms), 1) AS avg_latency, count(*) AS samples FROM (SELECT * FROM log ORDER BY ts DESC, event_id DESC LIMIT 100)"


def attempt_share(spark, sf):
    n = log(spark, sf).groupBy(F.least("attempts", F.lit(3)).cast("bigint").alias("attempt")).agg(F.count("*").alias("n"))
    return n.select("attempt", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


ATTEMPT_SHARE = f"WITH {LOG}, n AS (SELECT least(attempts, 3) AS attempt, count(*) AS n FROM log GROUP BY 1) SELECT attempt, n, round(n / sum(n) OVER (), 6) AS share FROM n"


def system_stats(spark, sf):
    r = table(spark, sf, "file_register").filter(~F.coalesce("is_deleted", F.lit(False)) & (F.col("status") == "ready"))
    d = r.agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("bigint").alias("chunks"))
    f = table(spark, sf, "feedback_logs").agg(F.count("*").alias("feedback"), F.round(F.avg(F.col("success").cast("double")) * 100, 1).alias("success_rate"))
    return d.crossJoin(f)  # two single rows


SYSTEM_STATS = "SELECT * FROM (SELECT count(*) AS documents, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks FROM file_register WHERE NOT coalesce(is_deleted, false) AND status = 'ready'), (SELECT count(*) AS feedback, round(avg(CAST(success AS DOUBLE)) * 100, 1) AS success_rate FROM feedback_logs)"


def list_documents(spark, sf):
    """Active documents newest first, with the chunks they really have."""
    n = current_chunks(table(spark, sf, "chunks")).groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("chunks"))
    d = table(spark, sf, "file_register").filter(~F.coalesce("is_deleted", F.lit(False)))
    out = d.join(n, "id", "left").select("id", "filename", "status", F.when(F.col("status") == "ready", "indexed").otherwise("pending").alias("part"), F.coalesce("chunks", F.lit(0)).alias("chunks"), "upload_time")
    return out.orderBy(F.col("upload_time").desc_nulls_last(), "id").drop("upload_time")


LIST_DOCUMENTS = f"""WITH {POOL}, n AS (SELECT file_id AS id, count(*) AS chunks FROM pool GROUP BY 1)
SELECT id, filename, status, CASE WHEN status = 'ready' THEN 'indexed' ELSE 'pending' END AS part, coalesce(chunks, 0) AS chunks FROM file_register LEFT JOIN n USING (id) WHERE NOT coalesce(is_deleted, false)"""


def chunks_by_file(spark, sf):
    c = current_chunks(table(spark, sf, "chunks")).filter(F.col("text").rlike(r"[^ \t\r\n\f]"))
    return c.groupBy("file_id").agg(F.count("*").alias("n"), F.min("chunk_index").alias("first"), F.max("page").alias("pages"), F.min("filename").alias("filename")).withColumn("line", F.concat(F.lit("- "), F.coalesce("filename", F.lit("unknown")), F.lit(" ("), F.col("n").cast("string"), F.lit(" chunks)")))


CHUNKS_BY_FILE = f"WITH {POOL} SELECT file_id, count(*) AS n, min(chunk_index) AS first, max(page) AS pages, min(filename) AS filename, '- ' || coalesce(min(filename), 'unknown') || ' (' || count(*) || ' chunks)' AS line FROM pool WHERE regexp_matches(text, '[^ \\t\\r\\n\\f]') GROUP BY file_id"


def upsert_documents(spark, sf):
    """What the chunks say of their files, merged into the register: counts corrected, leases cleared, unknown files added."""
    c = current_chunks(table(spark, sf, "chunks"))
    seen = c.groupBy(F.col("file_id").alias("id")).agg(F.count("*").cast("int").alias("chunk_count"), F.bool_or(F.lower("filename").endswith(".pdf")).alias("ocr"))
    new = seen.withColumn("is_deleted", F.lit(False)).withColumn("status", F.lit("ready"))
    out = D.upsert(table(spark, sf, "file_register"), new, "id", sticky_or=("ocr",), clear=("ocr_worker", "ocr_heartbeat", "deleted_at"))
    return out.select("id", "filename", F.col("chunk_count").cast("bigint").alias("chunk_count"), "is_deleted", "status", "ocr", "ocr_worker", F.col("deleted_at").isNull().alias("live"))


UPSERT_DOCUMENTS = f"""WITH {POOL}, n AS (SELECT file_id AS id, count(*) AS chunk_count, bool_or(lower(filename) LIKE '%.pdf') AS ocr FROM pool WHERE file_id IS NOT NULL GROUP BY 1)
SELECT coalesce(n.id, o.id) AS id, filename, CASE WHEN n.id IS NOT NULL THEN n.chunk_count ELSE o.chunk_count END AS chunk_count, CASE WHEN n.id IS NOT NULL THEN false ELSE is_deleted END AS is_deleted, CASE WHEN n.id IS NOT NULL THEN 'ready' ELSE status END AS status,
 CASE WHEN n.id IS NOT NULL THEN coalesce(o.ocr, false) OR coalesce(n.ocr, false) ELSE o.ocr END AS ocr, CASE WHEN n.id IS NULL THEN ocr_worker END AS ocr_worker, CASE WHEN n.id IS NULL THEN deleted_at END IS NULL AS live FROM file_register o FULL JOIN n ON n.id = o.id"""


def insert_ignore(spark, sf):
    """Feedback delivered again is ignored: the table is what it was, each id once."""
    f = table(spark, sf, "feedback_logs").select("id", "query", "failure_type", "success")
    empty = f.limit(0)
    return D.insert_ignore(empty, f, "id").groupBy("failure_type").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"))


INSERT_IGNORE = "SELECT failure_type, count(*) AS n, count(*) FILTER (success) AS ok FROM (SELECT * FROM feedback_logs QUALIFY row_number() OVER (PARTITION BY id) = 1) GROUP BY 1"


def replace_document_chunks(spark, sf):
    """Files that the register calls scanned get their chunks anew (trimmed); the others' stay."""
    c = current_chunks(table(spark, sf, "chunks")).select("chunk_id", "file_id", "text")
    scanned = table(spark, sf, "file_register").filter("ocr").select(F.col("id").alias("file_id"))
    new = c.join(scanned, "file_id", "left_semi").select("chunk_id", "file_id", F.trim("text").alias("text"))
    return D.replace_children(c, new.select(*c.columns), "file_id").select("chunk_id", "file_id", F.md5("text").alias("digest"))


REPLACE_DOCUMENT_CHUNKS = f"WITH {POOL} SELECT chunk_id, file_id, md5(CASE WHEN file_id IN (SELECT id FROM file_register WHERE ocr) THEN trim(text, ' ') ELSE text END) AS digest FROM pool"


def soft_delete(spark, sf):
    """Failed files are marked deleted at the time of the latest upload; their chunks go."""
    r = table(spark, sf, "file_register")
    now = r.agg(F.max("upload_time").alias("t")).first()["t"]
    gone = r.filter(F.col("status") == "failed").select("id")
    out = D.soft_delete(r, gone, F.lit(now))
    return out.groupBy("status", F.col("is_deleted").alias("deleted")).agg(F.count("*").alias("n"), F.count_if(F.col("deleted_at") == F.lit(now)).alias("now"))


SOFT_DELETE = """WITH m AS (SELECT max(upload_time) AS t FROM file_register), d AS (SELECT status, coalesce(is_deleted, false) OR status = 'failed' AS deleted, CASE WHEN status = 'failed' AND NOT coalesce(is_deleted, false) THEN t ELSE deleted_at END AS deleted_at, t FROM file_register, m)
SELECT status, deleted, count(*) AS n, count(*) FILTER (deleted_at = t) AS now FROM d GROUP BY 1, 2"""


def delete_chunks(spark, sf):
    """Chunks of deleted files removed: how many per file."""
    c = current_chunks(table(spark, sf, "chunks")).select("chunk_id", "file_id")
    bad = table(spark, sf, "file_register").filter("is_deleted OR status <> 'ready'").select(F.col("id").alias("file_id"))
    left = c.join(bad, "file_id", "left_anti").groupBy("file_id").agg(F.count("*").alias("kept"))
    return left.join(c.groupBy("file_id").agg(F.count("*").alias("had")), "file_id", "right").select("file_id", "had", (F.col("had") - F.coalesce("kept", F.lit(0))).alias("removed"))


DELETE_CHUNKS = f"WITH {POOL}, bad AS (SELECT id FROM file_register WHERE is_deleted OR status <> 'ready') SELECT file_id, count(*) AS had, count(*) FILTER (file_id IN (SELECT id FROM bad)) AS removed FROM pool GROUP BY 1"


def status_update(spark, sf):
    """Files still processing that have chunks become ready and lose their lease."""
    have = current_chunks(table(spark, sf, "chunks")).select(F.col("file_id").alias("id")).distinct().withColumn("has", F.lit(True))
    r = table(spark, sf, "file_register").join(have, "id", "left")
    return D.set_status(r, (F.col("status") == "processing") | F.coalesce("has", F.lit(False)), "ready", "indexed").select("id", "status", "status_message", "ocr_worker")


STATUS_UPDATE = f"""WITH {POOL}, u AS (SELECT *, (status = 'processing' OR id IN (SELECT file_id FROM pool WHERE file_id IS NOT NULL)) AND NOT coalesce(is_deleted, false) AS hit FROM file_register)
SELECT id, CASE WHEN coalesce(hit, false) THEN 'ready' ELSE status END AS status, CASE WHEN coalesce(hit, false) THEN 'indexed' ELSE status_message END AS status_message, CASE WHEN NOT coalesce(hit, false) THEN ocr_worker END AS ocr_worker FROM u"""


def stray_documents(spark, sf):
    """Chunks without a registered file, and ready files without chunks."""
    c = current_chunks(table(spark, sf, "chunks")).select(F.col("file_id").alias("id")).distinct()
    r = table(spark, sf, "file_register")
    a = c.join(r.select("id"), "id", "left_anti").select("id", F.lit("unregistered").alias("kind"))
    b = r.filter("status = 'ready' AND NOT coalesce(is_deleted, false)").join(c, "id", "left_anti").select("id", F.lit("empty").alias("kind"))
    return a.unionByName(b)


STRAY_DOCUMENTS = f"WITH {POOL}, c AS (SELECT DISTINCT file_id AS id FROM pool) SELECT id, 'unregistered' AS kind FROM c ANTI JOIN file_register USING (id) UNION ALL SELECT id, 'empty' FROM file_register ANTI JOIN c USING (id) WHERE status = 'ready' AND NOT coalesce(is_deleted, false)"


def adopt_pending(spark, sf):
    """Pending files as the register has them against those a worker holds."""
    r = table(spark, sf, "file_register").select("id", "status", "filename")
    local = table(spark, sf, "file_register").filter("ocr_worker IS NOT NULL").select("id", F.lit("processing").alias("status"), F.col("ocr_worker").alias("filename"))
    return D.adopt(local, r.filter("status <> 'ready'"))


ADOPT_PENDING = """WITH l AS (SELECT id, 'processing' AS status, ocr_worker AS filename FROM file_register WHERE ocr_worker IS NOT NULL), r AS (SELECT id, status, filename FROM file_register WHERE status <> 'ready'),
j AS (SELECT l.id AS lid, l.status AS ls, l.filename AS lf, r.*, coalesce(l.id IS NOT NULL AND (r.id IS NULL OR l.status = r.status), false) AS keep FROM l FULL JOIN r ON l.id = r.id)
SELECT CASE WHEN keep THEN lid ELSE id END AS id, CASE WHEN keep THEN ls ELSE status END AS status, CASE WHEN keep THEN lf ELSE filename END AS filename, CASE WHEN keep THEN 'local' ELSE 'remote' END AS origin FROM j"""


def duplicate_uploads(spark, sf):
    """Documents whose text came before: the first upload of a hash is kept, the others name it."""
    w = Window.partitionBy("content_hash").orderBy(F.col("upload_time").asc_nulls_last(), "doc_id")
    d = table(spark, sf, "documents").filter("content_hash IS NOT NULL").select("doc_id", F.first("doc_id").over(w).alias("kept"))
    return d.filter("doc_id <> kept")


DUPLICATE_UPLOADS = "SELECT doc_id, kept FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY content_hash ORDER BY upload_time ASC NULLS LAST, doc_id) AS kept FROM documents WHERE content_hash IS NOT NULL) WHERE doc_id <> kept"


def hash_audit(spark, sf):
    """Chunk hashes against their texts: good, in upper case, missing or stale."""
    c = table(spark, sf, "chunks").groupBy("chunk_id").agg(F.min("text").alias("text"), F.min("content_hash").alias("h"))
    true = F.sha2("text", 256)
    kind = F.when(F.col("h").isNull(), "missing").when(F.col("h") == true, "good").when(F.lower("h") == true, "upper").otherwise("stale")
    return c.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


HASH_AUDIT = "WITH c AS (SELECT chunk_id, min(text) AS text, min(content_hash) AS h FROM chunks GROUP BY 1) SELECT CASE WHEN h IS NULL THEN 'missing' WHEN h = sha256(text) THEN 'good' WHEN lower(h) = sha256(text) THEN 'upper' ELSE 'stale' END AS kind, count(*) AS n FROM c GROUP BY 1"


def embedding_cache(spark, sf):
    """Texts whose vector another chunk already has (hits), and those to embed (misses), by hash of the text."""
    c = table(spark, sf, "chunks").groupBy("chunk_id").agg(F.min("text").alias("text"), F.bool_or(F.col("embedding").isNotNull()).alias("has"))
    h = c.filter("text IS NOT NULL").withColumn("key", F.sha2("text", 256))
    known = h.groupBy("key").agg(F.bool_or("has").alias("cached"))
    return h.filter("NOT has").join(known, "key").groupBy("cached").agg(F.count("*").alias("n"))


EMBEDDING_CACHE = "WITH c AS (SELECT chunk_id, sha256(min(text)) AS key, bool_or(embedding IS NOT NULL) AS has FROM chunks GROUP BY 1 HAVING min(text) IS NOT NULL), k AS (SELECT key, bool_or(has) AS cached FROM c GROUP BY 1) SELECT cached, count(*) AS n FROM c JOIN k USING (key) WHERE NOT has GROUP BY 1"


def store_limit(spark, sf):
    """Files in order of name, loaded until the store's limit of chunks would be passed."""
    r = table(spark, sf, "file_register").filter("filename IS NOT NULL").select("id", "filename", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    return D.running_limit(r, "filename", "chunk_count", 1000).select("id", F.col("before").cast("bigint").alias("before"), "fits")


STORE_LIMIT = "SELECT id, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS before, coalesce(sum(n) OVER w, 0) + n <= 1000 AS fits FROM (SELECT id, filename, coalesce(chunk_count, 0) AS n FROM file_register WHERE filename IS NOT NULL) WINDOW w AS (ORDER BY filename, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def evenly_spaced_sample(spark, sf):
    c = current_chunks(table(spark, sf, "chunks")).filter("file_id IS NOT NULL")
    by_type = c.withColumn("kind", F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1)))
    return D.evenly_spaced(by_type, "kind", ["file_id", F.coalesce("chunk_index", F.lit(-1)), "chunk_id"]).select("kind", "chunk_id", "slot")


EVENLY_SPACED_SAMPLE = f"""WITH {POOL}, k AS (SELECT *, lower(regexp_extract(filename, '\\.([^.]*)$', 1)) AS kind FROM pool WHERE file_id IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY file_id, coalesce(chunk_index, -1), chunk_id) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n, greatest(1, 30 // (SELECT count(*) FROM (SELECT DISTINCT kind FROM k))) AS k FROM k),
p AS (SELECT kind, chunk_id, CASE WHEN n <= k THEN i ELSE slot END AS slot FROM s, range(30) r(slot) WHERE CASE WHEN n <= k THEN slot = 0 ELSE slot < k AND i = slot * n // k END)
SELECT kind, chunk_id, CAST(slot AS BIGINT) AS slot FROM p ORDER BY slot, kind NULLS FIRST LIMIT 30"""


def lease_takeover(spark, sf):
    r = table(spark, sf, "file_register")
    now = r.agg(F.max(F.col("ocr_heartbeat").cast("double")).alias("t")).first()["t"] or 0.0
    return D.claimable(r, "worker-1", F.lit(now), 3600).select("id", "ocr_worker")


LEASE_TAKEOVER = """SELECT id, ocr_worker FROM file_register WHERE status = 'processing' AND NOT coalesce(is_deleted, false) AND (ocr_worker IS NULL OR ocr_worker = 'worker-1' OR ocr_heartbeat IS NULL OR epoch(ocr_heartbeat) < (SELECT coalesce(max(epoch(ocr_heartbeat)), 0) FROM file_register) - 3600)"""


def rate_limit(spark, sf):
    return K.rate_limited(table(spark, sf, "events"), "user_id", "ts", 1).select("user_id", "window_start", "n")


RATE_LIMIT = "SELECT user_id, date_trunc('minute', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1"


def suggestion_key(spark, sf):
    return D.fingerprint(table(spark, sf, "file_register"), "id")


SUGGESTION_KEY = """WITH b AS (SELECT md5(id)[1:2] AS b, sha256(string_agg(id, ',' ORDER BY id)) AS d FROM (SELECT DISTINCT id FROM file_register) GROUP BY 1) SELECT sha256(string_agg(b || ':' || d, ',' ORDER BY b || ':' || d)) AS fingerprint FROM b"""


# ---- extensions: what the star schema and the event stream allow beyond document search
def ext_pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_shipdate <= timestamp'1998-09-02'")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))


EXT_PRICING_SUMMARY = "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"


def ext_region_revenue(spark, sf):
    c, o, li = table(spark, sf, "customer"), table(spark, sf, "orders"), table(spark, sf, "lineitem")
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    j = li.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev")).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n.select("n_nationkey", "n_name", "r_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum("rev"), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


EXT_REGION_REVENUE = "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"


def ext_cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


EXT_CUBE = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"


def ext_user_sessions(spark, sf):
    """Sessions of a user: events no more than 30 minutes apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce((F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(w).cast("timestamp").cast("double")) > 1800, F.lit(True))
    s = table(spark, sf, "events").withColumn("new", gap.cast("int")).withColumn("session", F.sum("new").over(w).cast("bigint"))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


EXT_USER_SESSIONS = "WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 1800 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS n, round(sum(value), 2) AS value FROM s GROUP BY 1, 2"


def ext_hourly_rollup(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"), F.countDistinct("user_id").alias("users"))


EXT_HOURLY_ROLLUP = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 8) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2"


def load_report(spark, sf):
    """The register's files as a bulk load: unfinished ones failed, those whose hash a removed file has are known."""
    r = table(spark, sf, "file_register")
    live = r.filter("NOT coalesce(is_deleted, false)").select("id", F.coalesce("filename", "id").alias("name"), "content_hash", F.coalesce("chunk_count", F.lit(0)).cast("bigint").alias("chunk_count"), F.col("status").isin("failed", "processing").alias("failed"))
    return D.load_report(live, r.filter("is_deleted"), 900).select("id", "outcome")


LOAD_REPORT = """WITH f AS (SELECT id, coalesce(filename, id) AS name, content_hash, coalesce(chunk_count, 0) AS n, status IN ('failed', 'processing') AS failed FROM file_register WHERE NOT coalesce(is_deleted, false)),
g AS (SELECT *, coalesce(failed, false) AS bad, content_hash IS NOT NULL AND (content_hash IN (SELECT content_hash FROM file_register WHERE is_deleted AND content_hash IS NOT NULL) OR row_number() OVER (PARTITION BY content_hash ORDER BY name, id) > 1) AS skip FROM f),
h AS (SELECT *, sum(CASE WHEN bad OR skip THEN 0 ELSE n END) OVER (ORDER BY name, id) > 900 AS over FROM g)
SELECT id, CASE WHEN bad THEN 'failed' WHEN skip THEN 'skipped' WHEN max(over) OVER (ORDER BY name, id ROWS UNBOUNDED PRECEDING) THEN 'stopped' ELSE 'loaded' END AS outcome FROM h"""


def queries():
    fs = (pipeline_counters, failure_histogram, healing_histogram, feedback_failures, rolling_latency, latest_latency, attempt_share, system_stats, list_documents, chunks_by_file, upsert_documents, insert_ignore, replace_document_chunks,
          soft_delete, delete_chunks, status_update, stray_documents, adopt_pending, duplicate_uploads, hash_audit, embedding_cache, store_limit, load_report, evenly_spaced_sample, lease_takeover, rate_limit, suggestion_key,
          ext_pricing_summary, ext_region_revenue, ext_cube, ext_user_sessions, ext_hourly_rollup)
    return {f.__name__: f for f in fs}


def oracle_sql():
    g = globals()
    return {n: g[n.upper()] for n in queries() if n.upper() in g}
