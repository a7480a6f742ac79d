"""Pages into parents and chunks: logs by entry, tables by row, prose by paragraph and sentence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LOG_TOKENS, PARENT_TOKENS, CHILD_TOKENS, MOST_CHUNKS = 400, 1200, 200, 500
_STAMP = re.compile(T.TIMESTAMP)
_TRACE = re.compile(r"^\s+at\s+|^\s+File\s+\"|^\s+Traceback", re.I)
_ERROR = re.compile(r"\b(ERROR|EXCEPTION|CRITICAL|FATAL|WARN)\b", re.I)


def log_entries(text: str) -> list[str]:
    """Entries begin at a time stamp; a line with an error keeps what follows it together, the next entry included."""
    entries: list[list[str]] = []
    tracing = False
    for line in filter(str.strip, re.split(r"\r\n|\n|\r", text)):
        stamped = bool(_STAMP.search(line[:40]))
        if not entries or stamped and not tracing:
            entries.append([])
        if stamped:
            tracing = False
        entries[-1].append(line)
        if _ERROR.search(line):
            tracing = True
        elif tracing and not _TRACE.match(line):
            tracing = False
    return ["\n".join(e) for e in entries]


def split_logs(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, entries ARRAY<STRING>)."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([log_entries(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["key", "entries"])

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, entries array<string>").withColumnRenamed("key", key)


def chunk_pages(pages: DataFrame, most: int | None = MOST_CHUNKS) -> DataFrame:
    """pages: (file_id, page, text[, part]), a page may stand more than once, its parts in the order of `part` where there is one. (chunk_id, file_id, page, chunk_index, section, parent_id, text, content_hash).

    Parents are a relation of their own (join on parent_id), not copied into every chunk. Within a file equal
    texts stay once, the first `most` chunks stay (None: all).
    """
    nth = F.row_number().over(Window.partitionBy("file_id", "page").orderBy(*(["part"] if "part" in pages.columns else []), F.xxhash64("text"), "text")) - 1
    prefix = F.when(F.col("nth") == 0, F.lit("")).otherwise(F.concat(F.lit("_t"), F.col("nth").cast("string")))
    base = F.concat("file_id", F.lit("_p"), F.col("page").cast("string"), prefix)
    p = pages.withColumn("nth", nth).withColumn("base", base).withColumn("is_log", T.is_log(F.col("text"))).withColumn("is_table", T.is_table(F.col("text")))
    logs = p.filter("is_log")
    entries = split_logs(logs, "base").select("base", T.pack(F.col("entries"), LOG_TOKENS, "\n").alias("parts"))
    flat = logs.select("base", "file_id", "page").join(entries, "base").select("base", "file_id", "page", F.posexplode("parts").alias("chunk_index", "text"))
    flat = flat.select("file_id", "page", "base", "chunk_index", F.concat(F.lit("Page "), F.col("page").cast("string")).alias("section"), F.concat("base", F.lit("_c"), F.col("chunk_index").cast("string")).alias("parent_id"), "text")
    rest = p.filter("NOT is_log").withColumn("units", F.when(F.col("is_table"), F.transform(T.lines(F.col("text")), T.strip)).otherwise(T.paragraphs(F.col("text"))))
    parents = rest.select("file_id", "page", "base", "is_table", F.posexplode(T.pack(F.col("units"), PARENT_TOKENS, "\n")).alias("pi", "parent"))
    kids = parents.withColumn("units", F.when(F.col("is_table"), F.transform(T.lines(F.col("parent")), T.strip)).otherwise(T.sentences(F.col("parent"))))
    packed = kids.withColumn("parts", F.when(F.col("is_table"), T.pack(F.col("units"), CHILD_TOKENS, "\n")).otherwise(T.pack(F.col("units"), CHILD_TOKENS, " ")))
    kids = packed.select("file_id", "page", "base", "is_table", "pi", F.posexplode("parts").alias("ci", "text"))
    index = F.row_number().over(Window.partitionBy("base").orderBy("pi", "ci")) - 1
    section = F.concat(F.lit("Page "), F.col("page").cast("string"), F.when(F.col("is_table"), F.lit(" | Table")).otherwise(F.lit("")))
    prose = kids.select("file_id", "page", "base", index.alias("chunk_index"), section.alias("section"), F.concat("base", F.lit("_parent"), F.col("pi").cast("string")).alias("parent_id"), "text")
    every = flat.unionByName(prose).withColumn("chunk_id", F.concat("base", F.lit("_c"), F.col("chunk_index").cast("string"))).withColumn("content_hash", F.sha2("text", 256))
    order = ["page", "base", "chunk_index"]
    once = every.withColumn("n", F.row_number().over(Window.partitionBy("file_id", "content_hash").orderBy(*order))).filter("n = 1")
    kept = once if most is None else once.withColumn("n", F.row_number().over(Window.partitionBy("file_id").orderBy(*order))).filter(F.col("n") <= MOST_CHUNKS)
    return kept.select("chunk_id", "file_id", "page", "chunk_index", "section", "parent_id", "text", "content_hash")
