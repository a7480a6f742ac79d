"""Readers of document formats into pages (file_id, page, part, text), and the sinks and sources of the operation logs.

Text, Markdown, CSV and HTML are read here. PDF, DOCX and scanned images need libraries that may be absent:
a parser for them is a plug-in (see plugins.py) that turns a file's bytes into pages.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..session import materialise

EXTENSIONS = {".txt": "text", ".md": "text", ".csv": "csv", ".html": "html", ".htm": "html", ".pdf": "pdf", ".docx": "docx"}
MAX_BYTES = 50 * 1024 * 1024


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(filename, ext, bytes, length, hash): the files of one folder that are supported and not too large."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = raw.select(name.alias("filename"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"), F.col("content").alias("bytes"), "length")
    return rows.filter(F.col("ext").isin(*EXTENSIONS) & (F.col("length") <= MAX_BYTES)).withColumn("hash", F.md5("bytes"))


def read_documents(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], list[tuple[int, str]]]] | None = None, most_bytes: int | None = MAX_BYTES, most_chars: int | None = 2_000_000) -> DataFrame:
    """(filename, page, part, text, error): pages of all files of one folder, sorted out by their lower-cased extension.

    Text and Markdown are one page, CSV one line a row, HTML its visible text; for other formats a parser (bytes -> [(page, text)],
    parts of a page in order) must be given by extension. A file that isn't read comes out as one row with its error: `unknown_type`,
    `no_parser`, `too_large`, `parser_failed` or `empty`. Files of no bytes at all
    are passed over by the reader and give no row.
    """
    known = dict(parsers or {})
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = raw.select(name.alias("filename"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"), "length", (F.when(F.col("length") <= most_bytes, F.col("content")) if most_bytes else F.col("content")).alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for filename, ext, _, data in zip(*(c.to_pylist() for c in b.columns)):
                pages, error = [], None
                if ext in known:
                    try:
                        pages = known[ext](data) if data is not None else []
                    except Exception:  # a broken file must not end the job
                        error = "parser_failed"
                elif ext not in EXTENSIONS:
                    error = "unknown_type"
                elif EXTENSIONS[ext] not in ("text", "csv", "html"):
                    error = "no_parser"
                elif data is not None:
                    text = data.decode("utf-8", "ignore")
                    pages = [(1, {"text": str, "csv": csv_text, "html": visible_text}[EXTENSIONS[ext]](text))]
                if data is None and error is None:
                    error = "too_large"
                if not pages:
                    out.append((filename, None, None, None, error or "empty"))
                seen: dict[int, int] = {}
                for page, text in pages:
                    out.append((filename, page, seen.get(page, 0), text, None))
                    seen[page] = seen.get(page, 0) + 1
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["filename", "page", "part", "text", "error"])

    pages = rows.mapInArrow(run, "filename string, page int, part int, text string, error string")
    return pages.withColumn("text", clean_text(F.col("text"), most_chars))


def csv_text(text: str) -> str:
    """Lines "col=value, col=value" of a CSV text: blank header cells drop out, blank values stay."""
    rows = list(csv.reader(io.StringIO(text)))
    header = [h.strip() for h in rows[0]] if rows else []
    return "\n".join(", ".join(f"{h}={v.strip()}" for h, v in zip(header, r) if h) for r in rows[1:] if r)


def text_pages(rows: DataFrame) -> DataFrame:
    """Text and Markdown: one page; undecodable bytes are dropped."""
    text = F.regexp_replace(F.make_valid_utf8(F.col("bytes").cast("string")), "�", "")
    return rows.select("filename", F.lit(1).alias("page"), F.lit(0).alias("part"), clean_text(text).alias("text"))


def render_row(header: list[str], values: list[Column]) -> Column:
    """"col=value, col=value" of a CSV row: blank header cells drop out, blank values stay."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{h.strip()}="), F.trim(F.coalesce(v, F.lit("")))) for h, v in zip(header, values) if h.strip()])


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): every data row of CSV files that share a header."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.select(render_row(df.columns, [F.col(f"`{c}`") for c in df.columns]).alias("line"))


def render_table(rows: list[list[str | None]]) -> list[str]:
    """Lines of an extracted table: rows without a filled cell drop out, empty cells and blank headers are skipped."""
    kept = [r for r in rows if any(c and c.strip() for c in r)]
    if len(kept) < 2:
        return []
    header = [(c or "").strip() for c in kept[0]]
    return [line for r in kept[1:] if (line := ", ".join(f"{h}={c.strip()}" for h, c in zip(header, r) if h and c and c.strip()))]


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def visible_text(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Visible()
    p.feed(html)
    p.close()
    return "\n".join(p.parts)


def html_text(rows: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text): text nodes outside script and style, one a line, entities decoded, cleaned."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([visible_text(x) for x in b.column(1).to_pylist()], pa.string())], names=["key", "raw"])

    out = rows.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(run, f"key {kind}, raw string")
    return out.select(F.col("key").alias(key), clean_text(F.col("raw")).alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def take_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read_jsonl, after which the log is empty: the rows are kept in the shared checkpoint folder before their files go."""
    files = spark.read.schema("value string").text(path).inputFiles()
    rows = materialise(read_jsonl(spark, path, schema))
    for f in files:  # what was appended meanwhile stays
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)
    return rows


def append_jsonl(df: DataFrame, path: str, sample: float | None = None, seed: int | None = None) -> None:
    """Appends rows as JSON lines; a log may keep a sample only (a feature of the sink)."""
    (df if sample is None else df.sample(sample, seed)).write.mode("append").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def refresh_plan(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents and whether their raw file is there to be parsed anew: (id, filename, action)."""
    names = stored.select(F.regexp_replace("filename", r"\.[^.]*$", "").alias("id")).distinct().withColumn("there", F.lit(True))
    return documents.join(names, "id", "left").select("id", "filename", F.when(F.col("there"), "refresh").otherwise("skipped").alias("action"))

