"""Scanned rows, citations, highlights and suggestions: small per-row algorithms, in Arrow batches where built-ins can't."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that say nothing about a topic, for highlights; next questions leave out five more.
COMMON = (
    "the a an and or of to in on for is are was were be been by with as at from that this these those it its into than then there their they them which who whom what when where how why not no but if so such can could should "
    "would will may might must do does did has have had also each any all more most other some only same very just about over under source page document"
).split()
COMMON_TOPICS = [*COMMON, "your", "you", "used", "use", "using", "documents"]
#: A citation, its file and page, one that is still open at the end, and one written out before it.
TAG = r"(?i)[\[【]\s*Source:([^\]】]*)[\]】]"
TAG_PART = r"(?i)^(.*?)(?:\s*[,|]\s*(?:page|pages|p\.|pp\.)\s*(\d+).*)?$"
OPEN_TAIL = r"[ \t]*[\[【]\s*([A-Za-z]{0,6}:?[^\]】]{0,200})$"
LEAD_IN = r"(?i)(?<![\[【]\s{0,3})(?:\*\*|\*|_)?Sources?:(?:\*\*|\*|_)?[^\n\[【]*?(?=[\[【]\s*Source:)"
#: A word of a passage, and what may stand between two words of one run.
WORD = r"[\p{L}\p{N}](?:[\p{L}\p{N}@._'-]*[\p{L}\p{N}])?"
RUN_GAP = r"^[\s,:;·-]*$"


def assemble_rows(boxes: list[dict], least: float = 0.0) -> list[str]:
    """Text lines of detections {x, y, h, text, score}: sorted by centre height, a box joins the row of the first box it lies beside."""
    good = [b for b in boxes if b.get("text") and b["text"].strip() and (b.get("score") is None or b["score"] >= least) and None not in (b.get("x"), b.get("y"), b.get("h"))]
    rows: list[list[dict]] = []
    for b in sorted(good, key=lambda b: (b["y"], b["x"])):
        if rows and abs(b["y"] - rows[-1][0]["y"]) <= 0.5 * max(b["h"], rows[-1][0]["h"]):
            rows[-1].append(b)
        else:
            rows.append([b])
    return [" ".join(b["text"].strip() for b in sorted(r, key=lambda b: b["x"])) for r in rows]


def ocr_pages(pages: DataFrame, key: str = "page_id", boxes: str = "boxes", least: float = 0.0) -> DataFrame:
    """(key, text, n_lines, dropped): the lines of each page's detections; dropped counts those without text or below the score."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or [] for x in b.column(1).to_pylist()]
            lines = [assemble_rows(x, least) for x in raw]
            used = [sum(1 for d in x if d.get("text") and d["text"].strip() and (d.get("score") is None or d["score"] >= least)) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["\n".join(x) for x in lines]), pa.array([len(x) for x in lines], pa.int64()), pa.array([len(x) - u for x, u in zip(raw, used)], pa.int64())], names=["key", "text", "n_lines", "dropped"])

    return pages.select(F.col(key).alias("key"), boxes).mapInArrow(run, f"key {kind}, text string, n_lines bigint, dropped bigint").withColumnRenamed("key", key)


def parse_tag(inner: Column) -> Column:
    """[{file, page}] of "a.pdf, page 1; b.docx | Page 2"."""
    name = lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"[‐-―−]", "-"), r"\s+", " ")))
    one = lambda p: F.struct(name(F.regexp_replace(F.regexp_extract(p, TAG_PART, 1), r"^\s*[\"']|[\"']\s*$", "")).alias("file"), F.regexp_extract(p, TAG_PART, 2).try_cast("bigint").alias("page"))
    return F.filter(F.transform(F.split(inner, ";"), one), lambda x: x["file"] != "")


def citations(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """One row a cited source: the columns of answers, and file and page."""
    tags = F.regexp_extract_all(F.col(answer), F.lit(TAG), F.lit(1))
    return answers.withColumn("c", F.explode(F.flatten(F.transform(tags, parse_tag)))).select(*answers.columns, F.col("c.file").alias("cited_file"), F.col("c.page").alias("cited_page"))


def drop_open_tag(c: Column) -> Column:
    """Without a citation that is still being written at the end."""
    tail = F.lower(F.regexp_extract(c, OPEN_TAIL, 1))
    open_ = c.rlike(OPEN_TAIL) & (F.lit("source:").startswith(tail) | tail.startswith("source:"))
    return F.when(open_, F.regexp_replace(c, OPEN_TAIL, "")).otherwise(c)


def fold_source_lines(c: Column) -> Column:
    """A source written out before its tag goes, and lines of tags alone move to the end of the last line with text."""
    alone = r"(?i)^\s*(?:[-*+]|\d+[.)])?\s*((?:[ \t]*[\[【]\s*Source:[^\]】]*[\]】])+)\s*$"
    # Text up to the last line that isn't blank, and the blank lines after it; answers are short, so copying them is cheap.
    zero = F.struct(F.lit("").alias("text"), F.lit("").alias("blank"), F.lit(False).alias("some"))

    def add(s: Column, line: Column) -> Column:
        tags, empty = line.rlike(alone) & s["some"], F.trim(line) == ""
        more = F.when(tags, F.concat(F.regexp_replace(s["text"], r"\s+$", ""), F.lit(" "), F.trim(F.regexp_extract(line, alone, 1)))).when(empty, s["text"]).otherwise(F.concat(s["text"], s["blank"], line, F.lit("\n")))
        more = F.when(tags, F.concat(more, F.lit("\n"))).otherwise(more)
        return F.struct(more.alias("text"), F.when(empty, F.concat(s["blank"], line, F.lit("\n"))).when(tags, s["blank"]).otherwise("").alias("blank"), (s["some"] | ~empty).alias("some"))

    whole = F.aggregate(F.split(F.regexp_replace(c, LEAD_IN, ""), "\n"), zero, add, lambda s: F.concat(s["text"], s["blank"]))
    return F.substring(whole, F.lit(1), F.char_length(whole) - 1)


def _letters(words: Column, gaps: Column, said: Column) -> Column:
    """A letter for each word of a passage: T telling, C counting, S common, o not in the answer; "|" before one that
    something other than signs parts from the word ahead of it."""
    plain = lambda w: F.regexp_replace(F.lower(w), "[.,]", "")

    def letter(raw: Column, i: Column) -> Column:
        w = plain(raw)
        counts = ~w.isin(*COMMON)
        telling = w.rlike(r"\d") & (F.char_length(w) >= 2) | (F.char_length(w) >= 6) & counts | raw.rlike("^[A-Z]{3,}$")
        code = F.when(~F.array_contains(said, w), "o").when(telling, "T").when(counts, "C").otherwise("S")
        return F.concat(F.when(F.get(gaps, i).rlike(RUN_GAP), "").otherwise("|"), code)

    return F.array_join(F.transform(words, letter), "")


def highlight(rows: DataFrame, text: str, answer: str) -> DataFrame:
    """rows with `spans` ARRAY<STRUCT<start, end>> of the text that the answer repeats: runs of shared words by a pattern
    over one letter a word; offsets from the lengths of words and gaps."""
    every = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0))
    said = F.array_distinct(F.transform(every(F.col(answer)), lambda w: F.regexp_replace(F.lower(w), "[.,]", "")))
    out = rows.withColumn("_w", every(F.col(text))).withColumn("_g", F.split(F.coalesce(F.col(text), F.lit("")), WORD)).withColumn("_c", _letters(F.col("_w"), F.col("_g"), said))
    # Words before a run, words in it, for every run of shared words; "|" parts runs and stands for no word.
    pieces = F.regexp_extract_all("_c", F.lit(r"[TCS]+|[o|]+"), F.lit(0))

    def spans(words, gaps, pieces):
        import numpy as np
        import pandas as pd

        out = []
        for ws, gs, ps in zip(words, gaps, pieces):
            sizes = np.array([len(w) for w in ws], np.int64)
            starts = np.cumsum([len(g) for g in gs][: len(ws)]) + np.cumsum(sizes) - sizes if len(ws) else sizes
            n = np.array([len(p) - p.count("|") for p in ps], np.int64)
            first = np.cumsum(n) - n
            hit = [i for i, p in enumerate(ps) if "T" in p or "C" in p and len(p) > 1]  # a telling word, or two words of which one counts
            out.append([{"start": int(starts[first[i]]), "end": int(starts[first[i] + n[i] - 1] + sizes[first[i] + n[i] - 1])} for i in hit])
        return pd.Series(out)

    return out.withColumn("spans", F.pandas_udf(spans, "array<struct<start: int, end: int>>")("_w", "_g", pieces)).drop("_w", "_g", "_c")


def topic_words(c: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), lambda w: (F.char_length(w) > 2) & ~w.isin(*COMMON_TOPICS))


def next_questions(prompts: DataFrame, talk: DataFrame, n: int = 3, per_topic: int = 2) -> DataFrame:
    """Per session up to n prompts not asked yet, most words shared with the last exchange first, at most two a topic.

    prompts: (label, prompt, ord), a short list. talk: (session_id, asked ARRAY<STRING>, last STRING).
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    both = talk.crossJoin(F.broadcast(prompts))  # a fixed list of suggestions against each session
    left = both.filter(~F.exists("asked", lambda a: norm(a) == norm(F.col("prompt"))))
    scored = left.withColumn("score", F.size(F.array_intersect(topic_words(F.concat_ws(" ", "label", "prompt")), topic_words(F.col("last")))))
    order = [F.col("score").desc(), F.col("ord")]
    nth = scored.withColumn("nth", F.row_number().over(Window.partitionBy("session_id", "label").orderBy(*order))).filter(F.col("nth") <= per_topic)
    return nth.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(*order)).cast("bigint")).filter(F.col("place") <= n).select("session_id", "place", "label", "prompt", F.col("score").cast("bigint").alias("score"))


def model_tier(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isNull() | low.isin("", "none"), F.lit("none")).when(low.rlike("8b|mini|small|instant|20b"), F.lit("fast")).otherwise(F.lit("strong"))


def lru_keep(entries: DataFrame, capacity: int = 200, by: str = "cache") -> DataFrame:
    """Of each cache the most recently used entries; a key stored again counts by its last use."""
    last = entries.groupBy(by, "key").agg(F.max("used").alias("used"))
    return last.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(F.col("used").desc(), "key"))).filter(F.col("n") <= capacity).drop("n")


def pick_key(keys: DataFrame, now: Column) -> DataFrame:
    """Per pool the key to use: the least used one that isn't blocked, else the one that recovers first."""
    free = F.col("blocked_until").isNull() | (F.col("blocked_until") <= now)
    order = [free.desc(), F.when(free, F.col("uses")), F.when(~free, F.col("blocked_until")), F.col("key")]
    return keys.withColumn("free", free).withColumn("n", F.row_number().over(Window.partitionBy("pool").orderBy(*order))).filter("n = 1").select("pool", "key", "free")


def job_states(events: DataFrame) -> DataFrame:
    """(job, state): where each background job stands after its events (queued, started, page, done, failed, cancelled), in order.

    A cancelled or finished job ignores what comes later; a start after a failure resumes it.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "event"))), lambda e: e["event"])  # a job has few events
    closed = ("ready", "cancelled")

    def step(s: Column, e: Column) -> Column:
        return F.when(s.isin(*closed), s).when(e == "queued", F.lit("pending")).when(e.isin("started", "page"), F.lit("processing")).when(e == "done", F.lit("ready")).when(e == "failed", F.lit("failed")).when(e == "cancelled", F.lit("cancelled")).otherwise(s)

    return events.groupBy("job").agg(F.aggregate(ordered, F.lit("unknown"), step).alias("state"))
