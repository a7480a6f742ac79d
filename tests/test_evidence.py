from pyspark.sql import functions as F

from quern.operators import evidence as E
from quern.plans import queries_evidence as Q


def test_rows_of_detections(spark, sf):
    got = {r["page_id"]: tuple(r)[1:] for r in Q.ocr_lines(spark, sf).collect()}
    assert got == {1: ("hello world\nnext", 2, 1), 2: ("", 0, 0), 3: ("ok", 1, 1), 4: ("", 0, 0)}


def test_citation_tags(spark, sf):
    got = {(r["id"], r["cited_file"], r["cited_page"]) for r in Q.citation_rows(spark, sf).collect()}
    assert got == {(1, "plan.docx", 2), (1, "b.pdf", 10), (1, "c d.pdf", None), (4, "plan.docx", 1), (4, "b.pdf", 3), (5, "lone.md", None)}
    df = spark.createDataFrame([("It is so [Sou",), ("done [1]",), ("x [Source: a.pd",), ("y [other",)], "a string")
    assert [r[0] for r in df.select(E.drop_open_tag(F.col("a"))).collect()] == ["It is so", "done [1]", "x", "y [other"]


def test_highlight_marks_runs_and_telling_words(spark):
    text = "The renewal date of the contract is 3 May 2026 at ICICI."
    rows = [(text, "It renews on 3 May 2026 with ICICI, the bank"), ("the of and", "the of and"), ("", "x"), (None, None), ("used documents", "documents used")]
    got = [[t[s["start"] : s["end"]] for s in spans] for t, _, spans in E.highlight(spark.createDataFrame(rows, "t string, a string"), "t", "a").collect()]
    assert got == [["3 May 2026", "ICICI"], [], [], [], ["used documents"]]


def test_source_lines_are_folded(spark):
    rows = [("Claim.\n- [Source: a.pdf]\n* [Source: b.pdf]\n\nNext",), ("Claim *Source:* a.pdf, Page 1 [Source: a.pdf | Page 1]",), ("[Source: a.pdf]\nx",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string").select(E.fold_source_lines(F.col("a"))).collect()]
    assert got == ["Claim. [Source: a.pdf] [Source: b.pdf]\n\nNext", "Claim [Source: a.pdf | Page 1]", "[Source: a.pdf]\nx", None]


def test_jobs_and_keys(spark, sf):
    assert {r["job"]: r["state"] for r in Q.background_jobs(spark, sf).collect()} == {1: "ready", 2: "cancelled", 3: "processing", 4: "unknown"}
    assert {(r["pool"], r["key"], r["free"]) for r in Q.key_choice(spark, sf).collect()} == {("p", "b", True), ("q", "e", False)}


def test_lru_and_tiers(spark):
    e = spark.createDataFrame([("c", "a", 1), ("c", "b", 2), ("c", "a", 3), ("c", "d", 4)], "cache string, key string, used int")
    assert {r["key"] for r in E.lru_keep(e, 2).collect()} == {"a", "d"}
    df = spark.createDataFrame([(None,), ("none",), ("x-8b",), ("big",)], "m string")
    assert [r[0] for r in df.select(E.model_tier(F.col("m"))).collect()] == ["none", "none", "fast", "strong"]
