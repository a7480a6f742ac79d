"""A third of all rows under one key, in one group of copies, or in one bucket; and columns whose names clash."""

import os

import numpy as np
import pytest

from quern.llm import encode, knn, mix, neardup, scans, spam, split

needs_vocabulary = pytest.mark.skipif(not os.path.exists(encode.vocabulary_path()), reason="no vocabulary file")


def test_hot_vector_gets_its_smallest_copies(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 64))
    rows = [(f"v{i:03d}", v.tolist(), "a", 1.0) for i, v in enumerate(x)] + [(f"hot{i:03d}", (x[7] * (1 + i % 5)).tolist(), "a", 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<double>, class string, away double")
    got = {}
    for q in knn.neighbours(df, shard=60).orderBy("rank").collect():
        got.setdefault(q["chunk_id"], []).append(q["neighbour"])
    assert got["hot050"] == [f"hot{i:03d}" for i in range(10)] and got["hot003"] == [f"hot{i:03d}" for i in range(11) if i != 3]
    assert got["v007"] == [f"hot{i:03d}" for i in range(10)] and all(len(v) == 10 for v in got.values()) and len(got) == 300


def test_near_copies_of_one_text(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(f"n{i:02d}", " ".join([*base[: 58 - i % 3], f"x{i}"]), 0) for i in range(30)] + [(f"o{i:02d}", " ".join(f"y{i}z{j}" for j in range(40)), 0) for i in range(60)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, key int")
    links, members = neardup.links_and_members(df)
    assert neardup.pairs_of_keys(links, members).count() == 30 * 29 // 2
    groups = neardup.near_duplicate_groups(df).groupBy("group").count().collect()
    assert sorted(g["count"] for g in groups) == [1] * 60 + [30]


def test_hot_file_keeps_its_furniture_rule(spark):
    rows = [(f"h{i:03d}", "HOT", f"ACME Guide\nUnique sentence number {chr(97 + i % 26) * (2 + i // 26)} stands here.\n- {i} -", {"page": i}) for i in range(60)]
    rows += [(f"c{i}", f"F{i}", "Some clean words stand here.", {"page": 1}) for i in range(120)]
    chunks = spark.createDataFrame([(*r, "x", 1) for r in rows], "chunk_id string, file_id string, text string, metadata struct<page:int>, file string, scanned int")
    register = spark.createDataFrame([("HOT", "pdf"), *[(f"F{i}", "md") for i in range(120)]], "id string, file_type string")
    found = scans.faults(chunks, register).collect()
    assert {(r["chunk_id"], r["line_no"]) for r in found if r["fault"] == "running_line"} == {(f"h{i:03d}", n) for i in range(60) for n in (0, 2)}


@needs_vocabulary
def test_hot_source_of_equal_lengths(spark):
    docs = [(i, "same few words here", "hot", 1) for i in range(600)] + [(1000 + i, "other " * (3 + i % 7), "cold", 1) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, length int")
    t = spark.createDataFrame([("hot", 1.0, 1), ("cold", 3.0, 2)], "source string, target_weight double, max_repeats int")
    used, report = mix.mixture(d, t, encode.vocabulary_path())
    rows = {r["source"]: r for r in report.collect()}
    assert abs(rows["hot"]["actual_share"] - 0.25) < 0.005 and rows["cold"]["most_repeats"] <= 2
    assert used.filter("source = 'hot'").agg({"repeats": "max"}).first()[0] == 1


def test_copies_of_pages_and_texts(spark):
    bad = "\n".join(f"buy tool {chr(97 + i)}" for i in range(12))
    df = spark.createDataFrame([(i, bad if i % 3 == 0 else "It was agreed to move the office to another town.", False) for i in range(90)], "doc_id bigint, text string, n_lines boolean")
    assert {r["doc_id"] for r in spam.spam_pages(df).filter("is_spam").collect()} == set(range(0, 90, 3))
    long = spark.createDataFrame([(f"k{i}", "A sentence of some words. " * 100, 0) for i in range(30)], "chunk_id string, text string, start_at int")
    assert split.split_texts(long).groupBy("chunk_id").count().select("count").distinct().count() == 1
