import os

import pytest

from quern.llm import encode, mix, pii, scans, spam

VOCABULARY = encode.vocabulary_path()
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
ODD = ["", " ", "\n\t ", "a", "aaaaaaaaaa", "Hello  world\r\n\n\n x", "é̀ ÄÖ ẞ ß ﬁ", "日本語の短い文です。", "🇪🇺🏳️‍🌈 😀", "<|endoftext|> is text", "'s don't I'LL we've", "1234567890" * 50, "x" * 30_000, "​  　", "\x00\x01"]


@needs_vocabulary
def test_encoding_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    e = encode.Encoder(VOCABULARY, table_words=40)
    for texts in (ODD, ODD[::-1], [None, *ODD]):
        ids, ends = e.encode(texts)
        for i, x in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids
        assert e.count(texts).tolist() == (ends[1:] - ends[:-1]).tolist()


@needs_vocabulary
def test_encoding_operator(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "low lower", 5), (3, "low lower", 5)], "doc_id bigint, text string, ids int")
    out = encode.encode_texts(df).collect()
    assert sorted((r["doc_id"], len(r["ids"])) for r in out) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert encode.encode_texts(df.limit(0)).count() == 0
    assert sorted(r["n_tokens"] for r in encode.count_tokens(df, carry=("ids",)).collect()) == [0, 0, 2, 2]


@needs_vocabulary
def test_corpus_replay_gives_the_same_ids(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "low lower lowest low"), (4, "lower " * 50 + "naïve 😀 x\n\n y")], "doc_id bigint, text string")
    want = {r["doc_id"]: r["ids"] for r in encode.encode_texts(df).collect()}
    assert {r["doc_id"]: r["ids"] for r in encode.encode_corpus(df.repartition(3)).collect()} == want
    assert encode.encode_corpus(df.limit(0)).count() == 0


def test_budgets_by_exact_lengths_however_many():
    import numpy as np

    lengths = np.arange(1, 50_001)
    stats = [{"source": s, "n_tokens": int(n), "n": 1} for s in ("a", "b") for n in lengths]
    plans, total = mix.plan_mixture(stats, [{"source": "a", "weight": 1.0, "repeats": 1}, {"source": "b", "weight": 3.0, "repeats": 1}])
    for p in plans:
        assert int((p["lengths"] * p["take"]).sum()) + p["passes"] * p["available"] == p["budget"]
    assert abs(plans[0]["budget"] / total - 0.25) < 1e-6


def test_knapsack_meets_the_budget_where_a_sum_does():
    import numpy as np

    lengths, counts = np.array([7, 11, 50]), np.array([9, 9, 9])
    for budget in (0, 7, 100, 305, 611, 612, 5000):
        take = mix.fit_counts(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert (take * lengths).sum() <= max(0, budget)
    assert (mix.fit_counts(np.array([3]), np.array([100_000]), 200_001, stretch=100) * 3).sum() == 200_001
    assert (mix.fit_counts(lengths, counts, 305) * lengths).sum() == 305


@needs_vocabulary
def test_mixture(spark):
    docs = [(i, "word " * (1 + i % 17), "Big_Source" if i % 3 else " big-source ", 0) for i in range(400)] + [(1000 + i, "small one text", "small", 0) for i in range(20)]
    docs += [(5000, None, "small", 0), (5001, "", "small", 0), (5002, "x", None, 0), (5003, "x", "unlisted", 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, n_tokens int")
    t = spark.createDataFrame([("big-source", 3.0, 1), ("small", 1.0, 4), ("absent", 1.0, 2), ("bad", None, 1)], "source string, target_weight double, max_repeats int")
    used, report = mix.mixture(d, t, VOCABULARY)
    rows = {r["source"]: r for r in report.collect()}
    assert set(rows) == {"big-source", "small", "absent"} and rows["absent"]["tokens"] == 0
    assert abs(rows["small"]["actual_share"] - 0.25) < 0.01 and rows["small"]["most_repeats"] <= 4 and rows["big-source"]["most_repeats"] <= 1
    assert abs(rows["small"]["target_share"] - 0.2) < 1e-9
    ids = [r["doc_id"] for r in used.collect()]
    assert len(ids) == len(set(ids)) and not {5000, 5001, 5002, 5003} & set(ids)
    assert sorted(ids) == sorted(r["doc_id"] for r in mix.mixture(d.repartition(7), t, VOCABULARY)[0].collect())
    assert mix.mixture(d.limit(0), t, VOCABULARY)[1].agg({"tokens": "sum"}).first()[0] == 0
    assert mix.mixture(d, t.limit(0), VOCABULARY)[0].count() == 0


SPAM = [
    "buy license | cheap license | license free | backup tool | license | license online | backup tool new | license best",
    "http://a.example/x http://b.example/y https://c.test/z\nhttp://d.example/x",
    "\n".join(f"cloud storage {x}" for x in "Aville Bville Cville Dville Eville Fville Gville Hville".split()),
    "Our license template is the free license template for license template users. With license template you get license template. Find license template now, license template is here. A license template for license template people.",
    "\n".join("Cloud Box Disk-1 new 10.99 #buy #cheap #new #top" for _ in range(5)),
    "<a href=\"http://a.example\">buy x</a> | <a href=\"http://b.example\">best y</a>",
]
FINE = [
    None, "", "  \n ",
    "The committee met on Monday and agreed to move the office. Nobody objected to the plan. Costs rose because of the delay.",
    "id=1, name=x, due=2024-01-01\nid=2, name=y, due=2024-01-02",
    "2024-01-01 10:00:00 INFO started\n2024-01-01 10:00:01 WARN slow disk",
    "```\nfoo --set a=b\nbar --set c=d\n```",
    "Access badge: the card that opens doors in the building.\nHandover sheet: the list a shift leaves to the next one.",
    "1. Open the console and wait.\n2. Select the record that failed.\n3. Confirm with the duty engineer.",
    "- The manual explains how to restore a copy of the index. (http://a.example/x)\n- The second note lists known faults of the queue. (http://b.example/y)",
    "The committee met on Monday and agreed to move the office to another town next year. Nobody objected.\nTags: office | move",
]


def test_spam_in_disguise():
    """A fence that is never closed, a date ahead of every line, keywords of two letters, a mixture of many shapes."""
    links = "\n".join(f"https://shop{i}.example/deal cheap deal {i}" for i in range(12))
    assert spam.is_spam("```\n" + links) and not spam.is_spam("```\n" + "x = call(y)\n" * 9 + "```")
    assert spam.is_spam("\n".join(f"2024-03-{i + 1:02d} {x}" for i, x in enumerate(links.split("\n"))))
    assert not spam.is_spam("\n".join(f"2024-03-{i + 1:02d} 10:00 the server was started again, see https://wiki.example/{i} for the reasons and the steps." for i in range(9)))
    assert spam.is_spam("Buy a tv here, the best tv of all tv offers. Our tv shop has every tv. Get the tv you want, a tv for all. No tv is as good as this tv. See tv deals on tv now.")
    mixed = "\n".join(f"{'#' if i % 2 else ''}tag{i} #more{i} " + "#x " * (i % 9) + " | ".join(f"item {j}" for j in range(i % 12)) for i in range(60))
    assert spam.is_spam(mixed)


def test_spam_by_shapes(spark):
    assert all(spam.is_spam(t) for t in SPAM), [t for t in SPAM if not spam.is_spam(t)]
    assert not any(spam.is_spam(t) for t in FINE), [t for t in FINE if spam.is_spam(t)]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(SPAM + FINE + SPAM[:1])], "doc_id bigint, text string, is_spam boolean")
    out = {r["doc_id"]: r["is_spam"] for r in spam.spam_pages(df).collect()}
    assert len(out) == len(SPAM + FINE) + 1 and sum(out.values()) == len(SPAM) + 1
    assert spam.spam_pages(df.limit(0)).count() == 0 and spam.shape_groups(df.limit(0)).count() == 0
    groups = spam.shape_groups(df).collect()
    assert sum(g["n_spam"] for g in groups) == len(SPAM) + 1


@pytest.fixture(scope="module")
def model():
    return pii.default_model()


def test_held_out_accuracy(model):
    xs, ys = pii._training(4321)
    hit = total = 0
    for x, y in zip(xs[:600], ys[:600]):
        text, at, want = "".join(x), 0, set()
        for token, label in zip(x, y):
            begin = at + len(token) - len(token.lstrip())
            at += len(token)
            if label % 2:
                want.add((begin, pii.KINDS[(label - 1) // 2]))
        got = {(a, k) for a, _, k in model.items([text])[0]}
        hit += len(got & want)
        total += max(len(got), len(want))
    assert hit / total > 0.9


def test_items_and_placeholders(spark, model):
    text = "Per Anna Skarnolter (mobile +44 20 7946 0123) the desk will move it.\nCc Peter Valdenko, p.valdenko@mail.skorn.example, and keep REQ-12345."
    assert pii.redact(text, model.items([text])[0]) == "Per [PERSON] (mobile [PHONE]) the desk will move it.\nCc [PERSON], [EMAIL], and keep REQ-12345."
    rows = [("a", text), ("a", text), ("b", None), ("c", ""), ("d", " \n"), ("e", "nothing " * 20_000 + "call +33 1 99 00 11 22")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "chunk_id string, text string, kind string")
    found = pii.find_items(df, model=model).distinct().collect()
    assert {r["chunk_id"] for r in found} == {"a", "e"} and all(r["end_at"] > r["start_at"] for r in found)
    out = {r["chunk_id"]: r["text"] for r in pii.redact_texts(df, model=model).collect()}
    assert out["b"] is None and out["c"] == "" and out["d"] == " \n" and out["e"].endswith("[PHONE]")
    assert pii.find_items(df.limit(0), model=model).count() == 0


def test_decoding_does_not_depend_on_the_batch(model):
    xs, _ = pii._training(77)
    texts = ["".join(x) for x in xs[:80]]
    assert [model.items([t])[0] for t in texts] == model.items(texts)


def scan_tables(spark):
    body = ["The records clerk will move the budget to the office.", "Nobody may change the budget before the office agrees.", "The cross-border budget of the office is kept by the records clerk."]
    clean = [(f"t{i}", "T", " ".join(body[(i + j) % 3] for j in range(3)), 1) for i in range(160)]
    pages = []
    for i in range(6):
        town = ["Arby", "Brim", "Corve", "Dunst", "Elgin", "Frome"][i]
        lines = ["ACME Handbook", f"The rccords clerk of {town} will move the bud-", f"get to the 0ffice. {town} has the cross-", f"border records of {town}.", f"Page {i + 1} of 6"]
        pages.append((f"s{i}", "S", "\n".join(lines), i))
    rows = clean + pages + [pages[0], ("n", "S", None, 8), ("e", "S", "", 9), ("b", "S", " \n", 10), ("o", "O", "The clcrk stays.", 1)]
    chunks = spark.createDataFrame([(a, b, c, {"page": p}) for a, b, c, p in rows], "chunk_id string, file_id string, text string, metadata struct<page:int>")
    register = spark.createDataFrame([("S", " .PDF"), ("T", "txt"), ("O", None), (None, "pdf")], "id string, file_type string")
    return chunks, register


def test_scan_faults_and_repair(spark):
    chunks, register = scan_tables(spark)
    found = [r for r in scans.faults(chunks, register).collect()]
    got = {(r["chunk_id"], r["line_no"], r["fault"], r["repaired"]) for r in found}
    assert len(found) == len(got)
    for i in range(6):
        k = f"s{i}"
        assert {g[1:] for g in got if g[0] == k} == {(0, "running_line", ""), (4, "running_line", ""), (1, "broken_word", "budget"), (2, "broken_word", "cross-border"), (1, "misread_word", "records"), (2, "misread_word", "office")}
    assert {g[0] for g in got} == {f"s{i}" for i in range(6)}
    out = {r["chunk_id"]: r["text"] for r in scans.repair(chunks, register).collect()}
    assert out["s3"] == "The records clerk of Dunst will move the budget to the office. Dunst has the cross-border records of Dunst."
    assert set(out) == {f"s{i}" for i in range(6)} | {"b"}
    assert scans.faults(chunks.limit(0), register).count() == 0 and scans.faults(chunks, register.limit(0)).count() == 0


def hand_lines():
    """Lines written by hand in other words than the table's: (text, {(start, kind)})."""
    import re

    kinds = {"p": "person", "e": "email", "t": "phone", "i": "id_number", "a": "address"}
    out = []
    for line in open(os.path.join(os.path.dirname(__file__), "pii_hand.txt"), encoding="utf-8").read().strip().split("\n"):
        text, want = "", set()
        for piece in re.split(r"(\[[petia]:(?:[^\[\]]|\[at\])*\])", line.replace("\\n", "\n")):
            if re.match(r"\[[petia]:", piece):
                want.add((len(text), kinds[piece[1]]))
                piece = piece[3:-1]
            text += piece
        out.append((text, want))
    return out


def test_lines_of_other_words(model):
    lines = hand_lines()
    assert len(lines) >= 200
    hit, true, found = {}, {}, {}
    for text, want in lines:
        got = {(a, k) for a, _, k in model.items([text])[0]}
        for counts, items in ((hit, got & want), (true, want), (found, got)):
            for _, k in items:
                counts[k] = counts.get(k, 0) + 1
    assert sum(hit.values()) >= 0.9 * sum(true.values()) and sum(hit.values()) >= 0.9 * sum(found.values())
    for kind in pii.KINDS:
        assert hit[kind] >= 0.85 * true[kind] and hit[kind] >= 0.85 * found[kind], (kind, hit[kind], true[kind], found[kind])


def test_long_texts_are_decoded_in_bounded_memory(model):
    import tracemalloc

    long = "word " * 60_000 + "call Dr. Lindqvist on +33 1 99 00 11 22"
    tracemalloc.start()
    got = model.items(["a b c"] * 600 + [long])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [k for _, _, k in got[-1]] == ["person", "phone"] and not any(got[:-1]) and peak < 150e6
