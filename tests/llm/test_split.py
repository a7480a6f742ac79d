import random

from quern.llm import split


def check(text, limit=1600, overlap=200):
    cuts = split.plan(text, limit, overlap)
    ends = [a for a, _, _ in cuts[1:]] + [len(text)]
    assert cuts[0][0] == 0
    for i, ((a, _, _), b) in enumerate(zip(cuts, ends)):
        assert 0 < b - a <= (limit if i == 0 else limit - overlap)
    return cuts


def test_pieces_fit_and_cover_whatever_the_text():
    r = random.Random(1)
    for n in (1601, 3000, 9000, 40000):
        for kind in range(5):
            words = ["x" * r.randint(1, 12) for _ in range(n)]
            seps = {0: [" "], 1: [" ", ". ", "\n"], 2: ["\n\n", " "], 3: [""], 4: [" ", ".\n\n", "\n", "é "]}[kind]
            text = "".join(w + r.choice(seps) for w in words)[:n]
            check(text)


def test_prefers_paragraph_ends():
    text = "\n\n".join(("Word " * 100).strip() + "." for _ in range(8))
    cuts = check(text)
    assert all(kind in ("start", "unit") for _, kind, _ in cuts)


def test_forced_cut_between_units_that_fit_alone_only():
    a, b = "a" * 900, "b" * 900
    text = f"{a}\n \t\n  {b}"
    assert split.forced_cuts(split.units(text), 1600) == [text.index("b")]
    assert [c[0] for c in check(text) if c[2]] == [text.index("b")]
    log = "\n".join(f"2024-03-07 10:0{i} " + "x" * 900 + "\n  at y" for i in range(3))
    assert len(split.forced_cuts(split.units(log), 1600)) == 2
    big = "a" * 1700 + "\n\n" + "b" * 900
    assert split.forced_cuts(split.units(big), 1600) == []


def test_unbroken_text_is_cut_at_the_limit():
    assert all(kind in ("start", "bare") for _, kind, _ in check("x" * 5000))


def test_operator_on_odd_rows(spark):
    long = "Sentence one here. " * 200
    rows = [("a", long, 1), ("a", long, 2), ("b", None, 1), ("c", "", 1), ("d", " \n", 1), ("e", "short", 1), ("f", "y" * 100_000, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, chunk_index int")
    out = {}
    for r in split.split_texts(df).collect():
        out.setdefault(r["chunk_id"], []).append(r)
    assert set(out) == {"a", "c", "d", "e", "f"}
    for k, whole in (("a", long), ("f", "y" * 100_000), ("e", "short"), ("c", ""), ("d", " \n")):
        pieces = sorted(out[k], key=lambda r: r["chunk_index"])
        assert [p["chunk_index"] for p in pieces] == list(range(len(pieces)))
        assert all(len(p["text"]) <= 1600 for p in pieces)
        assert "".join(p["text"][len(p["text"]) - p["own_chars"] :] for p in pieces) == whole
        assert all(p["text"][:200] == whole[p["start_at"] - 200 : p["start_at"]] for p in pieces[1:])
    assert split.split_texts(df.limit(0)).count() == 0
