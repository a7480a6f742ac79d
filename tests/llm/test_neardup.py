import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm import neardup


def words_of(text):
    return set(neardup._WORD.findall((text or "").lower()))


def brute(rows, t=0.8):
    keep = sorted({(k, frozenset(words_of(x))) for k, x in rows if k is not None and len(words_of(x)) >= 20})
    return {(a, b) for a, x in keep for b, y in keep if a < b and len(x & y) >= t * len(x | y) - 1e-9}


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(260)]
    base = [r.sample(vocabulary, r.choice([20, 21, 25, 40, 60, 90, 150])) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        ws = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(ws) // 5))):
            p = r.random()
            if p < 0.4 and len(ws) > 20:
                ws.pop(r.randrange(len(ws)))
            elif p < 0.7:
                ws.append(r.choice(vocabulary))
            else:
                ws[r.randrange(len(ws))] = r.choice(vocabulary)
        r.shuffle(ws)
        rows.append((f"k{i:03d}", " ".join(ws)))
    return rows


def test_code_covers_with_radius_one():
    table = neardup._patterns()
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << neardup.LENGTH, 2000)
    home = neardup._homes(x)
    assert (neardup._syndromes(home) == 0).all()
    assert (np.bitwise_count(x ^ home) <= 1).all()
    flip = x ^ (1 << r.integers(0, neardup.LENGTH, 2000))
    row, anchor = neardup._replicas(flip)
    assert (neardup._syndromes(anchor) == 0).all() and (np.bitwise_count(flip[row] ^ anchor) <= 2).all()
    reached = set(zip(row.tolist(), anchor.tolist()))
    assert all((i, int(h)) in reached for i, h in enumerate(home))
    assert table.shape == (neardup.LENGTH + 1, 1 + neardup.LENGTH // 2)


def matched(sizes, flat, ids, buckets):
    """Candidate pairs of sets that meet at an anchor, as the two stages of the operator find them."""
    levels = neardup.Levels(0.8)
    blocks = pa.Table.from_batches(list(neardup.entry_blocks(sizes, flat, ids, levels, buckets))).sort_by([("width", "ascending"), ("bucket", "ascending")])
    got = set()
    for out in neardup._match(iter(blocks.to_batches()), 0.8):
        got |= {(x, y) for x, y in zip(out["a"].to_pylist(), out["b"].to_pylist()) if x is not None}
        hot = out.filter(pc.is_valid(out["left_id"]))
        for more in neardup._match_blocks(iter([hot.select(neardup._MATCH_NAMES[2:])]), 0.8):
            got |= set(zip(more["a"].to_pylist(), more["b"].to_pylist()))
    return {tuple(sorted(p)) for p in got}, blocks


def sets_of(texts):
    _, sizes, flat = neardup.word_sets(texts, 20, {})
    ids = neardup.classes(sizes, flat)
    _, first = np.unique(ids, return_index=True)
    flat, _ = neardup._pick(first, sizes, flat)
    return sizes[first], flat, ids[first]


def test_links_equal_brute_force_for_any_buckets(monkeypatch):
    for seed in range(6):
        sizes, flat, ids = sets_of([t for _, t in corpus(seed, 200)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        sets = {int(i): set(flat[a : a + n].tolist()) for i, n, a in zip(ids, sizes, ends)}
        want = {tuple(sorted((p, q))) for p in sets for q in sets if p < q and len(sets[p] & sets[q]) >= 0.8 * len(sets[p] | sets[q]) - 1e-9}
        sent = set()
        for buckets, hot, block in ((1, 4_000_000, 2048), (16, 4_000_000, 2048), (217, 2, 3)):
            monkeypatch.setattr(neardup, "HOT_PAIRS", hot)
            monkeypatch.setattr(neardup, "HOT_BLOCK", block)
            monkeypatch.setattr(neardup, "ENTRIES", 50 * buckets)
            got, blocks = matched(sizes, flat, ids, buckets)
            assert want <= got
            sent.add(sum(len(x) for c in ("context", "print", "id", "size", "sketch") for x in blocks[c].to_pylist()))
        assert len(sent) == 1  # what is shuffled doesn't depend on the number of tasks


def test_pairs_of_very_large_sets_meet():
    """400,000 different words, a tenth of them changed: far beyond any table of levels one would write down."""
    r = np.random.default_rng(3)
    a = np.unique(r.integers(0, 1 << 63, 400_000).astype(np.uint64))
    b = np.unique(np.concatenate([a[20_000:], r.integers(0, 1 << 63, 22_000).astype(np.uint64)]))
    common = len(np.intersect1d(a, b))
    assert 0.8 <= common / (len(a) + len(b) - common) < 0.91
    got, _ = matched(np.array([len(a), len(b)]), np.concatenate([a, b]), np.array([5, 9]), 8)
    assert got == {(5, 9)}


def test_operator_on_odd_rows(spark):
    rows = corpus(11) + [("n1", None), ("n2", ""), ("n3", "  "), ("s", "too few words here"), ("k000", corpus(11)[0][1])]
    long = " ".join(f"z{i}" for i in range(30_000))
    rows += [("long1", long), ("long2", long + " zz")] + [(f"copy{i}", corpus(11)[5][1].upper()) for i in range(5)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "chunk_id string, text string, class string")
    links, members = neardup.links_and_members(df)
    got = {(r[0], r[1]) for r in neardup.pairs_of_keys(links, members).collect()}
    assert got == brute(rows)
    groups = {r["chunk_id"]: r for r in neardup.near_duplicate_groups(df).collect()}
    assert all(groups[a]["group"] == groups[b]["group"] for a, b in got)
    assert groups["copy0"]["class"] == groups["copy4"]["class"] and groups["long1"]["n_links"] == 1
    none = neardup.near_duplicate_groups(df.limit(0))
    assert none.count() == 0


def test_large_groups_of_copies_stay_linear(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(42))
    rows = [(f"c{i:04d}", a) for i in range(400)] + [(f"d{i}", b) for i in range(3)]
    links, members = neardup.links_and_members(spark.createDataFrame(rows, "chunk_id string, text string"))
    got = {(r[0], r[1]) for r in neardup.pairs_of_keys(links, members, copies=50).collect()}
    assert got == {("c0000", f"c{i:04d}") for i in range(1, 400)} | {("d0", "d1"), ("d0", "d2"), ("d1", "d2")} | {("c0000", f"d{i}") for i in range(3)}


def test_texts_of_equal_words_are_paired_in_full(spark):
    """A class of more than COPIES different texts (other order, repetition, punctuation) keeps all its pairs."""
    r, ws = random.Random(5), [f"w{i}" for i in range(40)]
    rows = [(f"c{i:03d}", " ".join(r.sample(ws, 40)) + "!" * (i % 3)) for i in range(130)] + [(f"d{i}", " ".join([*ws, f"x{i}"])) for i in range(3)]
    links, members = neardup.links_and_members(spark.createDataFrame(rows, "chunk_id string, text string"))
    assert {(p[0], p[1]) for p in neardup.pairs_of_keys(links, members).collect()} == brute(rows)


def test_only_exact_copies_are_stars_whatever_the_blocks(spark):
    r, ws = random.Random(6), [f"w{i}" for i in range(40)]
    other = [(f"o{i:02d}", " ".join(r.sample(ws, 40))) for i in range(30)] + [(f"p{i:02d}", " ".join(r.sample([*ws, "x"], 41))) for i in range(17)]
    copies = [(f"q{i:02d}", " ".join(ws)) for i in range(25)]
    links, members = neardup.links_and_members(spark.createDataFrame(other + copies, "chunk_id string, text string"))
    want = brute(other + copies[:1]) | {("q00", k) for k, _ in copies[1:]}
    for block in (4, 1000):
        assert {(p[0], p[1]) for p in neardup.pairs_of_keys(links, members, copies=20, block=block).collect()} == want
