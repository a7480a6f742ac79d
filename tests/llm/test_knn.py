import numpy as np

from quern.llm import graph, knn


def clustered(n, seed=0, d=64):
    r = np.random.default_rng(seed)
    basis = r.normal(size=(8, d))
    x = r.normal(size=(n, 8)) @ basis * 0.2 + r.normal(size=(12, d))[r.integers(0, 12, n)] + 0.05 * r.normal(size=(n, d))
    return x


def truth(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    out = {}
    for i in range(len(x)):
        s[i, i] = -9
        out[ids[i]] = [ids[j] for j in sorted(range(len(x)), key=lambda j: (-s[i, j], ids[j])) if j != i][:k]
    return out


def test_graph_recall():
    x = clustered(3000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = graph.Graph(x.astype(np.float32))
    ids, _ = g.of_members(10, 28)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), want.tolist())]) > 0.95
    for tiny in (1, 2, 5):
        assert graph.Graph(x[:tiny].astype(np.float32)).of_members(10, 28)[0].shape == (tiny, 10)


def test_operator_recall_against_brute_force(spark):
    x = clustered(2500, 3)
    ids = [f"c{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "chunk_id string, embedding array<double>")
    got = {}
    for r in knn.neighbours(df, shard=400).collect():
        got.setdefault(r["chunk_id"], []).append(r["neighbour"])
    want = truth(x, ids, 10)
    assert len(got) == len(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in ids]) >= 0.9


def test_two_levels_of_shards(spark):
    """More shards than the first sample can give: centroids within cells; recall and members a shard stay."""
    x = clustered(2500, 4)
    ids = [f"c{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "chunk_id string, embedding array<double>")
    got = {}
    for r in knn.neighbours(df, shard=120, cells=5).collect():
        got.setdefault(r["chunk_id"], []).append(r["neighbour"])
    want = truth(x, ids, 10)
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in ids]) >= 0.9
    # A cell of a billion vectors in a thousand cells, from its sample: shards of the wanted size, none hashed.
    part = clustered(10_000, 6).astype(np.float32)
    part /= np.linalg.norm(part, axis=1, keepdims=True)
    every = knn.SHARD // knn.SHARD_SAMPLE
    c, slices = knn.learn_shards(part, len(part) * every, knn.SHARD)
    assert (slices == 1).mean() > 0.97 and 0.5 < len(c) * knn.SHARD / (len(part) * every) < 2 and knn.CELLS * len(c) < 2 * knn.SHARDS_MOST
    assert -(-1_000_000_000 // knn.SHARDS_MOST) <= knn.SHARD
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    top, _ = knn.learn_shards(u, 2500, 500)
    cell = np.argmax(u @ top.T - 0.5 * (top * top).sum(1), axis=1)
    flat = knn.Shards(u[:300], np.ones(300, int))
    nested = knn.Shards(u[:300], np.ones(300, int), top, cell[:300])
    a, b = flat.nearest(u, 1)[0][:, 0], nested.nearest(u, 1)[0][:, 0]
    same = [np.array_equal(flat.centroids[i], nested.centroids[j]) for i, j in zip(a, b)]
    assert np.mean(same) > 0.9


def test_operator_on_odd_rows(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(30, 64))
    rows = [(f"a{i:02d}", v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(f"d{i:02d}", (x[0] * (i + 1)).tolist(), 0) for i in range(15)]  # copies of a00 of other lengths
    rows += [rows[3], ("bad1", None, 0), ("bad2", [0.0] * 64, 0), ("bad3", [float("nan")] + [1.0] * 63, 0), ("bad4", [1.0] * 63, 0), ("bad5", [float("inf")] + [1.0] * 63, 0), (None, [1.0] * 64, 0), ("bad6", [None] + [1.0] * 63, 0)]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<double>, vec int")
    got = {}
    for q in knn.neighbours(df).orderBy("rank").collect():
        got.setdefault(q["chunk_id"], []).append(q["neighbour"])
    good = {k: v for k, v, _ in rows if k and not k.startswith("bad")}
    want = truth(np.array(list(good.values())), list(good), 10)
    assert got == want
    assert knn.neighbours(df.limit(0)).count() == 0
    two = {q["chunk_id"]: q["neighbour"] for q in knn.neighbours(df.filter("chunk_id in ('a01', 'a02')")).collect()}
    assert two == {"a01": "a02", "a02": "a01"}
