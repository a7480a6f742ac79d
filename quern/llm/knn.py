"""The k most similar vectors of every vector, by robust-pruned directed graphs over shards.

Equal directions form one class, so copies cost one point however many there are. A bounded sample of
classes gives centroids by repeated k-means. Where that sample is too small for shards of the wanted size,
it gives cells only, and the centroids of the shards within a cell are learned in a task of its own from a
sample in proportion to the cell; routing then goes by cells first. Leaves that equal vectors keep from
being split get several hashed shards. Every class is a member of the shard of its nearest centroid and a query of up to
`PROBES` near ones, those whose border with its own is near. A task builds the graph of its shard (see graph.py), answers its members from
their own edges and the visiting queries from pivots by beam search. The lists of a class are merged
by similarity, and classes are turned back into keys: equal vectors have similarity 1, ties go to the
smaller key.

The search is approximate (the tests measure recall against brute force, 0.99 here, and demand 0.9);
similarities are computed in single precision, equality in double precision rounded to 12 decimals.

Defined cases: vectors that are null, of another length, all zero or hold NaN or infinity have no
neighbours and are no one's; a key delivered twice counts once; other columns are left out; with fewer
than k other vectors all of them come out; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, spread
from .graph import Graph

K, DIMENSIONS = 10, 64
#: Bound of the sample of classes from which centroids are learned; every vector is indexed.
SAMPLE = 40_000
#: Members a shard should have, and how many shards answer a query.
SHARD, PROBES = 6_000, 4
#: Cells the first sample is split into at most, and how many of them are looked into for a vector's shards.
CELLS, CELL_PROBES = 1_000, 6
#: Most shards (their centroids, 256 bytes each, go to every task): 1.2 billion vectors at the wanted size, larger shards beyond.
SHARDS_MOST = 200_000
#: Most tasks the shards are spread over; with more shards each task has several.
TASKS_MOST = 10_000
#: Sampled members of a shard from which centroids within cells are learned.
SHARD_SAMPLE = 64
#: A further shard is asked if its border is nearer than this part of the distance to the own centroid.
MARGIN = 0.5
BEAM = 44


def _vectors(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of valid vectors, the vectors scaled to unit length)."""
    n = len(column)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    right = np.nonzero(lengths == dimensions)[0]
    if not len(right):
        return np.zeros(0, np.int64), np.zeros((0, dimensions))
    part = column.take(pa.array(right)) if len(right) < n else column
    x = np.asarray(part.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimensions)
    peak = np.abs(x).max(1)  # NaN stays NaN
    ok = np.isfinite(peak) & (peak > 0)
    x, right = x[ok] / peak[ok, None], right[ok]
    return right, x / np.sqrt((x * x).sum(1))[:, None]


def _classes(x: np.ndarray) -> np.ndarray:
    r = np.round(x, 12) + 0.0  # no negative zero
    return np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in r], np.uint64).view(np.int64)


def _unit(df: DataFrame, key: str, vector: str, dimensions: int, with_vectors: bool) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _vectors(batch.column(1), dimensions)
            cols = [batch.column(0).take(pa.array(at)), pa.array(_classes(x), pa.int64())]
            if with_vectors:
                raw = np.ascontiguousarray(x, np.float32)
                cols.append(pa.array([v.tobytes() for v in raw], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["key", "class", "vec"][: len(cols)])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")).filter(F.col("key").isNotNull() & (F.size("v") == dimensions))
    return spread(rows).mapInArrow(run, f"key {kind}, class bigint" + ", vec binary" * with_vectors)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        a = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
        order = np.argsort(a, kind="stable")
        n = np.bincount(a, minlength=k)
        sums = np.add.reduceat(np.concatenate([x[order], np.zeros((1, x.shape[1]), x.dtype)]), np.minimum(np.cumsum(n) - n, len(x)), axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def learn_shards(sample: np.ndarray, total: int, shard: int = SHARD, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, number of hashed shards of each) such that a shard is expected to hold about `shard` of all."""
    rng = np.random.default_rng(seed)
    scale = total / max(1, len(sample))
    leaves: list[tuple[np.ndarray, int]] = []
    todo = [np.arange(len(sample))] if len(sample) else []
    while todo:
        part = todo.pop()
        expected = len(part) * scale
        if expected > 1.4 * shard and len(part) >= 32:
            k = min(8, max(2, round(expected / shard)))
            c = _kmeans(sample[part], k, rng)
            a = np.argmax(sample[part] @ c.T - 0.5 * (c * c).sum(1), axis=1)
            groups = [part[a == i] for i in range(k) if (a == i).any()]
            if len(groups) > 1:
                todo += groups
                continue
        leaves.append((sample[part].mean(0), max(1, round(expected / shard))))
    if not leaves:
        leaves = [(np.zeros(sample.shape[1], np.float32), 1)]
    return np.stack([c for c, _ in leaves]).astype(np.float32), np.array([s for _, s in leaves])


class Shards:
    """Centroids of shards, and the cells they lie in; slices: hashed shards of a centroid."""

    def __init__(self, centroids: np.ndarray, slices: np.ndarray, cells: np.ndarray | None = None, cell: np.ndarray | None = None):
        if cell is not None:
            order = np.argsort(cell, kind="stable")
            centroids, slices, cell = centroids[order], slices[order], cell[order]
            self.begin, self.end = (np.searchsorted(cell, np.arange(len(cells)), side) for side in ("left", "right"))
        self.centroids, self.slices, self.cells = centroids, slices, cells
        self.first = np.cumsum(slices) - slices
        self.half = 0.5 * (centroids * centroids).sum(1)

    def nearest(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, scores) of the best `probes` of each row, best first; -1 where there are fewer."""
        if self.cells is None:
            score = x @ self.centroids.T - self.half
            p = min(probes, len(self.centroids))
            near = np.argpartition(-score, p - 1, axis=1)[:, :p]
            best = np.take_along_axis(score, near, 1)
        else:
            score = x @ self.cells.T - 0.5 * (self.cells * self.cells).sum(1)
            t = min(CELL_PROBES, len(self.cells))
            cells = np.argpartition(-score, t - 1, axis=1)[:, :t]
            near, best = np.full((len(x), t * probes), -1, np.int64), np.full((len(x), t * probes), -np.inf, np.float32)
            row, place = np.divmod(np.argsort(cells, axis=None, kind="stable"), t)
            which, start = np.unique(cells[row, place], return_index=True)
            for c, a, b in zip(which.tolist(), start.tolist(), [*start[1:].tolist(), len(row)]):
                own = slice(int(self.begin[c]), int(self.end[c]))
                p = min(probes, own.stop - own.start)
                if p:
                    r = row[a:b]
                    s = x[r] @ self.centroids[own].T - self.half[own]
                    top = np.argpartition(-s, p - 1, axis=1)[:, :p]
                    at = place[a:b, None] * probes + np.arange(p)
                    near[r[:, None], at], best[r[:, None], at] = top + own.start, np.take_along_axis(s, top, 1)
        order = np.argsort(-best, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(near, order, 1), np.take_along_axis(best, order, 1)


def find_shards(units: DataFrame, sample: np.ndarray, total: int, shard: int = SHARD, cells: int = CELLS) -> Shards:
    """Shards of about `shard` members each, learned in one level where the sample allows it, else in two."""
    shard = max(shard, -(-total // SHARDS_MOST))
    if total <= cells * shard or not len(sample):
        return Shards(*learn_shards(sample, total, shard))
    tops, _ = learn_shards(sample, total, -(-total // cells))
    top = Shards(tops, np.ones(len(tops), np.int64))
    every = max(1, shard // SHARD_SAMPLE)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(top.nearest(x, 1)[0][:, 0], pa.int64()), batch.column(0)], names=["cell", "vec"])

    def within(group: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float32).reshape(group.num_rows, -1)
        x = x[np.lexsort(x.T)]  # the result doesn't depend on the order of arrival
        c, slices = learn_shards(x, len(x) * every, shard)
        return pa.table({"cell": pa.array([group.column("cell")[0].as_py()] * len(c), pa.int64()), "centroid": pa.array([v.tobytes() for v in c], pa.binary()), "slices": pa.array(slices, pa.int64())})

    picked = units.filter(F.pmod(F.xxhash64("class", F.lit(1)), F.lit(every)) == 0).dropDuplicates(["class"]).select("vec")
    found = picked.mapInArrow(assign, "cell bigint, vec binary").groupBy("cell").applyInArrow(within, "cell bigint, centroid binary, slices bigint").toArrow()
    cell = np.asarray(found.column("cell").combine_chunks(), np.int64)
    centroids = np.frombuffer(b"".join(found.column("centroid").to_pylist()), np.float32).reshape(len(cell), -1)
    slices = np.asarray(found.column("slices").combine_chunks(), np.int64)
    empty = np.setdiff1d(np.arange(len(tops)), cell)  # a cell without a sampled member is a shard of its own
    return Shards(np.concatenate([centroids, tops[empty]]), np.concatenate([slices, np.ones(len(empty), np.int64)]), tops, np.concatenate([cell, empty]))


def _route(batches: Iterator[pa.RecordBatch], shards: Shards, probes: int, margin: float) -> Iterator[pa.RecordBatch]:
    first, slices, centroids = shards.first, shards.slices, shards.centroids
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.asarray(batch.column(0))
        x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(batch.num_rows, -1)
        near, best = shards.nearest(x, probes)
        own = centroids[near[:, 0]]
        reach = margin * np.sqrt(np.maximum(1 - 2 * best[:, 0], 0))  # |x - c|, as x has length 1
        home = first[near[:, 0]] + (ids.view(np.uint64) % slices[near[:, 0]].astype(np.uint64)).astype(np.int64)
        rows, shard, member = [np.arange(len(ids))], [home], [np.ones(len(ids), bool)]
        for c in range(near.shape[1]):
            between = np.sqrt(((centroids[near[:, c]] - own) ** 2).sum(1))
            near_by = (near[:, c] >= 0) & ((best[:, 0] - best[:, c]) <= reach * between)
            n = np.where(near_by, slices[near[:, c]], 0)
            row = np.repeat(np.arange(len(ids)), n)
            s = np.repeat(first[near[:, c]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            away = s != home[row]  # in its own shard a member is asked as a member
            rows.append(row[away])
            shard.append(s[away])
            member.append(np.zeros(int(away.sum()), bool))
        take = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shard), pa.int32()), pa.array(np.concatenate(member)), batch.column(0).take(take), batch.column(1).take(take)], names=["shard", "member", "class", "vec"])


def _answer(group: pa.Table, k: int, beam: int) -> pa.Table:
    member = np.asarray(group.column("member").combine_chunks())
    ids = np.asarray(group.column("class").combine_chunks())
    x = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float32).reshape(len(ids), -1)
    own, own_ids = x[member], ids[member]
    out_q, near, sims = [np.zeros(0, np.int64)], [np.zeros((0, k), np.int64)], [np.zeros((0, k), np.float32)]
    if len(own):
        order = np.argsort(own_ids)  # the graph doesn't depend on the order of arrival
        own, own_ids = own[order], own_ids[order]
        graph = Graph(own)
        for q, (i, s) in ((own_ids, graph.of_members(k, beam)), (ids[~member], graph.search(x[~member], beam))):
            out_q.append(q)
            near.append(np.where(i[:, :k] >= 0, own_ids[i[:, :k]], 0))
            sims.append(np.where(i[:, :k] >= 0, s[:, :k], -9))
    q, near, sims = np.concatenate(out_q), np.concatenate(near), np.concatenate(sims)
    ok = sims > -9
    ends = np.concatenate([[0], np.cumsum(ok.sum(1))])
    items = pa.StructArray.from_arrays([pa.array(-sims[ok].astype(np.float64)), pa.array(near[ok])], ["away", "id"])
    return pa.table({"class": pa.array(q, pa.int64()), "near": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)})


_NEAR = "array<struct<away: double, id: bigint>>"


def class_neighbours(units: DataFrame, total: int, k: int = K, shard: int = SHARD, probes: int = PROBES, margin: float = MARGIN, beam: int = BEAM, cells: int = CELLS) -> DataFrame:
    """(class, near): the k nearest other classes of each class of units (class, vec); total: number of classes."""
    every = max(1, total // SAMPLE)
    # A sample by hash: the same classes whatever the partitions.
    picked = units.filter(F.pmod(F.xxhash64("class"), F.lit(every)) == 0).dropDuplicates(["class"]).select("vec").limit(2 * SAMPLE).toArrow()
    raw = b"".join(picked.column("vec").to_pylist())
    sample = np.frombuffer(raw, np.float32).reshape(picked.num_rows, -1) if picked.num_rows else np.zeros((0, 1), np.float32)
    classes = units.groupBy("class").agg(F.any_value("vec").alias("vec"))
    shards = find_shards(units, sample, total, shard, cells)
    routed = classes.select("class", "vec").mapInArrow(lambda it: _route(it, shards, probes, margin), "shard int, member boolean, class bigint, vec binary")
    # One or two shards a task while there are few: packed by bytes, some tasks would hold many more than others.
    routed = routed.repartition(min(2 * int(shards.slices.sum()), TASKS_MOST), "shard")
    lists = routed.groupBy("shard").applyInArrow(lambda g: _answer(g, k, beam), f"class bigint, near {_NEAR}")
    return lists.groupBy("class").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def _ranked(df: DataFrame, key: str, vector: str, k: int, dimensions: int, tuning: dict) -> tuple[DataFrame, DataFrame]:
    """(ids, near): ids (key, class, ord) with numbers in the order of keys; near (ord, near ARRAY<STRUCT<away, ord>>).

    Numbers stand for keys in every later shuffle, and as they keep the order, ties still go to the smaller key.
    """
    ids = _unit(df, key, vector, dimensions, False).distinct()
    ids = ids.repartitionByRange("key").sortWithinPartitions("key").withColumn("ord", F.monotonically_increasing_id())
    ids = materialise(ids)
    units = _unit(df, key, vector, dimensions, True).select("class", "vec")
    lists = class_neighbours(units, ids.select("class").distinct().count(), k, **tuning)
    # The smallest keys of a class are all that can be among anyone's k; one more, as a key isn't its own neighbour.
    least = ids.select("class", "ord").withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("ord"))).filter(F.col("place") <= k + 1).drop("place")
    peers = least.groupBy("class").agg(F.collect_list(F.struct(F.lit(-1.0).alias("away"), F.col("ord"))).alias("peers"))
    far = lists.select("class", F.explode("near").alias("n")).select("class", F.round("n.away", 9).alias("away"), F.col("n.id").alias("id"))
    far = far.join(least.withColumnRenamed("class", "id"), "id").groupBy("class").agg(F.slice(F.array_sort(F.collect_list(F.struct("away", "ord"))), 1, k).alias("far"))
    both = peers.join(far, "class", "left").select("class", F.array_sort(F.when(F.col("far").isNull(), F.col("peers")).otherwise(F.concat("peers", "far"))).alias("near"))
    near = ids.select("class", "ord").join(both, "class").select("ord", F.slice(F.filter("near", lambda n: n["ord"] != F.col("ord")), 1, k).alias("near"))
    return ids, near


def neighbours(df: DataFrame, key: str = "chunk_id", vector: str = "embedding", k: int = K, dimensions: int = DIMENSIONS, **tuning: float) -> DataFrame:
    """(key, neighbour, similarity DOUBLE, rank INT): the k most similar others of each key."""
    ids, near = _ranked(df, key, vector, k, dimensions, tuning)
    rows = near.select("ord", F.posexplode("near").alias("at", "n")).select("ord", F.col("at"), F.col("n.ord").alias("other"), F.col("n.away").alias("away"))
    names = ids.select("ord", "key")
    out = rows.join(names, "ord").withColumnRenamed("key", "mine").join(names.withColumnRenamed("ord", "other"), "other")
    return out.select(F.col("mine").alias(key), F.col("key").alias("neighbour"), (-F.col("away")).alias("similarity"), (F.col("at") + 1).alias("rank"))


def neighbour_pairs(df: DataFrame, names: tuple[str, str], key: str = "chunk_id", vector: str = "embedding", k: int = K, dimensions: int = DIMENSIONS, **tuning: float) -> DataFrame:
    """Pairs of keys, the smaller first, of which at least one is among the k most similar of the other; each once."""
    ids, near = _ranked(df, key, vector, k, dimensions, tuning)
    rows = near.select("ord", F.explode("near.ord").alias("other"))
    pairs = rows.select(F.least("ord", "other").alias("a"), F.greatest("ord", "other").alias("b")).distinct()
    named = ids.select("ord", "key")
    left = pairs.join(named.select(F.col("ord").alias("a"), F.col("key").alias(names[0])), "a")
    return left.join(named.select(F.col("ord").alias("b"), F.col("key").alias(names[1])), "b").select(*names)
