"""Near-duplicate texts by anchor points of a covering code.

Two texts are near-duplicates if their sets of words (runs of a-z and 0-9 in the lower-cased text)
have an intersection of at least `threshold` of their union. That bounds the words only one of them
has: d <= (|A| + |B|) (1 - threshold) / (1 + threshold). The universe of words is cut by hash into
parts; among the first d // 2 + 1 parts, one holds at most one of those words (pigeonhole).

A part is cut in two halves, and one of them holds none of those words: it is equal in both texts. Its
words' hash is the context. The other half's fingerprint is 31 parity bits, each word flips one, so the
fingerprints of the two texts differ in one bit at most. The anchors are the 2^26 words of the binary
Hamming code of that length, a perfect covering code of radius 1: every fingerprint has exactly one
home anchor within distance 1. Per context, the larger text's fingerprint is replicated to every anchor
within covering radius plus threshold (1 + 1), 15.5 on average, the smaller one's goes to its home; if
they differ in one bit at most, they meet there. Nothing is lost: the result is exact for sets of any
size, and no pairs are compared but those that share an anchor.

Fingerprints travel to the task of their context, twice each (either half may be the equal one), and
replicas are made there. So what is shuffled doesn't depend on how many tasks compare, and no corpus is
large enough to replicate more. (Anchors of a whole part instead of a half need no context, but then a
fingerprint goes to all 16 tasks of its anchors.)

At an anchor, pairs whose whole-set parity sketches differ in more than d bits are dropped (each word
in one set only flips one bit, so this drops no true pair); what stays is compared word by word. An
anchor where more than HOT_PAIRS pairs meet is cut into blocks of both sides which are compared by
tasks of their own.

Texts with the same set of words form one class, which is fingerprinted once a task however many
of them there are; links are between classes, membership is a table of its own.

Defined cases: null, empty and short texts (fewer than `min_words` different words) have no links and
no class; rows delivered twice count once; sets that are equal have similarity 1; an empty table
gives empty results; other columns are left out. Classes are 64-bit hashes of the sorted words: among
a billion classes the odds that two of them clash anywhere are 1 in 37.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, parallelism, spread

THRESHOLD, MIN_WORDS = 0.8, 20
_WORD = re.compile("[a-z0-9]+")
#: Check bits of the binary Hamming code that gives the anchors; its words have 2 ** CHECK - 1 bits.
CHECK = 5
LENGTH, RADIUS = 2**CHECK - 1, 1
#: Texts a bucket of contexts stands for, in memory of a task at once; there are BUCKETS at least. What is sent doesn't depend on them.
BUCKETS, BUCKET_TEXTS, TASKS_MOST = 1024, 5_000, 20_000
#: Entries compared in one go, and characters of text fingerprinted in one go; only memory depends on them.
ENTRIES, CHARS = 1_500_000, 6_000_000
#: An anchor with more pairs is cut into blocks of so many entries a side.
HOT_PAIRS, HOT_BLOCK = 4_000_000, 2_048
#: Candidate classes up to this many (8 bytes each) are broadcast.
BROADCAST_CLASSES = 500_000
#: Exactly equal texts that are paired in full.
COPIES = 100
#: Keys of a class in one block of the join that makes pairs; only task size depends on it.
BLOCK_KEYS = 1_000
#: Pairs compared at once; only memory depends on it.
BLOCK_PAIRS = 1_000_000


@lru_cache(1)
def _patterns() -> np.ndarray:
    """By syndrome, the error patterns within covering radius plus 1, home first; -1 where there are fewer.

    Bit i of a word stands for position i + 1; the syndrome is the XOR of the positions of the set bits.
    """
    table = np.full((LENGTH + 1, 1 + LENGTH // 2), -1, np.int64)
    table[0, 0] = 0
    for s in range(1, LENGTH + 1):
        two = [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, LENGTH + 1) if i < i ^ s]
        table[s, : 1 + len(two)] = [1 << (s - 1), *two]
    return table


@lru_cache(1)
def _syndrome_tables() -> list[np.ndarray]:
    out = []
    for first in range(0, LENGTH, 11):
        n = min(11, LENGTH - first)
        t = np.zeros(1 << n, np.int64)
        for i in range(n):
            t[1 << i : 2 << i] = t[: 1 << i] ^ (first + i + 1)
        out.append(t)
    return out


def _syndromes(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x), np.int64)
    for i, t in enumerate(_syndrome_tables()):
        s ^= t[(x >> (11 * i)) & (len(t) - 1)]
    return s


class Levels:
    """Sizes of sets in levels; a level fixes how many parts the universe is cut into."""

    def __init__(self, threshold: float):
        self.t = threshold
        self.spread = (1 - threshold) / (1 + threshold)
        counts, p = [], 2
        while p < 1 << 34:  # enough parts for sets of a hundred billion words
            counts.append(p)
            p = max(p + 1, int(p * 1.3))
        self.parts = np.array(counts)

    def differing(self, total: np.ndarray) -> np.ndarray:
        """Most words that only one of two sets has, by the sum of their sizes."""
        return np.floor(np.asarray(total) * self.spread + 1e-9).astype(np.int64)

    def needed(self, total: np.ndarray) -> np.ndarray:
        return self.differing(total) // 2 + 1

    def of(self, size: np.ndarray) -> np.ndarray:
        """The level of the larger set of a pair."""
        return np.searchsorted(self.parts, self.needed(2 * np.asarray(size)))

    def largest(self, level: int) -> int:
        """No set in the level is larger."""
        return int(math.ceil((2 * int(self.parts[level]) + 2) / self.spread))

    def sketch_words(self, level: int) -> int:
        """64-bit words of the whole-set sketch that tell unlike sets of this level apart."""
        d = int(self.differing(2 * self.largest(level)))
        for w in (1, 2, 4, 8):
            bits = 64 * w
            if bits / 2 - math.sqrt(bits) / 2 >= d:
                return w
        return 16


SKETCH_BITS = 1024


def word_sets(texts: list[str | None], min_words: int, table: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of each text with enough words, their sizes, sorted word hashes one text after the other)."""
    which, sizes, flat = [], [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        words = set(_WORD.findall(t.lower()))
        if len(words) < min_words:
            continue
        hashes = []
        for w in words:
            h = table.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w)
                if len(table) < 1_000_000:
                    table[w] = h
            hashes.append(h)
        a = np.array(hashes, np.uint64)
        a.sort()
        which.append(i)
        sizes.append(len(a))
        flat.append(a)
    return np.array(which, np.int64), np.array(sizes, np.int64), np.concatenate(flat) if flat else np.zeros(0, np.uint64)


def classes(sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.array([xxhash.xxh64_intdigest(flat[b - n : b].tobytes(), 7) for n, b in zip(sizes.tolist(), ends.tolist())], np.uint64).view(np.int64)


def _pick(which: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of some of the sets, and their owners counted from 0."""
    starts = np.cumsum(sizes) - sizes
    n = sizes[which]
    own = np.repeat(np.arange(len(which)), n)
    at = np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return flat[at], own


def _sketches(count: int, words: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(count, SKETCH_BITS / 64) parity sketches; a shorter one is the XOR of its slices."""
    bit = (words >> np.uint64(40)) % np.uint64(SKETCH_BITS)
    out = np.zeros((count, SKETCH_BITS // 64), np.uint64)
    np.bitwise_xor.at(out, (own, (bit % np.uint64(SKETCH_BITS // 64)).astype(np.int64)), np.uint64(1) << (bit // np.uint64(SKETCH_BITS // 64)))
    return out


def _fold(sketch: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(len(sketch), -1, words), axis=1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _homes(prints: np.ndarray) -> np.ndarray:
    return prints ^ _patterns()[_syndromes(prints), 0]


def _replicas(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) for all anchors within radius plus threshold."""
    errors = _patterns()[_syndromes(prints)]
    row, col = np.nonzero(errors >= 0)
    return row, prints[row] ^ errors[row, col]


def entries(sizes: np.ndarray, flat: np.ndarray, levels: Levels) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(sketch words, set, context, fingerprint, replicated) of every half of every part that a set is to be met in.

    An entry that is replicated stands at its home, too: of two sets of a level either may be the larger one.
    """
    if not len(sizes):
        return
    top = levels.of(sizes)
    reach = levels.of(np.floor(sizes / levels.t + 1e-9).astype(np.int64))
    for level in range(int(top.min()), int(reach.max()) + 1):
        which = np.nonzero((top <= level) & (level <= reach))[0]
        if not len(which):
            continue
        parts = int(levels.parts[level])
        n = sizes[which]
        partner = np.minimum(np.floor(n / levels.t + 1e-9).astype(np.int64), levels.largest(level))
        use_home = levels.needed(n + partner)
        use_rep = np.where(top[which] == level, levels.needed(2 * n), 0)
        words, own = _pick(which, sizes, flat)
        part = (words % np.uint64(parts)).astype(np.int64)
        keep = part < use_home[own]
        part, own, words = part[keep], own[keep], words[keep]
        first = np.cumsum(use_home) - use_home  # cells of a set: two halves for each part it uses
        cell = 2 * (first[own] + part) + (words >> np.uint64(60) & np.uint64(1)).astype(np.int64)
        total = int(use_home.sum())
        equal, prints = np.zeros(2 * total, np.uint64), np.zeros(2 * total, np.int64)
        np.bitwise_xor.at(equal, cell, _mix(words))
        np.bitwise_xor.at(prints, cell, np.int64(1) << ((words >> np.uint64(20)) % np.uint64(LENGTH)).astype(np.int64))
        own = np.repeat(np.arange(len(which)), use_home)
        part = np.arange(total) - np.repeat(first, use_home)
        rep = part < use_rep[own]
        for half in (0, 1):
            place = (np.uint64(level) << np.uint64(40)) + (part.astype(np.uint64) << np.uint64(1)) + np.uint64(half + 1)
            yield levels.sketch_words(level), which[own], _mix(equal[half::2] ^ _mix(place)), prints[1 - half :: 2], rep


_BLOCK = "bucket int, width int, replicated int, context binary, print binary, id binary, size binary, sketch binary"
_BLOCK_FIELDS = [pa.field(n, pa.int32() if k == "int" else pa.binary()) for n, k in (x.split() for x in _BLOCK.split(", "))]


def entry_blocks(sizes: np.ndarray, flat: np.ndarray, ids: np.ndarray, levels: Levels, buckets: int) -> Iterator[pa.RecordBatch]:
    """The entries by bucket of their context, those that are replicated first."""
    words, own = _pick(np.arange(len(sizes)), sizes, flat)
    sketch = _sketches(len(sizes), words, own)
    by_width: dict[int, list] = {}
    for width, *rest in entries(sizes, flat, levels):
        by_width.setdefault(width, []).append(rest)
    for width, rows in by_width.items():
        own, context, prints, rep = (np.concatenate([r[i] for r in rows]) for i in range(4))
        bucket = (context >> np.uint64(32)) % np.uint64(buckets)
        order = np.lexsort((~rep, bucket))
        own, context, prints, rep, bucket = own[order], context[order], prints[order].astype(np.uint32), rep[order], bucket[order].astype(np.int32)
        folded = _fold(sketch, width)
        every, start = np.unique(bucket, return_index=True)
        ends = [*start[1:].tolist(), len(bucket)]
        size = sizes[own].astype(np.uint16 if int(sizes.max()) < 1 << 16 else np.uint32)
        context, ident, marks = context.astype(np.uint32), ids[own], folded[own]
        cols = [[x[a:b].tobytes() for a, b in zip(start.tolist(), ends)] for x in (context, prints, ident, size, marks)]
        counts = np.add.reduceat(rep.astype(np.int32), start).astype(np.int32)
        head = [pa.array(every), pa.array(np.full(len(every), width, np.int32)), pa.array(counts)]
        yield pa.RecordBatch.from_arrays([*head, *(pa.array(c, pa.binary()) for c in cols)], names=[f.name for f in _BLOCK_FIELDS])


def _emit(batches: Iterator[pa.RecordBatch], threshold: float, min_words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    levels, table, done = Levels(threshold), {}, set()
    for batch in batches:
        texts = batch.column(0).to_pylist()
        a = 0
        while a < len(texts):
            b, chars = a, 0
            while b < len(texts) and (b == a or chars + len(texts[b]) <= CHARS):
                chars += len(texts[b])
                b += 1
            _, sizes, flat = word_sets(texts[a:b], min_words, table)
            a = b
            ids = classes(sizes, flat)
            _, first = np.unique(ids, return_index=True)
            first = np.array([i for i in np.sort(first).tolist() if int(ids[i]) not in done], np.int64)
            if len(done) > 2_000_000:
                done.clear()  # a copy met again later is only sent once more
            done.update(ids[first].tolist())
            if len(first):
                words, _ = _pick(first, sizes, flat)
                for block in entry_blocks(sizes[first], words, ids[first], levels, buckets):
                    for i in range(0, block.num_rows, 256):
                        yield block.slice(i, 256)


def near_enough(levels: Levels, x: np.ndarray, y: np.ndarray, ids: np.ndarray, sizes: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Distinct (smaller, larger) ids of the pairs (x, y) that size and sketch don't rule out."""
    p, q = sizes[x], sizes[y]
    keep = (p >= levels.t * q - 1e-9) & ((p < q) | ((p == q) & (ids[x] < ids[y])))
    x, y, p, q = x[keep], y[keep], p[keep], q[keep]
    apart = np.zeros(len(x), np.int64)
    for w in range(sketches.shape[1]):
        apart += np.bitwise_count(sketches[x, w] ^ sketches[y, w])
    keep = apart <= levels.differing(p + q)
    return np.unique(np.stack([ids[x[keep]], ids[y[keep]]], 1), axis=0)


_MATCH = "a bigint, b bigint, left_id binary, left_size binary, left_sketch binary, right_id binary, right_size binary, right_sketch binary"
_MATCH_NAMES = [x.split()[0] for x in _MATCH.split(", ")]


def _pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(pairs), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), *[none] * 6], names=_MATCH_NAMES)


def match_entries(levels: Levels, rep: np.ndarray, context: np.ndarray, prints: np.ndarray, ids: np.ndarray, sizes: np.ndarray, sketches: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of entries that share context and anchor, and blocks of the anchors where too many meet."""
    # A context that one class alone has brings no one together; with these its replicas need not be made.
    order = np.argsort(context, kind="stable")
    c = context[order]
    begin = np.concatenate([[True], c[1:] != c[:-1]])
    group = np.cumsum(begin) - 1
    several = np.zeros(int(group[-1]) + 1, bool)
    several[group[1:][(~begin[1:]) & (ids[order][1:] != ids[order][:-1])]] = True
    order = order[several[group]]
    if not len(order):
        return
    rep, context, prints, ids, sizes, sketches = (x[order] for x in (rep, context, prints, ids, sizes, sketches))
    _, context = np.unique(context, return_inverse=True)
    context = context.astype(np.int64) << LENGTH
    key = context | _homes(prints)
    order = np.argsort(key, kind="stable")
    key, place = key[order], order
    larger = np.nonzero(rep)[0]
    for s in range(0, len(larger), 200_000):
        part = larger[s : s + 200_000]
        row, anchor = _replicas(prints[part])
        row = part[row]
        anchor |= context[row]
        lo, hi = np.searchsorted(key, anchor, "left"), np.searchsorted(key, anchor, "right")
        some = hi > lo
        row, anchor, lo, n = row[some], anchor[some], lo[some], (hi - lo)[some]
        # Hot anchors: the replicas of this stretch against the homes, block by block, elsewhere.
        every, at, meet = np.unique(anchor, return_inverse=True, return_counts=True)
        homes = np.zeros(len(every), np.int64)
        homes[at] = n
        hot = homes * meet > HOT_PAIRS
        for h in np.nonzero(hot)[0].tolist():
            mine = np.nonzero(at == h)[0]
            left, right = place[lo[mine[0]] : lo[mine[0]] + homes[h]], row[mine]
            for i in range(0, len(left), HOT_BLOCK):
                for j in range(0, len(right), HOT_BLOCK):
                    sides = [x[k].tobytes() for k in (left[i : i + HOT_BLOCK], right[j : j + HOT_BLOCK]) for x in (ids, sizes, sketches)]
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.array([x], pa.binary()) for x in sides)], names=_MATCH_NAMES)
        cold = ~hot[at]
        row, lo, n = row[cold], lo[cold], n[cold]
        total = np.concatenate([[0], np.cumsum(n)])
        a = 0
        while a < len(row):
            b = max(a + 1, int(np.searchsorted(total, total[a] + BLOCK_PAIRS, "right")) - 1)
            pos = np.arange(int(total[a]), int(total[b]), dtype=np.int64)
            i = np.repeat(np.arange(a, b), n[a:b])
            pairs = near_enough(levels, place[lo[i] + pos - total[i]], row[i], ids, sizes, sketches)
            if len(pairs):
                yield _pair_batch(pairs)
            a = b


def _match(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of width and bucket; whole buckets are compared, as many as ENTRIES hold."""
    levels = Levels(threshold)
    held: list[tuple] = []
    count, last = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            yield from match_entries(levels, *(np.concatenate([h[i] for h in held]) for i in range(6)))
            held.clear()

    for batch in batches:
        for bucket, width, replicated, context, prints, ids, size, sketch in zip(*(c.to_pylist() for c in batch.columns)):
            if last != (width, bucket) and (count > ENTRIES or last is not None and last[0] != width):
                yield from flush()
                count = 0
            last = (width, bucket)
            n = len(context) // 4
            kind = np.uint16 if len(size) == 2 * n else np.uint32
            context = np.frombuffer(context, np.uint32).astype(np.int64)
            held.append((np.arange(n) < replicated, context, np.frombuffer(prints, np.uint32).astype(np.int64), np.frombuffer(ids, np.int64), np.frombuffer(size, kind).astype(np.int64), np.frombuffer(sketch, np.uint64).reshape(n, width)))
            count += n
    yield from flush()


def _match_blocks(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs of blocks of hot anchors."""
    levels = Levels(threshold)
    for batch in batches:
        for li, ls, lk, ri, rs, rk in zip(*(c.to_pylist() for c in batch.columns)):
            ids = np.frombuffer(li + ri, np.int64)
            n, m = len(li) // 8, len(ri) // 8
            sizes, sketches = np.frombuffer(ls + rs, np.int64), np.frombuffer(lk + rk, np.uint64).reshape(n + m, -1)
            for i in range(0, n, max(1, BLOCK_PAIRS // m)):
                x = np.arange(i, min(n, i + max(1, BLOCK_PAIRS // m)))
                pairs = near_enough(levels, np.repeat(x, m), np.tile(np.arange(n, n + m), len(x)), ids, sizes, sketches)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])


def candidates(df: DataFrame, text: str, threshold: float, min_words: int, buckets: int | None = None) -> DataFrame:
    """(a, b): class pairs that share an anchor and have near sketches; holds every true pair."""
    rows = df.select(F.col(f"`{text}`").alias("text")).filter(F.length("text") >= 2 * min_words - 1)
    texts = rows.count()
    # Beyond a million buckets each gets eight times the texts, as a batch would have an entry or two for a smaller one.
    buckets = buckets or max(BUCKETS, min(texts // BUCKET_TEXTS, 1_000_000), texts // (8 * BUCKET_TEXTS))
    tasks = min(buckets, TASKS_MOST, max(parallelism(df.sparkSession), texts // BUCKET_TEXTS))
    blocks = spread(rows).mapInArrow(lambda it: _emit(it, threshold, min_words, buckets), _BLOCK)
    met = blocks.repartition(tasks, "bucket").sortWithinPartitions("width", "bucket").mapInArrow(lambda it: _match(it, threshold), _MATCH)
    met = materialise(met)
    hot = met.filter("left_id IS NOT NULL").select(*_MATCH_NAMES[2:]).repartition(2 * parallelism(df.sparkSession))
    hot = hot.mapInArrow(lambda it: _match_blocks(it, threshold), "a bigint, b bigint")
    return met.filter("a IS NOT NULL").select("a", "b").unionByName(hot).distinct()


def sets_table(df: DataFrame, key: str, text: str, min_words: int, with_words: bool = True, with_copy: bool = False) -> DataFrame:
    """(key, class, words ARRAY<BIGINT>) of every text with enough words; without words if they aren't needed.

    With `copy`, a hash of the whole text: within a class, exactly equal texts have equal ones.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, int] = {}
        for batch in batches:
            which, sizes, flat = word_sets(batch.column(1).to_pylist(), min_words, table)
            cols = [batch.column(0).take(pa.array(which)), pa.array(classes(sizes, flat), pa.int64())]
            if with_words:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.view(np.int64))))
            if with_copy:
                cols.append(batch.column(2).take(pa.array(which)))
            yield pa.RecordBatch.from_arrays(cols, names=["key", "class", *["words"] * with_words, *["copy"] * with_copy])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter(F.length("text") >= 2 * min_words - 1)
    if with_copy:
        rows = rows.withColumn("copy", F.xxhash64("text"))
    return spread(rows).mapInArrow(run, f"key {kind}, class bigint" + ", words array<bigint>" * with_words + ", copy bigint" * with_copy)


def links_and_members(df: DataFrame, key: str = "chunk_id", text: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS, with_copy: bool = True) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between different classes of near-duplicates, and members (key, class, copy).

    Every text with enough words is a member of its class; texts of one class have equal sets of words, and those of
    one copy are exactly equal.
    """
    pairs = materialise(candidates(df, text, threshold, min_words))
    members = sets_table(df, key, text, min_words, False, with_copy).distinct()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    every = sets_table(df, key, text, min_words).select("class", "words")
    # Few candidates: only their words are shuffled. Many: copies are merged before the join, so no class is hot.
    if wanted.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:
        every = every.join(F.broadcast(wanted), "class", "left_semi")
        sets = every.groupBy("class").agg(F.any_value("words").alias("words"))
    else:
        sets = every.groupBy("class").agg(F.any_value("words").alias("words")).join(wanted, "class", "left_semi")
    sets = materialise(sets)
    left = sets.select(F.col("class").alias("a"), F.col("words").alias("wa"))
    right = sets.select(F.col("class").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("wa", "wb"))
    links = both.filter(common >= threshold * (F.size("wa") + F.size("wb") - common) - 1e-9).select("a", "b")
    return links, members


def pairs_of_keys(links: DataFrame, members: DataFrame, names: tuple[str, str] = ("key_a", "key_b"), copies: int = COPIES, block: int = BLOCK_KEYS) -> DataFrame:
    """Pairs of near-duplicate keys, the smaller first: across linked classes and within a class.

    Different texts are paired in full, however many a class has. Only where more than `copies` texts are exactly equal,
    each is paired with the least key of these copies, which stands for them in pairs with other texts: every link between
    different texts stays, and the result doesn't grow with the square of the copies. Classes of more than `block` keys
    are joined block by block, so no task makes all the pairs of a hot class.
    """
    size = members.groupBy("class").agg(F.count("*").alias("n"))
    linked = links.select(F.explode(F.array("a", "b")).alias("class")).distinct().withColumn("linked", F.lit(True))
    size = size.join(linked, "class", "left").filter((F.col("n") > 1) | F.col("linked")).select("class", "n")
    m = materialise(members.join(size, "class"))
    large = m.filter(F.col("n") > min(copies, block))
    large = large.join(large.groupBy("class", "copy").agg(F.count("*").alias("equal"), F.min("key").alias("first")), ["class", "copy"])
    star = large.filter((F.col("equal") > copies) & (F.col("key") != F.col("first"))).select(F.col("first").alias("ka"), F.col("key").alias("kb"))
    kept = large.filter((F.col("equal") <= copies) | (F.col("key") == F.col("first"))).select("key", "class")
    hot = kept.groupBy("class").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1")
    one = F.lit(0)
    split = kept.join(hot, "class", "left").select("key", "class", F.coalesce(F.pmod(F.xxhash64("key"), "blocks").cast("int"), one).alias("block"))
    full = m.filter(F.col("n") <= min(copies, block)).select("key", "class", one.alias("block")).unionByName(split)
    edges = links.select("a", "b").unionByName(m.filter("n > 1").select(F.col("class").alias("a"), F.col("class").alias("b")).distinct())
    for end, at in (("a", "i"), ("b", "j")):
        last = F.coalesce(F.col("blocks") - 1, one)
        edges = edges.join(hot.withColumnRenamed("class", end), end, "left").withColumn(at, F.explode(F.sequence(one, last))).drop("blocks")
    edges = edges.filter((F.col("a") != F.col("b")) | (F.col("i") <= F.col("j")))
    x = full.select(F.col("key").alias("ka"), F.col("class").alias("a"), F.col("block").alias("i"))
    y = full.select(F.col("key").alias("kb"), F.col("class").alias("b"), F.col("block").alias("j"))
    pairs = edges.join(x, ["a", "i"]).join(y, ["b", "j"]).filter((F.col("a") != F.col("b")) | (F.col("i") != F.col("j")) | (F.col("ka") < F.col("kb")))
    out = pairs.select("ka", "kb").unionByName(star).filter("ka != kb")
    return out.select(F.least("ka", "kb").alias(names[0]), F.greatest("ka", "kb").alias(names[1])).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(class, group): the least class reachable over links. Classes without a link don't occur.

    Least labels go to neighbours, then each label takes its label's label, so chains shrink as fast as
    they halve. Each round is checkpointed; edges and labels stay distributed.
    """
    edges = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")))
    labels = materialise(edges.groupBy(F.col("u").alias("class")).agg(F.least(F.min("v"), F.min("u")).alias("group")))
    for _ in range(most_rounds):
        near = edges.join(labels, edges.v == labels["class"]).groupBy("u").agg(F.min("group").alias("least"))
        step = labels.join(near, labels["class"] == near.u).select("class", F.col("group").alias("was"), F.least("group", "least").alias("group"))
        up = step.select(F.col("class").alias("up"), F.col("group").alias("top"))
        new = materialise(step.join(up, step["group"] == up.up, "left").select("class", "was", F.least("group", F.coalesce("top", "group")).alias("group")))
        labels = new.select("class", "group")
        if new.filter(F.col("was") != F.col("group")).isEmpty():
            return labels
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def near_duplicate_groups(df: DataFrame, key: str = "chunk_id", text: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, class, group, n_links): one row per key with enough words.

    n_links counts linked classes of other texts; copies share a class and are not expanded into pairs.
    """
    links, members = links_and_members(df, key, text, threshold, min_words, with_copy=False)
    links = materialise(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    out = members.join(components(links), "class", "left").join(degree, "class", "left")
    return out.select(F.col("key").alias(key), "class", F.coalesce("group", "class").alias("group"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
