"""Encoding of whole corpora with a public byte-level BPE vocabulary by merge replay.

The slice of the corpus a task holds is encoded as one: its distinct words are laid end to end, an
inverted index maps every token pair to the positions where it occurs, and the merges present are
applied in rank order; each merge touches its occurrences and their two neighbours only. Words
already replayed stay in the worker's table, so a word costs merges once however often it occurs.
No shuffle and no broadcast is needed: the vocabulary is read by path on each worker.

Defined cases: a null or empty text gives an empty list; texts may be of any length (no prefix is
taken); repeated documents are encoded alike; the special token's string in a text is ordinary text;
an empty table gives an empty table; further columns of the input are left out of the result.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words, and characters of words, a worker keeps before it starts its table anew; only speed depends on them.
TABLE_WORDS, TABLE_CHARS = 400_000, 20_000_000

_VOCABULARIES: dict[str, "Vocabulary"] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return letters


class Vocabulary:
    """Byte ids and merges: (left id, right id) -> (rank, id of the merged token)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        letters = _byte_letters()
        self.byte_ids = [ids[letters[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])

    @staticmethod
    def at(path: str) -> "Vocabulary":
        if path not in _VOCABULARIES:
            _VOCABULARIES[path] = Vocabulary(path)
        return _VOCABULARIES[path]


def replay(words: list[str], vocabulary: Vocabulary) -> list[list[int]]:
    """Token ids of each word: every merge in rank order over all words together."""
    byte_ids, merges = vocabulary.byte_ids, vocabulary.merges
    sym: list[int] = [-1]
    starts: list[int] = []
    for w in words:
        starts.append(len(sym))
        sym.extend([byte_ids[b] for b in w.encode("utf-8", "surrogatepass")])
        sym.append(-1)  # a wall between words: no pair spans it
    n = len(sym)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    index: dict[tuple[int, int], list[int]] = {}
    for i in range(1, n - 1):
        a, b = sym[i], sym[i + 1]
        if a >= 0 <= b:
            if (a, b) in index:
                index[a, b].append(i)
            elif (a, b) in merges:
                index[a, b] = [i]
    heap = [(merges[p][0], p) for p in index]
    heapq.heapify(heap)
    while heap:
        _, pair = heapq.heappop(heap)
        left, right = pair
        new = merges[pair][1]
        # Positions were added by different merges; from left to right an overlap goes to the left one.
        for i in sorted(index.pop(pair)):
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue  # a merge before this one used it up
            sym[i], sym[j] = new, -2
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if sym[k] >= 0 and (p := (new, sym[k])) in merges:
                    if p in index:
                        index[p].append(i)
                    else:
                        index[p] = [i]
                        heapq.heappush(heap, (merges[p][0], p))
            h = before[i]
            if h >= 0 and sym[h] >= 0 and (p := (sym[h], new)) in merges:
                if p in index:
                    index[p].append(h)
                else:
                    index[p] = [h]
                    heapq.heappush(heap, (merges[p][0], p))
    ends = [*starts[1:], n]
    return [[s for s in sym[a : b - 1] if s >= 0] for a, b in zip(starts, ends)]


class Encoder:
    """Encodes batches of texts; keeps a table of the words met so far."""

    def __init__(self, path: str, table_words: int = TABLE_WORDS):
        import regex

        self.vocabulary = Vocabulary.at(path)
        self.split = regex.compile(PATTERN).findall
        self.table_words = table_words
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        ids = replay(words, self.vocabulary)
        self.chars += sum(map(len, words))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.flat) + np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(ids) else lengths
        base = len(self.starts)
        self.number.update(zip(words, range(base, base + len(words))))
        self.starts = np.concatenate([self.starts, at.astype(np.int64)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum()))])

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts, and how many words each text has."""
        if len(self.number) > self.table_words or self.chars > TABLE_CHARS:
            self._clear()
        split = [self.split(t) if t else [] for t in texts]
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        number = self.number
        fresh = list(dict.fromkeys(w for ws in split for w in ws if w not in number))
        if fresh:
            self._learn(fresh)
        get = number.__getitem__
        return np.fromiter((i for ws in split for i in map(get, ws)), np.int64, int(per_text.sum())), per_text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and offsets by text."""
        words, per_text = self.words(texts)
        lengths = self.lengths[words]
        total = np.concatenate([[0], np.cumsum(lengths)])
        shift = np.repeat(self.starts[words] - total[:-1], lengths)
        ids = self.flat[shift + np.arange(total[-1])] if len(words) else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(per_text)])
        return ids, total[ends]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        words, per_text = self.words(texts)
        total = np.concatenate([[0], np.cumsum(self.lengths[words])])
        return np.diff(total[np.concatenate([[0], np.cumsum(per_text)])])


def _slices(batch: pa.RecordBatch, chars: int = 4_000_000) -> Iterator[tuple[pa.Array, list]]:
    """Parts of a batch of bounded text size (a single longer text is a part of its own)."""
    keys, texts = batch.column(0), batch.column(1).to_pylist()
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > chars and i > a:
            yield keys.slice(a, i - a), texts[a:i]
            a, size = i, len(t or "")
    if a < len(texts):
        yield keys.slice(a), texts[a:]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """encode_texts with one replay for the words of the whole corpus; keys must be unique.

    Distinct words are gathered from all texts and hashed to tasks, each of which replays its words together; their ids are
    joined to the places where the words stand. This shuffles every text's words, which encode_texts doesn't.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(PATTERN).findall
        for batch in batches:
            row, words, at = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                where: dict[str, list[int]] = {}
                for n, w in enumerate(split(t) if t else ()):
                    where.setdefault(w, []).append(n)
                row += [i] * len(where)
                words += where.keys()
                at += where.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(words, pa.string()), pa.array(at, pa.list_(pa.int32()))], names=["key", "word", "places"])

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replay(words, Vocabulary.at(vocabulary)), pa.list_(pa.int32()))], names=["word", "ids"])

    found = materialise(spread(rows).mapInArrow(places, f"key {kind}, word string, places array<int>"))
    ids = found.select("word").distinct().mapInArrow(replayed, "word string, ids array<int>")
    parts = found.join(ids, "word").select("key", F.explode("places").alias("place"), "ids").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "ids"))).alias("parts"))
    whole = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return rows.select("key").join(parts, "key", "left").select(F.col("key").alias(key), F.coalesce(whole, F.array().cast("array<int>")).alias("ids"))


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>): one row per row of df. See the module for defined cases."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for keys, texts in _slices(batch):
                ids, ends = encoder.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, lists], names=["key", "ids"])

    out = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return spread(out).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry..., n_tokens BIGINT): one row per row of df, by the same replay as encode_texts."""
    fields = [key, *carry]
    kinds = [df.schema[c].dataType.simpleString() for c in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(batch.num_columns - 1)], names=["i", "text"])
            counts = [encoder.count(texts) for _, texts in _slices(whole)]
            n = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*(f"c{i}" for i in range(len(fields))), "n_tokens"])

    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(fields)]
    out = df.select(*cols, F.col(f"`{text}`").alias("text"))
    out = spread(out).mapInArrow(run, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)) + ", n_tokens bigint")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(fields)), "n_tokens")


def vocabulary_path() -> str:
    """Where the vocabulary lies; QUERN_VOCABULARY names another place."""
    return os.environ.get("QUERN_VOCABULARY", DEFAULT_VOCABULARY)
