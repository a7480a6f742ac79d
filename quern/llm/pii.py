"""Personal information in free text, found by a linear-chain conditional random field.

The model is trained on the driver from the small labelled table of pii_table.py (a second or so of
numpy) and shipped to the tasks with the code. Features of a position are those of the tokens within
three places of it: the word (digits by length), its shape, its beginning and end, and the gap before.
So a token adds fixed scores at each distance, looked up once per distinct token; decoding is Viterbi
over batches of texts padded to like lengths. What it finds is checked exactly afterwards: an email
has a sign for "at", a phone number seven digits, an address a number and a word, a name a word.

One scan, no shuffle; whole texts are read. Defined cases: null, empty and blank texts have no items
and come out as they are; rows delivered twice give the same items; a text of any length is decoded
whole; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .encode import vocabulary_path
from .pii_table import FAMILY, FIRST, KINDS, labelled_texts

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: Distances of the tokens whose features count.
REACH = (-3, -2, -1, 0, 1, 2, 3)
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
TABLE_TOKENS = 300_000
#: Tokens decoded side by side, rows times length; bounds memory.
CELLS = 1_000_000
#: Texts of the table that must hold a feature.
LEAST_TEXTS = 8
_TOKEN = re.compile(r"\s*(?:[^\W_]+|[^\w\s]|_)")
_NEG = np.float32(-1e4)
_TITLES = frozenset("mr mrs ms miss dr prof herr herrn frau monsieur madame mme señor señora sr sra sir".split())
_NAMES = frozenset(x.lower() for x in (*FIRST, *FAMILY))
#: Every other name of the table is known as one; from the rest the model learns what names that no list has look like.
_FIRST, _FAMILY = frozenset(x.lower() for x in FIRST[::2]), frozenset(x.lower() for x in FAMILY[::2])


@lru_cache(2)
def common_words(path: str) -> frozenset[str]:
    """Whole words of a public vocabulary, as it writes them; none where there is no such file."""
    if not os.path.exists(path):
        return frozenset()
    with open(path, encoding="utf-8") as f:
        return frozenset(t[1:] for t in json.load(f)["model"]["vocab"] if t[:1] == "Ġ" and t[1:].isalpha())


def attributes(token: str, common: frozenset[str] = frozenset()) -> list[str]:
    """Features of a token with the white space before it. common: words of a public vocabulary."""
    word = token.lstrip()
    gap = token[: len(token) - len(word)]
    gap = "g:" + ("" if not gap else "n" if "\n" in gap else "s")
    low = word.lower()
    if word.isdigit():
        return [gap, f"d:{len(word)}", f"p:{word[:2] if len(word) <= 5 else word[:1]}:{len(word)}", "c:d", f"w:{word}" if len(word) <= 2 else "w:d"]
    if not word[0].isalnum():
        return [gap, f"w:{word}", "c:p"]
    shape = re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", lambda m: "X" if len(m[0]) == 1 and m[0].isupper() else "XX" if m[0].isupper() else "Xx" if m[0][0].isupper() else "x", word))
    known = ["fn"] * (low in _FIRST) + ["ln"] * (low in _FAMILY) + ["title"] * (low in _TITLES)
    if common and word.isalpha():
        seen = "word" if low in common else "name" if low.capitalize() in common else "new"
        known += [f"v:{seen}", f"vc:{seen}:{shape}"]
    known += [] if low in _NAMES else [f"w:{low}"]
    return [*known, gap, f"c:{shape}", f"e3:{low[-3:]}", f"e4:{low[-4:]}" if len(low) > 4 else f"l:{len(low)}", f"b2:{low[:2]}", f"cx:{shape}:{min(len(low), 5)}", f"ce:{shape}:{low[-2:]}"]


_CLASSES = [
    *(f"{shape}:{seen}" for shape in ("X", "Xx", "XX", "x") for seen in ("fn", "ln", "word", "name", "new")), "title", *(f"d{n}" for n in range(1, 7)), "mixed", *(f"p{c}" for c in ",.;:'’-()<>@=/|_+*#"), "p",
]
_CLASS_NO = {c: i for i, c in enumerate(_CLASSES)}
#: Classes, each also behind a line end.
PAIRS = 2 * len(_CLASSES)


def token_class(token: str, common: frozenset[str]) -> int:
    """A coarse class of a token; pairs of neighbouring classes are features."""
    word = token.lstrip()
    low = word.lower()
    if low in _TITLES:
        name = "title"
    elif word.isdigit():
        name = f"d{min(len(word), 6)}"
    elif not word[0].isalnum():
        name = f"p{word}" if f"p{word}" in _CLASS_NO else "p"
    elif not word.isalpha():
        name = "mixed"
    else:
        shape = "x" if word[0].islower() else "X" if len(word) == 1 else "XX" if word.isupper() else "Xx"
        seen = "fn" if low in _FIRST else "ln" if low in _FAMILY else "word" if low in common else "name" if low.capitalize() in common else "new"
        name = f"{shape}:{seen}"
    return 2 * _CLASS_NO[name] + ("\n" in token[: len(token) - len(word)])


class Model:
    """Weights by (distance, feature, label) and by (place, pair of classes, label), transitions between labels, and the decoder."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, transitions: np.ndarray, first: np.ndarray, pairs: np.ndarray, vocabulary: str):
        self.vocabulary, self.pairs = vocabulary, pairs.astype(np.float32)
        self.features, self.weights, self.transitions, self.first = features, weights.astype(np.float32), transitions.astype(np.float32), first.astype(np.float32)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((1024, len(REACH), len(LABELS)), np.float32)
        self.sizes = np.zeros(1024, np.int64)
        self.gaps = np.zeros(1024, np.int64)
        self.kinds = np.zeros(1024, np.int64)

    def __getstate__(self):
        return (self.features, self.weights, self.transitions, self.first, self.pairs, self.vocabulary)

    def __setstate__(self, state):
        self.__init__(*state)

    def _learn(self, tokens: list[str]) -> None:
        while len(self.number) + len(tokens) > len(self.sizes):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.gaps = np.concatenate([self.gaps, np.zeros_like(self.gaps)])
            self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
        get, common = self.features.get, common_words(self.vocabulary)
        for t in tokens:
            i = len(self.number)
            self.number[t] = i
            at = [f for a in attributes(t, common) if (f := get(a)) is not None]
            if at:
                self.scores[i] = self.weights[:, at].sum(1)
            self.kinds[i] = token_class(t, common)
            self.sizes[i], self.gaps[i] = len(t), len(t) - len(t.lstrip())

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token numbers one text after the other, tokens by text)."""
        if len(self.number) > TABLE_TOKENS:
            self._clear()
        split = [_TOKEN.findall(t) for t in texts]
        number = self.number
        fresh = list(dict.fromkeys(t for s in split for t in s if t not in number))
        if fresh:
            self._learn(fresh)
        get = number.__getitem__
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter((i for s in split for i in map(get, s)), np.int64, int(lengths.sum())), lengths

    def emissions(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = self.scores[ids, REACH.index(0)]
        ends = np.repeat(np.cumsum(lengths), lengths)
        starts = ends - np.repeat(lengths, lengths)
        at = np.arange(len(ids))
        for k, d in enumerate(REACH):
            if d == 0:
                continue
            ok = (at + d >= starts) & (at + d < ends)
            out[ok] += self.scores[ids[at[ok] + d], k]
        if len(ids) > 1:
            kinds = self.kinds[ids]
            both = at[1:] > starts[1:]  # a pair within one text
            code = kinds[:-1][both] * PAIRS + kinds[1:][both]
            left = np.nonzero(both)[0]
            out[left] += self.pairs[0][code]
            out[left + 1] += self.pairs[1][code]
        return out

    def decode(self, emit: np.ndarray, lengths: np.ndarray, cells: int = CELLS) -> np.ndarray:
        """Most likely labels by Viterbi, over blocks of texts of like length and of bounded size (one longer text is a block)."""
        out = np.zeros(len(emit), np.int8)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        n = len(LABELS)
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and b - a < 600 and (b - a + 1) * lengths[order[b]] <= cells:
                b += 1
            part = order[a:b][::-1]  # longest first, so rows drop out at the end
            size, start = lengths[part], starts[part]
            longest = int(size[0])
            back = np.zeros((longest, len(part), n), np.int8)
            score = emit[start] + self.first
            last = score.copy()
            for t in range(1, longest):
                live = int(np.searchsorted(-size, -t, "left"))  # rows with a token at t
                step = score[:live, :, None] + self.transitions
                best = step.argmax(1)
                score = np.take_along_axis(step, best[:, None, :], 1)[:, 0] + emit[start[:live] + t]
                back[t, :live] = best
                last[:live] = score
            label = last.argmax(1)
            for t in range(longest - 1, -1, -1):
                live = int(np.searchsorted(-size, -t, "left"))
                out[start[:live] + t] = label[:live]
                if t:
                    label[:live] = back[t, np.arange(live), label[:live]]
            a = b
        return out

    def items(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of what each text holds, checked."""
        ids, lengths = self.tokens(texts)
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(ids):
            return found
        labels = self.decode(self.emissions(ids, lengths), lengths)
        ends = np.cumsum(self.sizes[ids])
        base = np.concatenate([[0], ends])[np.cumsum(lengths) - lengths]
        own = np.repeat(np.arange(len(texts)), lengths)
        begin = ends - self.sizes[ids] + self.gaps[ids] - base[own]
        stop = ends - base[own]
        hit = np.nonzero(labels)[0]
        open_: list | None = None
        for i in hit.tolist():
            label = int(labels[i])
            kind, inside = KINDS[(label - 1) // 2], label % 2 == 0
            if open_ and inside and open_[3] == kind and open_[4] == i - 1 and open_[0] == own[i]:
                open_[2], open_[4] = int(stop[i]), i
                continue
            if open_:
                _close(open_, texts, found)
            open_ = [int(own[i]), int(begin[i]), int(stop[i]), kind, i]
        if open_:
            _close(open_, texts, found)
        return found


_AT = re.compile(r"@|[(\[]\s*at\s*[)\]]|\sat\s\S+\sdot\s", re.I)


def _close(item: list, texts: list[str], found: list) -> None:
    row, a, b, kind, _ = item
    if kind == "email":  # an address begins where its run of letters and signs does
        whole = texts[row]
        while a > 0 and (whole[a - 1].isalnum() or whole[a - 1] in "._+-") and (not found[row] or found[row][-1][1] < a):
            a -= 1
    text = texts[row][a:b]
    digits = sum(c.isdigit() for c in text)
    ok = {
        "email": bool(_AT.search(text)) and bool(re.search(r"\.|dot", text, re.I)) and "\n" not in text,
        "phone": digits >= 7,
        "id_number": digits >= 6,
        "address": digits >= 1 and bool(re.search(r"[^\W\d_]{3,}", text)),
        "person": bool(re.search(r"[^\W\d_]{3,}", text)) and digits == 0,
    }[kind]
    if ok:
        found[row].append((a, b, kind))


def _training(seed: int) -> tuple[list[list[str]], list[list[int]]]:
    xs, ys = [], []
    for pieces in labelled_texts(seed=seed):
        text = "".join(p for p, _ in pieces)
        spans, at = [], 0
        for p, kind in pieces:
            if kind:
                spans.append((at, at + len(p), kind))
            at += len(p)
        tokens, labels, at = [], [], 0
        for t in _TOKEN.findall(text):
            end = at + len(t)
            begin = end - len(t.lstrip())
            label = 0
            for a, b, kind in spans:
                if a <= begin < b:
                    label = 1 + 2 * KINDS.index(kind) + (begin > a)
            tokens.append(t)
            labels.append(label)
            at = end
        xs.append(tokens)
        ys.append(labels)
    return xs, ys


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train(vocabulary: str, seed: int = 11, epochs: int = 5, rate: float = 0.35, decay: float = 3e-4, batch: int = 48) -> Model:
    """Maximum likelihood by AdaGrad; expectations by forward-backward over padded batches."""
    xs, ys = _training(seed)
    common = common_words(vocabulary)
    # Features of few tokens are left out, so a made-up word is as new in training as any new word is later.
    often: dict[str, int] = {}
    for x in xs:
        for f in {f for t in x for f in attributes(t, common)}:
            often[f] = often.get(f, 0) + 1
    kinds: dict[str, int] = {}
    token_no: dict[str, int] = {}
    token_features: list[list[int]] = []
    for x in xs:
        for t in x:
            if t not in token_no:
                token_no[t] = len(token_no)
                token_features.append([kinds.setdefault(a, len(kinds)) for a in attributes(t, common) if often[a] >= LEAST_TEXTS])
    width = max(map(len, token_features))
    pad = len(kinds)
    table = np.full((len(token_features) + 1, width), pad, np.int64)
    for i, f in enumerate(token_features):
        table[i, : len(f)] = f
    # What a word is counts beside an item only, what it ends in counts within it; farther off its shape is all that counts.
    near = {"w:": 1, "e3": 0, "e4": 0, "b2": 0, "ce": 0}
    reach = np.array([9 if a[2:3] and not a[2].isalnum() else near.get(a[:2], 9) for a in kinds] + [9])
    allowed = (np.abs(np.array(REACH))[:, None] <= reach[None, :]).ravel()[:, None]
    none = len(token_features)  # the token beyond the ends of a text
    n, d = len(LABELS), len(REACH)
    classes = np.array([*(token_class(t, common) for t in token_no), 0])
    base, none_pair = d * (pad + 1), 2 * PAIRS * PAIRS
    allowed = np.concatenate([allowed, np.ones((none_pair + 1, 1), bool)])
    allowed[base + none_pair] = False
    w = np.zeros((base + none_pair + 1, n))
    trans, first = np.zeros((n, n)), np.zeros(n)
    gw, gt, gf = np.full_like(w, 1e-3), np.full_like(trans, 1e-3), np.full_like(first, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for a in range(0, len(order), batch):
            part = sorted(order[a : a + batch].tolist(), key=lambda i: -len(xs[i]))
            size = np.array([len(xs[i]) for i in part])
            rows, longest = len(part), int(size[0])
            ids = np.full((rows, longest + 6), none)
            gold = np.zeros((rows, longest), np.int64)
            for r, i in enumerate(part):
                ids[r, 3 : 3 + len(xs[i])] = [token_no[t] for t in xs[i]]
                gold[r, : len(xs[i])] = ys[i]
            mask = np.arange(longest)[None, :] < size[:, None]
            feats = np.concatenate([table[ids[:, 3 + o : 3 + o + longest]] + k * (pad + 1) for k, o in enumerate(REACH)], 2)
            c = classes[ids]
            inner = ids != none
            code = np.where(inner[:, :-1] & inner[:, 1:], c[:, :-1] * PAIRS + c[:, 1:], -1)
            right, left = code[:, 3 : 3 + longest], code[:, 2 : 2 + longest]
            pairs = np.stack([np.where(right < 0, none_pair, right), np.where(left < 0, none_pair, PAIRS * PAIRS + left)], 2) + base
            f = np.concatenate([feats, pairs], 2)[mask]
            emit = np.zeros((rows, longest, n))
            emit[mask] = w[f].sum(1)
            alpha = np.zeros((rows, longest, n))
            alpha[:, 0] = emit[:, 0] + first
            for t in range(1, longest):
                live = int((size > t).sum())
                alpha[:live, t] = _logsumexp(alpha[:live, t - 1, :, None] + trans, 1) + emit[:live, t]
            beta = np.zeros((rows, longest, n))
            for t in range(longest - 2, -1, -1):
                live = int((size > t + 1).sum())
                beta[:live, t] = _logsumexp(trans + (emit[:live, t + 1] + beta[:live, t + 1])[:, None, :], 2)
            logz = _logsumexp(alpha[np.arange(rows), size - 1], 1)
            node = np.exp(alpha + beta - logz[:, None, None])
            node[np.arange(rows)[:, None], np.arange(longest)[None, :], gold] -= 1
            pair_mask = mask[:, 1:]
            pair = np.exp(alpha[:, :-1, :, None] + trans + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - logz[:, None, None, None])[pair_mask].sum(0) if longest > 1 else np.zeros((n, n))
            if longest > 1:
                np.subtract.at(pair, (gold[:, :-1][pair_mask], gold[:, 1:][pair_mask]), 1)
            grad_first = node[:, 0].sum(0)
            g = node[mask]
            used, inverse = np.unique(f, return_inverse=True)
            flat = inverse.reshape(f.shape)
            grad = np.stack([np.bincount(flat.ravel(), np.repeat(g[:, j], f.shape[1]), len(used)) for j in range(n)], 1) / rows + decay * w[used]
            gw[used] += grad * grad
            w[used] -= allowed[used] * rate * grad / np.sqrt(gw[used])
            w[np.arange(d) * (pad + 1) + pad] = 0
            pair, grad_first = pair / rows, grad_first / rows
            gt += pair * pair
            trans -= rate * pair / np.sqrt(gt)
            gf += grad_first**2
            first -= rate * grad_first / np.sqrt(gf)
    # An inside label follows its own kind only.
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            kind = label[2:]
            for i, before in enumerate(LABELS):
                if before[2:] != kind:
                    trans[i, j] = _NEG
            first[j] = _NEG
    return Model(kinds, w[:base].reshape(d, pad + 1, n)[:, :pad], trans, first, w[base : base + none_pair].reshape(2, -1, n), vocabulary)


@lru_cache(2)
def _trained(vocabulary: str, seed: int) -> Model:
    return train(vocabulary, seed)


def default_model(seed: int = 11) -> Model:
    return _trained(vocabulary_path(), seed)


def redact(text: str, items: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in items:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


def _texts(batch: pa.RecordBatch, chars: int = 3_000_000) -> Iterator[tuple[pa.Array, list[str]]]:
    texts = batch.column(1).to_pylist()
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > chars:
            yield batch.column(0).slice(a, i - a), [x or "" for x in texts[a:i]]
            a, size = i, 0
        size += len(t or "")
    yield batch.column(0).slice(a), [x or "" for x in texts[a:]]


def find_items(df: DataFrame, key: str = "chunk_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, start_at BIGINT, end_at BIGINT, kind): one row per item of each row of df."""
    model = model or default_model()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _texts(batch):
                found = model.items(texts)
                row = pa.array(np.repeat(np.arange(len(texts)), [len(f) for f in found]), pa.int64())
                flat = [x for f in found for x in f]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(row), pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.string())],
                    names=["key", "start_at", "end_at", "kind"],
                )

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter(F.length("text") > 0)
    return spread(rows).mapInArrow(run, f"key {kind}, start_at bigint, end_at bigint, kind string").withColumnRenamed("key", key)


def redact_texts(df: DataFrame, key: str = "chunk_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, text, n_items INT): each text with its items replaced by typed placeholders, the rest unchanged."""
    model = model or default_model()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            at = 0
            for keys, texts in _texts(batch):
                found = model.items(texts)
                out = [None if raw[at + i] is None else redact(t, f) for i, (t, f) in enumerate(zip(texts, found))]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.string()), pa.array([len(f) for f in found], pa.int32())], names=["key", "text", "n_items"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return spread(rows).mapInArrow(run, f"key {kind}, text string, n_items int").withColumnRenamed("key", key)
