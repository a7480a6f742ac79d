"""Splitting of oversized texts at natural boundaries, with overlap.

Boundary positions of a text (ends of paragraphs or log entries, of lines, of sentences; spaces and
bare positions only where a stretch has nothing better) carry a penalty each. Dynamic programming
over them picks the cuts with the least sum of penalties and size imbalance, such that every piece
with its overlap stays within the limit. Where two neighbouring units (paragraphs, or entries of a
log) each fit in the limit but not both together, the cut at the later unit's start can't be
avoided; no piece may reach over it.

Defined cases: a null text gives no piece; a text within the limit (also empty or blank) is one
piece; rows delivered more than once give the same pieces, once; a text without any boundary is cut
at the limit; the own parts of the pieces (without overlap) are the text, character for character;
an empty table gives an empty table. Characters are Unicode code points. Columns of the input other
than key and text are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

LIMIT, OVERLAP = 1600, 200
#: Penalties of a cut, by what ends there, against 1 for a piece that lacks its whole ideal size.
PENALTY = {"unit": 0.0, "line": 0.6, "sentence": 1.0, "word": 3.0, "bare": 8.0}
KINDS = list(PENALTY)
BLANK = " \t\r\n"
_BLANK_GAP = re.compile(r"\n(?:[ \t\r]*\n)+")
_DATE = re.compile(r"\[?(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|[A-Z][a-z]{2} [ \d]\d \d{2}:\d{2})")
_SENTENCE = re.compile(r"[.!?…。][\"'”’)\]]*\s+(?=\S)")
_LINE = re.compile(r"\n\s*(?=\S)")
_SPACE = re.compile(r"\s+(?=\S)")


def units(text: str) -> list[tuple[int, int]]:
    """(first non-blank, end after the last non-blank) of each paragraph, or of each entry of a log."""
    first = re.search(r"[^ \t\r\n]", text)
    if not first:
        return []
    line_start = text.rfind("\n", 0, first.start()) + 1
    if _DATE.match(text, line_start) or _DATE.match(text, first.start()):
        starts = [line_start if _DATE.match(text, line_start) else first.start()]
        at = text.find("\n", first.start())
        while at >= 0:
            if _DATE.match(text, at + 1):
                starts.append(at + 1)
            at = text.find("\n", at + 1)
        spans = list(zip(starts, [*starts[1:], len(text)]))
    else:
        spans, at = [], 0
        for gap in _BLANK_GAP.finditer(text):
            spans.append((at, gap.start()))
            at = gap.end()
        spans.append((at, len(text)))
    out = []
    for a, b in spans:
        while b > a and text[b - 1] in BLANK:
            b -= 1
        while a < b and text[a] in BLANK:
            a += 1
        if a < b:
            out.append((a, b))
    return out


def forced_cuts(spans: list[tuple[int, int]], limit: int) -> list[int]:
    """Starts of units that fit, as the unit before does, while both together don't."""
    return [b[0] for a, b in zip(spans, spans[1:]) if b[1] - b[0] <= limit and a[1] - a[0] <= limit < b[1] - a[0]]


def boundaries(text: str, spans: list[tuple[int, int]], room: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may begin, and the index into KINDS of what ends there."""
    kind = {m.end(): 2 for m in _SENTENCE.finditer(text)}
    kind |= {m.end(): 1 for m in _LINE.finditer(text)}
    kind |= {a: 0 for a, _ in spans}
    kind.pop(0, None)
    kind.pop(len(text), None)
    known = [0, *sorted(kind), len(text)]
    for a, b in zip(known, known[1:]):
        if b - a > room // 2:
            inner = [m.end() for m in _SPACE.finditer(text, a, b) if a < m.end() < b]
            kind |= {p: 3 for p in inner}
            edges = [a, *inner, b]
            for x, y in zip(edges, edges[1:]):
                if y - x > room // 2:  # nothing to hold on to: bare positions, a quarter of the room apart
                    kind |= {p: 4 for p in range(x + room // 4, y, room // 4)}
    at = np.array(sorted(kind), np.int64)
    return at, np.array([kind[p] for p in at.tolist()], np.int64)


def plan(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, str, bool]]:
    """(start, kind of boundary, forced) of each piece."""
    n = len(text)
    if n <= limit:
        return [(0, "start", False)]
    room = limit - overlap
    spans = units(text)
    forced = forced_cuts(spans, limit)
    inner, kinds = boundaries(text, spans, room)
    at = np.concatenate([[0], inner, [n]])
    pen = np.concatenate([[0.0], np.array([PENALTY[k] for k in KINDS])[kinds], [0.0]])
    m = len(at)
    wall = np.zeros(m, np.int64)  # the last forced cut before each position, as an index
    if forced:
        f = np.searchsorted(at, np.array(forced))
        before = np.searchsorted(f, np.arange(m), side="left")
        wall = np.where(before > 0, f[np.maximum(before - 1, 0)], 0)
    pieces = max(2, -(-(n - overlap) // room))
    ideal = min(room, n / pieces)
    cost = np.full(m, np.inf)
    cost[0] = 0.0
    back = np.zeros(m, np.int64)
    low = np.searchsorted(at, at - room)
    low[at <= limit] = 0  # the first piece has no overlap
    for i in range(1, m):
        a = max(int(low[i]), int(wall[i]))
        size = at[i] - at[a:i]
        total = cost[a:i] + ((size - ideal) / ideal) ** 2
        total[(size > room) & (at[a:i] > 0)] = np.inf
        j = int(np.argmin(total)) if len(total) else 0
        if len(total):
            cost[i], back[i] = total[j] + pen[i] + 0.25, a + j  # 0.25: a cut is a cut
    cuts, i = [], m - 1
    while i > 0:
        i = int(back[i])
        cuts.append(i)
    fset = set(forced)
    return [(int(at[i]), "start" if i == 0 else KINDS[kinds[i - 1]], int(at[i]) in fset) for i in reversed(cuts)]


def _split(batches: Iterator[pa.RecordBatch], limit: int, overlap: int, cuts_only: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, index, piece, start, own, kind, must = [], [], [], [], [], [], []
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cuts = plan(t, limit, overlap)
            ends = [*(a for a, _, _ in cuts[1:]), len(t)]
            for i, ((a, what, f), b) in enumerate(zip(cuts, ends)):
                if cuts_only and not f:
                    continue
                keys.append(k)
                index.append(i)
                piece.append(None if cuts_only else t[max(0, a - overlap) if i else a : b])
                start.append(a)
                own.append(b - a)
                kind.append(what)
                must.append(f)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, batch.column(0).type), pa.array(index, pa.int32()), pa.array(piece, pa.string()), pa.array(start, pa.int64()), pa.array(own, pa.int64()), pa.array(kind, pa.string()), pa.array(must, pa.bool_())],
            names=["key", "chunk_index", "text", "start_at", "own_chars", "boundary", "unavoidable"],
        )


def split_texts(df: DataFrame, key: str = "chunk_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, cuts_only: bool = False) -> DataFrame:
    """(key, chunk_index INT, text, start_at BIGINT, own_chars BIGINT, boundary, unavoidable).

    start_at is the offset of the piece's own part (after the overlap), own_chars its size. Texts within
    the limit never leave the JVM. cuts_only gives the unavoidable cuts alone, without piece texts.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below the limit")
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())
    long = rows.filter(F.char_length("text") > limit)
    schema = f"key {kind}, chunk_index int, text string, start_at bigint, own_chars bigint, boundary string, unavoidable boolean"
    out = spread(long).mapInArrow(lambda it: _split(it, limit, overlap, cuts_only), schema)
    if not cuts_only:
        short = rows.filter(F.char_length("text") <= limit).select(
            "key", F.lit(0).alias("chunk_index"), "text", F.lit(0).cast("bigint").alias("start_at"), F.char_length("text").cast("bigint").alias("own_chars"), F.lit("start").alias("boundary"), F.lit(False).alias("unavoidable")
        )
        out = short.unionByName(out)
    # The same key has the same text, so the pieces of a second delivery are equal; one of each stays.
    return out.dropDuplicates(["key", "chunk_index"]).withColumnRenamed("key", key)
