"""Keyword-stuffed and link-list pages, found by the shapes of their lines.

Every line is reduced to a shape: what it is made of (links, tags, items between separators, a bare
label, data, a sentence), its number of words and items in powers of two, its share of capitalised
words and its separator. A sentence's shape also holds the part of its words that the page repeats far
too often for prose. A date ahead of a line is put aside, and a fence counts only where it is closed.
Lines are grouped by shape; shapes that are no sentence and hold no data, and sentences of repeated
words, collect the characters of their lines. A page is flagged if more than half of its characters lie
in such shapes. Pages of one template share their main shapes; `shape_groups` counts pages by these
over the whole corpus.

A page is judged by itself, so flagging is one scan without shuffle, whatever the number of pages.
Defined cases: null, empty and blank texts are no spam; copies get the same verdict; whole texts are
read; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: A page is spam if its share of non-sentence shapes is above this.
SHARE = 0.5
#: Words of up to three letters that every page repeats.
_FUNCTION = frozenset(
    "a an and are as at be but by can did do for had has he her him his how i if in is it its may me my no nor not now of off on one or our out own per she so the to too two up us was we who why yes you all any "
    "ab als am an auf aus bei bis da das dem den der des die du ein er es für hat ich ihr im in ist man mit nur ob sei sie so um und uns vom von vor war was wer wie wir zu zum zur "
    "au aux ce ces de des du elle en est et eux il ils je la le les lui ma mes moi ne nos on ou où par pas peu qui que sa se ses si son sur te toi tu un une "
    "al con de del el en era eso fue ha han hay la las le les lo los me mi más muy ni no o os por que se sea ser si sin son su sus te tu un una y ya".split()
)

_URL = r"(?:https?://|www\.)[^\s<>()\[\]\"']+"
_LINK = re.compile(rf"<a\b[^>]*>.*?</a>|\[[^\]\n]*\]\(\s*{_URL}\s*\)|{_URL}", re.I)
_TAG = re.compile(r"(?<!\S)#[^\s#,;|]+|\[[^\]\n]{1,60}\]")
_DATE = re.compile(r"^\W{0,2}(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|[A-Z][a-z]{2}\s{1,2}\d{1,2} \d\d:\d\d)")
_TRACE = re.compile(r"^\s*(?:at\s+\S+\(|File \"|Traceback|Caused by|\w+(?:Error|Exception)\b)")
_PAIR = re.compile(r"\w[\w .]{0,30}=\S*")
_CODE = re.compile(r"(?:^|\s)--?\w+[ =]|\w\(.*\)\s*[;{]|^\s*(?:def|class|import|return|for|if|while|SELECT|\$|>>>)\b.*[(:;]|[{};]\s*$")
_WORD = re.compile(r"[^\W_]+(?:['’_-][^\W_]+)*")
_END = re.compile(r"[.!?…]['\"”’)\]]*\s*$")
_SENTENCE = re.compile(r"(?<=[.!?…])['\"”’)\]]*\s+(?=\S)")
_SEPARATORS = (" | ", " / ", " » ", " • ", " · ", " > ", " :: ", "; ", ", ", " - ", " – ", " — ", " * ", " ~ ", "\t")
_DEFINITION = re.compile(r"^\W{0,4}[^:–—=]{2,60}(?::| [–—-]| =)\s+\S")


def _bucket(n: int) -> int:
    return n.bit_length()


def _items(line: str) -> tuple[str, list[str]]:
    counts = [line.count(s) for s in _SEPARATORS]
    most = max(counts)
    if most < 4:
        return "", [line]
    sep = _SEPARATORS[counts.index(most)]
    return sep, [x for x in line.split(sep) if x.strip()]


def _is_list(line: str) -> tuple[str, int]:
    """The separator and number of items if the line is a list of short items and no sentence, else 0 items."""
    sep, items = _items(line)
    if len(items) < 5:
        return sep, 0
    sizes = [len(x.split()) for x in items]
    long = sum(n > 6 for n in sizes)
    if sum(sizes) / len(sizes) > 4 or long > 0.15 * len(sizes):
        return sep, 0
    return sep, len(items)


def line_shape(line: str, in_code: bool) -> tuple[str, tuple, int]:
    """(kind, shape, characters) of a line. Kinds: data, info, text, link, tag, list, label."""
    size = len(line.strip())
    if in_code or _TRACE.match(line):
        return "data", ("data",), size
    if dated := _DATE.match(line):  # an entry of a log, unless what follows the date is links, tags or a list
        kind, shape, _ = line_shape(line[dated.end() :], False)
        return (kind, ("dated", *shape), size) if kind in ("link", "tag", "list") else ("data", ("data",), size)
    # Cheap tests come first: most lines hold no link, pair or tag at all.
    links = _LINK.findall(line) if "://" in line or "www." in line.lower() or "<a" in line.lower() else ()
    if links:
        rest = _LINK.sub(" ", line)
        words = _WORD.findall(rest)
        if len(words) <= 4 * len(links) and not (_END.search(rest.strip(" ()")) and len(words) >= 5):
            return "link", ("link", _bucket(len(links)), _bucket(len(words))), size
        line = rest
    pairs = _PAIR.findall(line) if "=" in line else ()
    if len(pairs) >= 2 and sum(map(len, pairs)) >= 0.5 * size:
        return "data", ("data",), size
    words = _WORD.findall(line)
    capital = round(4 * sum([w[0].isupper() for w in words]) / max(1, len(words)))
    tags = _TAG.findall(line) if "#" in line or "[" in line else ()
    if tags and (len(tags) >= 3 or len(words) <= 4 and len(tags) >= 1):
        covered = sum(map(len, tags))
        if covered >= 0.35 * size or len(tags) >= 0.4 * len(line.split()):
            return "tag", ("tag", _bucket(len(tags)), capital), size
    if len(tags) >= 2 and len(tags) >= 0.25 * len(line.split()) and not re.search(r"[.!?]\s", line):
        return "tag", ("tag", _bucket(len(tags)), capital), size
    sep, items = _is_list(line)
    if items:
        return "list", ("list", sep.strip(), _bucket(items), capital), size
    if re.match(r"^\s*#{1,6}\s", line):
        return "info", ("heading",), size
    if _CODE.search(line) and not _END.search(line):
        return "data", ("data",), size
    if len(words) <= 7 and not _END.search(line):
        if _DEFINITION.match(line):
            return "info", ("definition",), size
        return "label", ("label", len(words), capital), size
    return "text", ("text", _bucket(len(words)), capital), size


def _telling(word: str) -> bool:
    return len(word) >= 4 or len(word) >= 2 and word not in _FUNCTION and not word.isdigit()


def _keywords(sentences: list[list[str]]) -> set[str]:
    """Words far too frequent for prose: no function words, at least 7 in 100 words and once a sentence."""
    every = [w for s in sentences for w in s]
    least = max(4, 0.065 * len(every), 0.8 * len(sentences))
    return {w for w, n in Counter(every).items() if n >= least and _telling(w)}


def spam_share(text: str | None) -> tuple[float, int, dict[tuple, int]]:
    """(share of the page's characters in spam shapes, number of lines, characters by spam shape)."""
    if not text or not text.strip():
        return 0.0, 0, {}
    kinds: list[tuple[str, tuple, int, str]] = []
    in_code = False
    lines = text.split("\n")
    fences = sum(line.lstrip().startswith("```") for line in lines) // 2 * 2  # the last one of an odd number closes nothing
    for line in lines:
        if fences and line.lstrip().startswith("```"):
            in_code = not in_code
            fences -= 1
            kinds.append(("data", ("data",), len(line.strip()), ""))
        elif line.strip():
            kinds.append((*line_shape(line, in_code), line))
    total = sum(k[2] for k in kinds)
    spam: dict[tuple, int] = defaultdict(int)
    sentences: list[tuple[str, list[str]]] = []
    labels: list[tuple[tuple, int, list[str]]] = []
    for kind, shape, size, line in kinds:
        if kind in ("link", "tag", "list"):
            spam[shape] += size
        elif kind == "label":
            labels.append((shape, size, _WORD.findall(line.lower())))
        elif kind == "text":
            sentences += [(s, _WORD.findall(s.lower())) for s in _SENTENCE.split(line)]
    if len(labels) >= 6:
        # Labels are piled up if few words make up much of them; agendas, names and steps vary.
        count = Counter(w for _, _, ws in labels for w in set(ws) if _telling(w))
        often = {w for w, n in count.items() if n >= max(3, 0.08 * len(labels))}
        same = Counter("".join(ws).replace("_", "").replace("-", "") for _, _, ws in labels)
        again = sum(n for n in same.values() if n > 1)
        piled = max(again, sum(any(w in often for w in ws) for _, _, ws in labels)) >= 0.15 * len(labels)
        for shape, size, ws in labels:
            if piled or any(w in often for w in ws):
                spam[shape] += size
    keywords = _keywords([ws for _, ws in sentences])
    for s, ws in sentences if keywords else ():
        hits = sum([w in keywords for w in ws])
        if hits >= 0.12 * len(ws) and hits:
            spam["stuffed", _bucket(len(ws)), round(4 * hits / len(ws))] += len(s)
    held = sum(spam.values())
    return held / max(1, total), len(kinds), dict(spam)


def is_spam(text: str | None, share: float = SHARE) -> bool:
    return spam_share(text)[0] > share


def main_shapes(shapes: dict[tuple, int], most: int = 3) -> str:
    """The shapes that hold most of the page's spam characters, in order."""
    return " ".join(":".join(map(str, s)) for s, _ in sorted(shapes.items(), key=lambda x: (-x[1], x[0]))[:most])


def spam_pages(df: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(key, spam_share DOUBLE, n_lines INT, is_spam BOOLEAN, shapes STRING), one row per row of df."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = [spam_share(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[0] > share for g in got], pa.bool_()), pa.array([main_shapes(g[2]) for g in got], pa.string())],
                names=["key", "spam_share", "n_lines", "is_spam", "shapes"],
            )

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return spread(rows).mapInArrow(run, f"key {kind}, spam_share double, n_lines int, is_spam boolean, shapes string").withColumnRenamed("key", key)


def shape_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(shapes, n_pages, n_spam, spam_share DOUBLE): pages with the same main shapes; those of one template come together."""
    pages = spam_pages(df, key, text).filter("shapes <> ''")
    return pages.groupBy("shapes").agg(F.count("*").alias("n_pages"), F.count_if("is_spam").alias("n_spam"), F.round(F.avg("spam_share"), 6).alias("spam_share"))
