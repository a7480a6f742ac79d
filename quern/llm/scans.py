"""Repair of text from scanned pages.

1. Words are counted over the whole corpus; skip-gram vectors are fitted to the corpus's co-occurrence
   counts of its frequent words.
2. Lines of scanned files are reduced to skeletons (digits and roman numbers to a sign, look-alike
   glyphs to one); a skeleton on many pages of a file is page furniture.
3. Words of scanned text that are not frequent are linked to corpus words which a plausible misreading
   of glyphs turns into them and which are far more frequent. The best link is chosen by frequency and
   by the fit of the vectors to the words around it.
4. A word divided at the end of a line is joined with what begins the next line of text; the hyphen
   stays if the corpus knows the word with it rather than without.
5. Furniture is dropped, words are replaced, and lines are reflowed into paragraphs.

Counts, candidates and links are tables joined by word; a file of any size is handled by aggregation
over its lines, never in one task. Only the frequent words (each at least 1 in 50,000 words of the
corpus, so 50,000 at most) and their vectors go to every task.

Defined cases: null, empty and blank texts have no faults and are repaired to themselves; rows
delivered twice count once in the results; files of other types have no faults; a file with one page
has no furniture; empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, spread
from . import skipgram

#: Plausible misreadings: what is read -> what stands there.
GLYPHS = (
    ("c", "e"), ("f", "t"), ("@", "a"), ("0", "o"), ("5", "s"), ("í", "i"), ("l", "i"), ("1", "l"), ("9", "g"), ("b", "h"), ("6", "b"), ("o", "a"),
    ("cl", "d"), ("ii", "u"), ("rn", "m"), ("ri", "n"), ("vv", "w"), ("m", "rn"), ("d", "cl"), ("h", "li"), ("f", "e"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("8", "b"), ("1", "i"), ("u", "ii"),
)
#: Readings that no right word of letters holds.
SURE = frozenset("@0159668íﬁﬂ")
HYPHENS = "-‐¬­"
#: A word is frequent from this share of all words on.
FREQUENT = 2e-5
MODEL_WORDS, CONTEXT_WORDS, WINDOW = 4096, 512, 3
#: How much more frequent the right word must be: after a sure misreading, and otherwise.
RATIO_SURE, RATIO = 2.0, 12.0
#: Share of a file's pages that a line must be on to be furniture.
FURNITURE_SHARE = 0.18

_EDGE = re.compile(r"^[^\w@]+|[^\w@]+$")
_ROMAN = re.compile(r"\b[ivxlcdm]+\b")
#: Every glyph in the strokes it can be misread as, so a line and its misreadings come out alike.
_STROKES = str.maketrans(
    {"m": "rri", "n": "ri", "u": "ii", "d": "ei", "w": "vv", "h": "ii", "b": "ii", "6": "ii", "8": "ii", "l": "i", "1": "i", "í": "i", "c": "e", "f": "e", "t": "e", "0": "o", "a": "o", "@": "o", "5": "s", "9": "g", "ﬁ": "ei", "ﬂ": "ei"}
)


def core(token: str) -> str:
    return _EDGE.sub("", token).lower()


def skeleton(line: str) -> str:
    """What is left of a line when page numbers and look-alike glyphs are put aside."""
    s = " ".join(line.lower().split())
    s = re.sub(r"(?<![^\W\d_@])\d+(?![^\W\d_@])", "#", s)
    s = _ROMAN.sub("#", s)
    return s.translate(_STROKES)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n, clean): how often each word stands in all texts, and in those of other than scanned files.

    rows: (text, scanned). Words are tokens between white space, lower case, without punctuation around them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            out: dict[str, list[int]] = {}
            for k in (0, 1):
                for t, n in raw[k].items():
                    if w := core(t):
                        cell = out.setdefault(w, [0, 0])
                        cell[0] += n
                        cell[1] += n * (1 - k)
                raw[k].clear()
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([c[0] for c in out.values()], pa.int64()), pa.array([c[1] for c in out.values()], pa.int64())], names=["word", "n", "clean"])

        for batch in batches:
            for t, scan in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw[bool(scan)].update(t.split())
            if len(raw[0]) + len(raw[1]) > 300_000:
                yield flush()
        yield flush()

    return rows.mapInArrow(run, "word string, n bigint, clean bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))


class Lexicon:
    """Frequent words of the corpus with their counts, and vectors of the most frequent."""

    def __init__(self, words: dict[str, int], u: np.ndarray, v: np.ndarray, order: list[str]):
        self.words, self.u, self.v = words, u, v
        self.place = {w: i for i, w in enumerate(order)}

    def fit(self, word: str, context: list[int]) -> float:
        """How much better the word suits the context than a word drawn at random; 0 if unknown."""
        i = self.place.get(word)
        if i is None or not context:
            return 0.0
        return float(np.clip(self.v[context] @ self.u[i], -6, 6).sum() / len(context) ** 0.5)


def learn_lexicon(df: DataFrame, counts: DataFrame, text: str = "text") -> Lexicon:
    total, clean = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    # A word that scanned files alone have is no right word yet, however often it stands there.
    known = F.col("clean") * total >= 0.1 * F.col("n") * clean
    top = counts.filter((F.col("n") >= max(3, FREQUENT * total)) & known & ~F.col("word").rlike(r"\d")).toArrow().to_pylist()
    top.sort(key=lambda r: (-r["n"], r["word"]))
    words = {r["word"]: r["n"] for r in top}
    order = [r["word"] for r in top[:MODEL_WORDS]]
    m, c = len(order), min(CONTEXT_WORDS, len(order))
    if not m:
        return Lexicon({}, np.zeros((0, 1), np.float32), np.zeros((0, 1), np.float32), [])
    place = {w: i for i, w in enumerate(order)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(m * c, np.int64)
        table: dict[str, int] = {}

        for batch in batches:
            ids: list[int] = []
            for t in batch.column(0).to_pylist():
                for token in t.split():
                    i = table.get(token)
                    if i is None:
                        i = place.get(core(token), -1)
                        if len(table) < 500_000:
                            table[token] = i
                    ids.append(i)
                ids += [-1] * WINDOW
            a = np.array(ids, np.int64)
            for d in range(1, WINDOW + 1):
                for x, y in ((a[:-d], a[d:]), (a[d:], a[:-d])):
                    ok = (x >= 0) & (y >= 0) & (y < c)
                    cells += np.bincount(x[ok] * c + y[ok], minlength=m * c)
        at = np.nonzero(cells)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "n"])

    rows = df.select(F.col(f"`{text}`").alias("text")).filter(F.length("text") > 0)
    pairs = spread(rows).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(m * c, np.float64)
    matrix[np.asarray(pairs.column("cell").combine_chunks())] = np.asarray(pairs.column("n").combine_chunks())
    u, v = skipgram.fit(matrix.reshape(m, c))
    return Lexicon(words, u, v, order)


def marked(chunks: DataFrame, register: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, file, page, text, scanned) of all chunks with a text; scanned: the register calls the file a pdf."""
    kind = F.lower(F.regexp_replace(F.trim("file_type"), r"^\.", ""))
    files = register.filter(kind == "pdf").select(F.col("id").alias("file")).distinct().withColumn("scanned", F.lit(True))
    page = F.coalesce(F.col("metadata.page").cast("bigint"), F.xxhash64(key)) if "metadata" in chunks.columns else F.xxhash64(key)
    rows = chunks.select(F.col(key).alias("key"), F.col("file_id").alias("file"), page.alias("page"), F.col(text).alias("text")).filter(F.length("text") > 0)
    rows = spread(rows)
    if files.count() <= 400_000:  # at most some 20 MB
        files = F.broadcast(files)
    return rows.join(files, "file", "left").withColumn("scanned", F.coalesce("scanned", F.lit(False)))


def scanned(chunks: DataFrame, register: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, file, page, text) of the chunks of scanned files."""
    return marked(chunks, register, key, text).filter("scanned").drop("scanned")


def _prose(line: str) -> bool:
    """Whether a line looks like a piece of a sentence; such a line repeats by chance."""
    words = line.split()
    return len(words) >= 6 and sum(w[0].islower() for w in words) >= 0.55 * len(words)


def furniture(pages: DataFrame) -> DataFrame:
    """(file, skeletons ARRAY<BIGINT>): hashes of the line skeletons that stand on many of a file's pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, prose = [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                seen = {_hash(skeleton(x)): _prose(x) for x in t.split("\n") if x.strip()}
                rows += [i] * len(seen)
                hashes += seen.keys()
                prose += seen.values()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(hashes, pa.int64()), pa.array(prose, pa.bool_())], names=["file", "page", "skeleton", "prose"])

    lines = pages.select("file", "page", "text").mapInArrow(run, "file string, page bigint, skeleton bigint, prose boolean").distinct()
    often = lines.groupBy("file", "skeleton").agg(F.countDistinct("page").alias("n"), F.bool_or("prose").alias("prose")).filter("n >= 2")
    size = pages.select("file", "page").distinct().groupBy("file").agg(F.count("*").alias("pages"))
    kept = often.join(size, "file").filter(F.col("n") >= F.when(F.col("prose"), F.greatest(F.lit(4.0), 0.5 * F.col("pages"))).otherwise(F.greatest(F.lit(2.0), FURNITURE_SHARE * F.col("pages"))))
    return kept.groupBy("file").agg(F.collect_list("skeleton").alias("skeletons"))


def readings(word: str, most: int = 2) -> dict[str, bool]:
    """Words that a plausible misreading turns into this one -> whether a sure sign was read."""
    out: dict[str, bool] = {}
    todo = [(word, 0, False)]
    while todo:
        w, edits, sure = todo.pop()
        for read, right in GLYPHS:
            at = w.find(read)
            while at >= 0:
                g = w[:at] + right + w[at + len(read) :]
                s = sure or read in SURE
                if g not in out or s and not out[g]:
                    out[g] = s
                    # A second misreading is tried only while sure signs are left, or after one.
                    if edits + 1 < most and (any(c in SURE for c in g) or s and len(word) > 5):
                        todo.append((g, edits + 1, s))
                at = w.find(read, at + 1)
    out.pop(word, None)
    return out


def _wanted(word: str) -> bool:
    """Whether a word may be a misread one: mostly letters, at least one of them, no address or number."""
    letters = sum(c.isalpha() for c in word)
    return letters >= 1 and len(word) >= 2 and letters >= 0.5 * len(word) and "_" not in word and not re.search(r"\d{3}|[./:\\]|@.*@", word)


_OCCURRENCE = "key string, line_no bigint, fault string, word string, left string, right string, context array<int>"


def _occurrences(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """Running lines, broken words and words to look up, of batches (key, text, skeletons)."""
    frequent, place, contexts = lexicon.words, lexicon.place, len(lexicon.v)
    for batch in batches:
        out: list[tuple] = []
        for key, text, marks in zip(*(c.to_pylist() for c in batch.columns)):
            marks = set(marks or ())
            lines = text.split("\n")
            runs = [bool(marks) and bool(x.strip()) and _hash(skeleton(x)) in marks for x in lines]
            for i, r in enumerate(runs):
                if r:
                    out.append((key, i, "running_line", "", "", "", []))
            body = [i for i, r in enumerate(runs) if not r]
            # Tokens of the text without furniture: (line, raw token, broken with the next).
            tokens: list[tuple[int, str]] = []
            skip_first = False
            for b, i in enumerate(body):
                parts = lines[i].split()
                if skip_first and parts:
                    parts = parts[1:]
                    skip_first = False
                if parts and len(parts[-1]) > 1 and parts[-1][-1] in HYPHENS and parts[-1][-2].isalnum():
                    nxt = next((j for j in body[b + 1 :] if lines[j].strip()), None)
                    # The next line of text; over a blank line only where furniture was cut out between.
                    if nxt is not None and (all(lines[j].strip() for j in range(i + 1, nxt + 1)) or any(runs[i + 1 : nxt])):
                        right = lines[nxt].split()[0]
                        if right[0].isalnum() or right[0] in "@":
                            left = re.sub(r"^[^\w@]+", "", parts[-1][:-1]).lower()
                            right_core = core(right)
                            if left and right_core:
                                tokens += [(i, p) for p in parts[:-1]]
                                tokens.append((i, "\0" + left + "\0" + right_core))
                                skip_first = True
                                continue
                tokens += [(i, p) for p in parts]
            cores = [t if t[:1] == "\0" else core(t) for _, t in tokens]
            ids = [place.get(c, -1) for c in cores]
            for k, ((i, _), c) in enumerate(zip(tokens, cores)):
                broken = c[:1] == "\0"
                if not broken and (c in frequent or not _wanted(c)):
                    continue
                near = [x for x in ids[max(0, k - WINDOW) : k] + ids[k + 1 : k + 1 + WINDOW] if 0 <= x < contexts]
                if broken:
                    _, left, right = c.split("\0")
                    out.append((key, i, "broken_word", left + right, left, right, near))
                else:
                    out.append((key, i, "misread_word", c, "", "", near))
        cols = list(zip(*out)) if out else [[]] * 7
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _OCCURRENCE.split(", ")])


def _options(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """All words that may stand where a word was read: (word, reading, sure, edits).

    Two misreadings of letters in one word are tried only for frequent words, where one gives none.
    """
    for batch in batches:
        out: list[tuple[str, str, bool, int]] = []
        for fault, word, left, right in zip(*(c.to_pylist() for c in batch.columns)):
            forms = [word] if fault == "misread_word" else [word, f"{left}-{right}"]
            name = word if fault == "misread_word" else f"{left}\0{right}"
            for f in forms:
                out.append((name, f, False, 0))
                if _wanted(f):
                    one = readings(f)
                    out += [(name, g, s, 1) for g, s in one.items()]
                    if len(f) >= 5 and not any(g in lexicon.words for g in one) and f not in lexicon.words:
                        out += [(name, h, s, 2) for g, s in one.items() for h in readings(g, 1) if h in lexicon.words and h != f]
        cols = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.int32()))], names=["name", "reading", "sure", "edits"])


def _choose(fault: str, word: str, left: str, right: str, context: list[int], options: list[dict], lexicon: Lexicon) -> str | None:
    """The right word, or None where the word read stands."""
    known = {o["reading"]: o for o in options}
    if fault == "misread_word":
        own, clean = (known[word]["n"], known[word]["clean"]) if word in known else (0, 0)
        best, best_score = None, -1e9
        for o in options:
            if not o["edits"]:
                continue
            n, sure = o["n"], o["sure"]
            fit = lexicon.fit(o["reading"], context)
            ratio = RATIO_SURE if sure else RATIO * (0.5 if fit > 2 else 2.0 if fit < -2 else 1.0)
            if not sure:
                ratio *= (8 if len(word) <= 3 else 1) * (4 if o["edits"] > 1 else 1) * (1 if not clean else 20)
            if n < 3 or n < ratio * max(1, own):
                continue
            score = np.log(n) + 0.5 * fit + 2.0 * sure - 4.0 * (o["edits"] > 1)
            if score > best_score:
                best, best_score = o["reading"], score
        return best
    # A broken word: whole or with its own hyphen, as the corpus has it; misread glyphs put right.
    whole, hyphened = word, f"{left}-{right}"
    a, b = (known[f]["n"] if f in known else 0 for f in (whole, hyphened))
    if max(a, b) >= 3:
        return whole if a >= b else hyphened
    best, best_score = None, -1e9
    for o in options:
        if o["edits"] and o["n"] >= max(5, 3 * max(a, b)):
            score = np.log(o["n"]) + 0.5 * lexicon.fit(o["reading"], context) + 2.0 * o["sure"]
            if score > best_score:
                best, best_score = o["reading"], score
    if best:
        return best
    if max(a, b) > 0 and a != b:
        return whole if a > b else hyphened
    return hyphened if right[:1].isdigit() or re.search(r"\d", left) else whole


def faults(chunks: DataFrame, register: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, line_no BIGINT, fault, word, repaired) of the chunks of scanned files, once each."""
    every = marked(chunks, register, key, text)
    counts = materialise(word_counts(every.select("text", "scanned")))
    lexicon = learn_lexicon(chunks, counts, text)
    pages = every.filter("scanned").drop("scanned")
    marks = materialise(furniture(pages))
    with_marks = pages.join(F.broadcast(marks) if marks.count() <= 100_000 else marks, "file", "left").select("key", "text", "skeletons")
    seen = materialise(with_marks.mapInArrow(lambda it: _occurrences(it, lexicon), _OCCURRENCE).distinct())
    words = seen.filter("fault <> 'running_line'")
    options = words.select("fault", "word", "left", "right").distinct().mapInArrow(lambda it: _options(it, lexicon), "name string, reading string, sure boolean, edits int")
    links = options.join(counts.withColumnRenamed("word", "reading"), "reading").groupBy("name").agg(F.collect_list(F.struct("reading", "sure", "edits", "n", "clean")).alias("options"))
    name = F.when(F.col("fault") == "misread_word", F.col("word")).otherwise(F.concat("left", F.lit("\0"), "right"))
    joined = words.withColumn("name", name).join(links, "name", "left").select("key", "line_no", "fault", "word", "left", "right", "context", "options")
    # A word without any link stands as it is, unless it is broken.
    joined = joined.filter((F.col("fault") == "broken_word") | F.exists("options", lambda o: o["edits"] > 0))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                right = _choose(r["fault"], r["word"], r["left"], r["right"], r["context"] or [], r["options"] or [], lexicon)
                if right is not None:
                    out.append((r["key"], r["line_no"], r["fault"], r["word"] if r["fault"] == "misread_word" else r["left"], right))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["key", "line_no", "fault", "word", "repaired"])

    chosen = joined.mapInArrow(choose, "key string, line_no bigint, fault string, word string, repaired string")
    lines = seen.filter("fault = 'running_line'").select("key", "line_no", "fault", F.lit("").alias("word"), F.lit("").alias("repaired"))
    return lines.unionByName(chosen).distinct().withColumnRenamed("key", key)


def _like(word: str, right: str) -> str:
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return right.upper()
    return right[:1].upper() + right[1:] if word[:1].isupper() or not word[:1].isalpha() and len(letters) > 1 and letters[0].isupper() else right


def rebuild(text: str, found: list[dict]) -> str:
    """The text with its faults repaired, in paragraphs of one line each."""
    lines = text.split("\n")
    drop = {f["line_no"] for f in found if f["fault"] == "running_line"}
    fixes = {(f["line_no"], f["word"]): f["repaired"] for f in found if f["fault"] == "misread_word"}
    joins = {f["line_no"]: f["repaired"] for f in found if f["fault"] == "broken_word"}
    out: list[str] = []
    carry: str | None = None
    cut = False
    for i, line in enumerate(lines):
        if i in drop:
            cut = True
            continue
        parts = line.split()
        if not parts:
            if carry is None and not cut and out and out[-1] != "\n":
                out.append("\n")
            continue
        cut = False
        if carry is not None:
            tail = re.search(r"[^\w@]*$", parts[0])[0]
            parts[0] = carry + tail
            carry = None
            done = 1
        else:
            done = 0
        for k in range(done, len(parts)):
            c = core(parts[k])
            if (i, c) in fixes:
                at = parts[k].lower().find(c)
                body = parts[k][at : at + len(c)]
                parts[k] = parts[k][:at] + _like(body, fixes[i, c]) + parts[k][at + len(c) :]
        if i in joins and parts[-1][-1:] in HYPHENS:
            lead = re.match(r"^[^\w@]*", parts[-1])[0]
            carry = lead + _like(parts[-1][len(lead) :], joins[i])
            parts.pop()
        out += parts
    if carry is not None:
        out.append(carry)
    paragraphs = " ".join(out).split("\n")
    return "\n\n".join(p.strip() for p in paragraphs if p.strip())


def repair(chunks: DataFrame, register: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, text): the text of each chunk of a scanned file as continuous paragraphs, one row per key."""
    found = faults(chunks, register, key, text).groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("line_no", "fault", "word", "repaired")).alias("found"))
    rows = scanned(chunks, register, key, text).select("key", "text").dropDuplicates(["key"]).join(found, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [rebuild(t, f or []) if t.strip() else t for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return rows.select("key", "text", "found").mapInArrow(run, "key string, text string").withColumnRenamed("key", key)
