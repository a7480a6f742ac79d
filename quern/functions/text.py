"""Text functions: Column in, Column out, all evaluated in the JVM.

Lines end at CR, LF or CRLF and words are runs of other than white space (space, tab, CR, LF, form
feed); a wider notion of either is not offered.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\r\n\f]"
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "St.", "vs.", "etc.", "approx.", "i.e.", "e.g.", "U.S.", "U.K.", "Ph.D.", "Inc.", "Co.", "Ltd.", "No.")
#: Fixed value: a line of a log begins with one of these within its first 40 characters.
TIMESTAMP = r"(?i)(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2})"
MAX_INGEST_CHARS = 2_000_000
PARAGRAPH_CHARS, SLICE_CHARS = 1600, 4800


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def clean_text(c: Column, most: int | None = MAX_INGEST_CHARS) -> Column:
    """Bound (None: no bound), drop NUL, one blank for runs of blanks, at most one empty line, no edges."""
    c = F.replace(c if most is None else F.substring(c, 1, most), F.lit("\0"), F.lit(""))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.char_length(c) / 4).cast("bigint")


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"{WS}+"), lambda w: w != "")


def lines(c: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(c, r"\r\n|\n|\r"), lambda x: x.rlike(r"[^ \t\r\n\f]"))


def is_log(c: Column) -> Column:
    first = F.slice(lines(c), 1, 50)
    hits = F.size(F.filter(first, lambda x: F.substring(x, 1, 40).rlike(TIMESTAMP)))
    return F.coalesce((F.size(first) > 0) & (hits >= 0.3 * F.size(first)), F.lit(False))


def is_table_row(x: Column) -> Column:
    """Every comma-separated part is key=value with something on both sides of one sign."""
    parts = F.split(x, ",")
    full = lambda p: (F.size(F.split(p, "=")) == 2) & F.element_at(F.split(p, "="), 1).rlike(r"[^ \t\r\n\f]") & F.element_at(F.split(p, "="), -1).rlike(r"[^ \t\r\n\f]")
    return (F.size(parts) >= 2) & F.forall(parts, full)


def is_table(c: Column) -> Column:
    first = F.slice(lines(c), 1, 20)
    return F.coalesce((F.size(first) > 0) & (F.size(F.filter(first, is_table_row)) >= 0.6 * F.size(first)), F.lit(False))


def sentences(c: Column) -> Column:
    for a in ABBREVIATIONS:
        c = F.replace(c, F.lit(a), F.lit(a.replace(".", "\x01")))
    cut = F.split(F.replace(c, F.lit(". "), F.lit(".\n")), r"\r\n|\n|\r")
    return F.filter(F.transform(cut, lambda x: strip(F.replace(x, F.lit("\x01"), F.lit(".")))), lambda x: x != "")


def _slices(b: Column) -> Column:
    n = F.greatest(F.ceil(F.char_length(b) / SLICE_CHARS).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(b, i * SLICE_CHARS + 1, F.lit(SLICE_CHARS)))


def paragraphs(c: Column) -> Column:
    """Blocks between empty lines; oversized ones by lines, else sentences, else hard slices."""
    blocks = F.filter(F.transform(F.split(c, r"\n\n"), strip), lambda b: b != "")

    def units(b: Column) -> Column:
        ls = F.filter(F.transform(F.split(b, r"\n"), strip), lambda x: x != "")
        one = F.element_at(ls, 1)
        return (
            F.when(F.char_length(b) <= PARAGRAPH_CHARS, F.array(b))
            .when(F.size(ls) > 1, ls)
            .otherwise(bound(one, lambda x: bound(sentences(x), lambda ss: F.when(F.size(ss) > 1, ss).otherwise(_slices(x)))))
        )

    return F.flatten(F.transform(blocks, units))


def bound(c: Column, use) -> Column:
    """use(c), with c evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(c), use), 1)


def pack(units: Column, limit: int, joiner: str) -> Column:
    """Units joined greedily into groups of at most `limit` estimated tokens; a larger unit is a group alone.

    The fold carries sizes and the numbers of units that begin a group, never text; each group is joined once.
    """
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("size"), F.lit(0).alias("i"))

    def add(s: Column, u: Column) -> Column:
        n = F.floor(F.char_length(u) / 4).cast("int")
        full = (s["i"] > 0) & (s["size"] + n > limit)
        new = full | (s["i"] == 0)
        return F.struct(F.when(new, F.concat(s["starts"], F.array(s["i"]))).otherwise(s["starts"]).alias("starts"), F.when(full, n).otherwise(s["size"] + n).alias("size"), (s["i"] + 1).alias("i"))

    def groups(us: Column) -> Column:
        starts = F.aggregate(us, zero, add, lambda s: s["starts"])
        cut = lambda ss: F.transform(ss, lambda a, k: F.array_join(F.slice(us, a + 1, F.coalesce(F.get(ss, k + 1), F.size(us)) - a), joiner))
        return bound(starts, cut)

    return bound(units, groups)


#: Look-alike characters of generated text and what they stand for.
LOOKALIKE_FROM = "‐‑‒–—―−      　‘’“”"
LOOKALIKE_TO = "-------       ''\"\""


def ascii_lookalikes(c: Column) -> Column:
    return F.translate(c, LOOKALIKE_FROM, LOOKALIKE_TO)


def latin1(c: Column) -> Column:
    """Fit for a Latin-1 font: common signs replaced, the rest of other scripts as '?'."""
    for a, b in (("—", "--"), ("…", "...")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.translate(c, "‘’“”–•‑   【】", "''\"\"---   []")
    return F.regexp_replace(c, r"[^\x{00}-\x{FF}]", "?")


CITATION = r"(?i)[\[【]\s*Source:[^\]】]*[\]】]"


def drop_citations(c: Column) -> Column:
    return F.regexp_replace(c, CITATION, " ")


def compact_answer(c: Column, most: int = 400) -> Column:
    t = strip(F.regexp_replace(ascii_lookalikes(drop_citations(F.coalesce(c, F.lit("")))), rf"{WS}+", " "))
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("...")))


def citation_header(filename: Column, page: Column, section: Column) -> Column:
    sec = F.when(F.coalesce(section, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" | "), section))
    return F.concat(F.lit("[Source: "), F.coalesce(filename, F.lit("unknown")), F.lit(" | Page "), F.coalesce(page.cast("string"), F.lit("?")), sec, F.lit("]"))


def compress_words(c: Column, most: int = 300) -> Column:
    w = words(c)
    return F.when(F.size(w) <= most, c).otherwise(F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit(" […]")))


def duration_seconds(c: Column) -> Column:
    """Seconds of the wait a message asks for ("try again in 1h2m3.5s"), or null."""
    hint = F.regexp_extract(c, r"(?i)try again in\s+((?:\d+(?:\.\d+)?(?:ms|h|m|s))+)", 1)
    parts = F.regexp_extract_all(F.lower(hint), F.lit(r"(\d+(?:\.\d+)?(?:ms|h|m|s))"), F.lit(1))
    unit = lambda p: F.regexp_extract(p, "(ms|h|m|s)$", 1)
    factor = lambda p: F.when(unit(p) == "ms", 0.001).when(unit(p) == "s", 1.0).when(unit(p) == "m", 60.0).otherwise(3600.0)
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.regexp_extract(p, r"^(\d+(?:\.\d+)?)", 1).cast("double") * factor(p))
    return F.when(F.size(parts) > 0, F.round(total, 3))


def time_ago(t: Column, now: Column) -> Column:
    d = F.greatest(F.lit(0), now.cast("bigint") - t.cast("bigint"))
    div = lambda k: F.floor(d / k).cast("string")
    return (
        F.when(d < 60, F.lit("just now")).when(d < 3600, F.concat(div(60), F.lit(" min ago"))).when(d < 86400, F.concat(div(3600), F.lit(" h ago")))
        .when(d < 172800, F.lit("yesterday")).when(d < 604800, F.concat(div(86400), F.lit(" days ago"))).otherwise(F.date_format(t, "d MMM yyyy"))
    )


def mask_password(url: Column) -> Column:
    return F.regexp_replace(url, r"^([a-z0-9+]+://[^:/@]+):[^@/]*@", "$1:***@")


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^.]*)$", 1))
