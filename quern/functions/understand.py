"""Query understanding: normal form, intent, safety, follow-ups, routing, plans. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, tokens, words

#: Patterns and word lists that decide; the first that matches counts.
BLOCK = ("ignore (previous|above|all) instructions", "you are now", "pretend you", "jailbreak", "bypass.*filter", "disregard.*rules", "act as if", "forget.*instructions", "new persona", "override")
TRIGGERS = ("ignore", "override", "bypass", "instructions", "forget", "pretend")
DOCUMENT_INJECTION = (
    "ignore (previous|above|all) instructions", "disregard (all|the) (previous|above|prior) (instructions|rules)", "you are now (a|an|the)", "pretend you are",
    "act as if you (are|were)", "forget (all|your) (previous|prior) instructions", "jailbreak", "new persona", "reveal (the|your) system prompt",
)
FOLLOWUP_SIGNALS = ("it", "this", "that", "explain it", "tell me more", "what does it mean", "elaborate", "go deeper", "and what about", "more detail", "expand on", "what about", "continue", "and then")
FOLLOWUP_OPENERS = ("and", "also", "but")
COMPLEX = ("compare", "difference", "analyze", "summarize", "explain why", "contrast", "evaluate", "between", "across", "versus", "vs", "pros and cons", "similarities", "differences")
INTENTS = (
    ("meta", ("how many doc", "how many file", "how many docx", "how many pdf", "list file", "list doc", "what doc", "what file", "which file", "loaded doc", "uploaded doc", "do we have any doc", "do we have any file", "how many loaded", "show me the doc", "show me the file")),
    ("compare", ("compare", "difference", "versus", "vs", "between", "contrast", "similarities", "differences")),
    ("summarize", ("summarize", "summary", "overview", "brief", "key points")),
    ("explain", ("explain", "what does", "meaning", "clarify", "simple", "how does")),
)
EXPANSION = {
    "error": "exception failure fault crash", "timeout": "timed out deadline exceeded connection refused", "fail": "failed failure error exception", "failed": "fail failure error exception",
    "crash": "crashed fatal exception terminated killed", "crashed": "crash fatal exception terminated killed", "slow": "latency delay performance degraded", "down": "unavailable unreachable offline failed",
    "memory": "ram heap oom out of memory leak", "disk": "storage io filesystem",
}
CONNECTORS = (" and ", " also ", " as well as ", ";", " then ")


def normalise(q: Column) -> Column:
    q = F.regexp_replace(strip(q), r"[ \t\r\n\f]+", " ")
    return F.substring(F.regexp_replace(q, r"[^\p{L}\p{N}_\s?.,'!\-/:@#%()\[\]{}=+<>|^~\\]", ""), 1, 500)


def holds(q: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(q, F.lit(n))
    return out


def intent(q: Column) -> Column:
    q, out = F.lower(q), F.lit("qa")
    for name, needles in reversed(INTENTS):
        out = F.when(holds(q, needles), F.lit(name)).otherwise(out)
    return out


def route(q: Column, score: Column) -> Column:
    """'strong' for complex or long questions and weak matches, else 'fast'."""
    return F.when(holds(F.lower(q), COMPLEX) | (F.size(words(q)) > 20) | (score < 3.0), F.lit("strong")).otherwise(F.lit("fast"))


def blocked(q: Column) -> Column:
    return F.lower(q).rlike("|".join(f"(?:{p})" for p in BLOCK))


def trigger_count(q: Column) -> Column:
    out = F.lit(0)
    for t in TRIGGERS:
        out = out + F.lower(q).rlike(rf"\b{t}\b").cast("int")
    return out


def injected(text: Column) -> Column:
    return F.lower(text).rlike("|".join(f"(?:{p})" for p in DOCUMENT_INJECTION))


def safety(q: Column, classifier: Column | None = None) -> Column:
    """(safe, reason): patterns block; two trigger words ask the classifier, which passes where there is none."""
    unsafe = classifier if classifier is not None else F.lit(False)
    ask = trigger_count(q) >= 2
    return F.struct(
        (~blocked(q) & ~(ask & unsafe)).alias("safe"),
        F.when(blocked(q), F.lit("regex")).when(ask & unsafe, F.lit("classifier")).otherwise(F.lit("passed")).alias("reason"),
    )


def is_followup(q: Column) -> Column:
    low = F.lower(q)
    return low.rlike(rf"^\W*(?:{'|'.join(FOLLOWUP_OPENERS)})\b") | low.rlike(rf"\b(?:{'|'.join(FOLLOWUP_SIGNALS)})\b")


def followup_query(q: Column, last_query: Column, last_answer: Column) -> Column:
    anchored = F.concat(q, F.lit(' (context: previous question was "'), last_query, F.lit('" - your previous answer was "'), F.substring(last_answer, 1, 300), F.lit('")'))
    return F.when(is_followup(q) & last_query.isNotNull() & last_answer.isNotNull(), anchored).otherwise(q)


def maybe_multipart(q: Column) -> Column:
    q = strip(q)
    marks = F.char_length(q) - F.char_length(F.replace(q, F.lit("?"), F.lit("")))
    return (F.size(words(q)) >= 10) & ((marks >= 2) | holds(F.lower(q), CONNECTORS))


def expand(q: Column) -> Column:
    """Short questions get the related words of their tokens."""
    t = tokens(q)
    table = F.create_map(*[F.lit(x) for kv in EXPANSION.items() for x in kv])
    extra = F.filter(F.transform(t, lambda w: F.element_at(table, w)), lambda x: x.isNotNull())
    return F.when((F.size(t) <= 4) & (F.size(extra) > 0), F.concat(q, F.lit(" "), F.array_join(extra, " "))).otherwise(q)


def noun_key(w: Column) -> Column:
    w, out = F.lower(w), F.lower(w)
    for s in reversed(("'s", "es", "s")):
        out = F.when(w.endswith(s) & (F.char_length(w) - len(s) >= 3), F.substring(w, F.lit(1), F.char_length(w) - len(s))).otherwise(out)
    return out


def anchor_pronoun(q: Column, prior: Column) -> Column:
    hit = F.lower(q).rlike(r"\b(it|its|they|their|them)\b") & (F.coalesce(prior, F.lit("")) != "")
    return F.when(hit, F.concat(q, F.lit(" (referring to: "), prior, F.lit(")"))).otherwise(q)


def dependencies(step: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(step, F.lit(r"\{(\d+)\}"), F.lit(1)), lambda n: n.cast("int")))


def sanitise_step(step: Column, position: Column, most: int = 9) -> Column:
    """Placeholders of steps that aren't earlier become plain words."""
    out = step
    for n in range(most + 1):
        out = F.when(position <= n, F.replace(out, F.lit(f"{{{n}}}"), F.lit("the previous result"))).otherwise(out) if n else F.replace(out, F.lit("{0}"), F.lit("the previous result"))
    return out


def display_step(step: Column) -> Column:
    return F.regexp_replace(step, r"\{(\d+)\}", "the answer to step $1")


def first_line(c: Column, other: Column, most: int = 200) -> Column:
    """The first line that isn't blank, to `most` characters; `other` where there is none."""
    line = strip(F.regexp_extract(F.coalesce(c, F.lit("")), r"([^\r\n]*[^\s][^\r\n]*)", 1))
    return F.when(line == "", other).otherwise(F.substring(line, 1, most))
