"""From a model's reply to a short answer, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .info import let
from .text import squeezed

_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
#: Expressions of time, looked for in this order.
TIMES = [
    rf"\b\d{{1,2}}\s+(?:{_MONTH}),?\s+\d{{4}}\b",
    rf"\b(?:{_MONTH})\s+\d{{1,2}},?\s+\d{{4}}\b",
    rf"\b(?:{_MONTH})\s+\d{{4}}\b",
    r"\b\d{4}\b",
    r"\b(?:since|from)\s+\d{4}\b",
    r"\b\d+\s+(?:day|days|week|weeks|month|months|year|years)\b",
    rf"\b(?:the\s+)?(?:sunday|monday|tuesday|wednesday|thursday|friday|saturday)\s+before\s+\d{{1,2}}\s+(?:{_MONTH})\s+\d{{4}}\b",
]
#: What a question must match, and the frames that hold its answer, in this order.
FRAMES = [
    ("raise awareness for", [r"raised awareness for\s+([^.;,]+)", r"awareness for\s+([^.;,]+)"]),
    (r"\bwhat did .+ research\b", [r"researched\s+([^.;,]+)", r"researching\s+([^.;,]+)"]),
    ("career", [r"career in\s+([^.;]+)", r"pursue\s+([^.;]+)", r"looking into\s+([^.;]+)"]),
    ("activities|partake", [r"activities such as\s+([^.;]+)", r"partakes in\s+([^.;]+)", r"include\s+([^.;]+)"]),
    ("used for", [r"used for\s+([^.;,]+)", r"for\s+([^.;,]+)"]),
    (r"what did(?s:.*)paint|paint(?s:.*)what did", [r"painted\s+([^.;]+)"]),
    (r"what are(?s:.*)plans|plans(?s:.*)what are", [r"plans (?:include|are)\s+([^.;]+)", r"include\s+([^.;]+)"]),
]
#: Openings that a fact does without, cut one after the other, and words at which its reason begins.
OPENINGS = [r"(?i)^the answer is\s+", r"(?i)^it (?:is|was|would be|would likely be)\s+", r"(?i)^they (?:are|were)\s+", r"^[A-Z][A-Za-z' -]{1,40}\s+(?:is|was|are|were|has|have|had|did|does|do)\s+"]
REASON = r"(?i)\s+(?:as|because|since|which|where|when)\s+"
JUDGEMENT = r"(?i)^(likely\s+yes|likely\s+no|yes|no)\b"
MOST_OPEN_WORDS, MOST_REASON_WORDS, MOST_FRAME_WORDS = 18, 8, 12
_ENDS = r"^[ ,;:]+|[ ,;:]+$"


def _before(c: Column, pattern: str) -> Column:
    """What stands before the first match."""
    return F.element_at(F.split(c, pattern, 2), 1)


def _first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(c, r"\s+"), lambda w: w != ""), 1, n), " ")


def _n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def time_answer(answer: Column) -> Column:
    """The first expression of time by the order of :data:`TIMES`, else the answer."""
    found = [F.nullif(F.trim(F.regexp_extract(answer, f"(?i){p}", 0)), F.lit("")) for p in TIMES]
    return F.coalesce(*found, answer)


def framed_fact(answer: Column, question: Column) -> Column:
    """What the frames that the question asks for hold, of one to twelve words; else empty."""
    found = []
    for asked, frames in FRAMES:
        for p in frames:
            held = F.regexp_replace(F.regexp_extract(answer, f"(?i){p}", 1), r"""^[ ,;:"']+|[ ,;:"']+$""", "")
            bare = F.regexp_replace(_before(held, REASON), r"(?i)^(?:a|an|the)\s+", "")
            found.append(F.when(F.lower(question).rlike(asked) & _n_words(bare).between(1, MOST_FRAME_WORDS), bare))
    return F.coalesce(*found, F.lit(""))


def fact_answer(answer: Column, question: Column) -> Column:
    """The framed fact, or the answer without openings, reasons and further sentences."""
    cut = answer
    for p in OPENINGS:
        cut = F.regexp_replace(cut, p, "")
    short = F.regexp_replace(F.trim(F.substring_index(_before(cut, REASON), ".", 1)), _ENDS, "")
    return let(framed_fact(answer, question), lambda framed: F.when(framed != "", framed).otherwise(short))


def open_answer(answer: Column) -> Column:
    """Yes or no with up to eight words of what follows, or up to eighteen words of the first sentence."""
    judged = F.regexp_extract(answer, JUDGEMENT, 1)
    said = F.regexp_replace(_before(F.substr(answer, F.length(judged) + 1), r"(?i)\b(?:because|since|as)\b|[.;]"), _ENDS, "")
    plain = F.trim(F.substring_index(answer, ".", 1))
    short = F.when(_n_words(plain) > MOST_OPEN_WORDS, _first_words(plain, MOST_OPEN_WORDS)).otherwise(plain)
    with_reason = F.regexp_replace(F.concat(judged, F.lit("; "), _first_words(said, MOST_REASON_WORDS)), _ENDS, "")
    return F.when(judged == "", F.regexp_replace(short, _ENDS, "")).when(said == "", judged).otherwise(with_reason)


def replied_answer(reply: Column) -> Column:
    """The ``answer`` of a reply that is a JSON object or holds one, else the reply; quotes off, blanks single."""
    whole, inner = F.get_json_object(reply, "$.answer"), F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*?\}", 0), "$.answer")
    text = F.trim(F.coalesce(whole, inner, reply))
    return squeezed(F.regexp_replace(F.regexp_replace(text, '^"+|"+$', ""), "^'+|'+$", ""))


def answer_text(reply: Column, category: Column, question: Column) -> Column:
    """The short answer by category: a time, a fact, an opinion; as it is for others. A null reply is empty."""
    short = lambda a: F.when(category == "temporal", time_answer(a)).when(category.isin("single-hop", "multi-hop"), fact_answer(a, question)).when(category == "open-domain", open_answer(a)).otherwise(a)
    return let(replied_answer(F.coalesce(F.trim(reply), F.lit(""))), lambda a: F.when(a == "", a).otherwise(short(a)))
