"""Text normalization and comparison, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that retrieval leaves out, and the shorter list of question routing.
QUESTION_STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "of", "in", "on", "at", "to", "for", "and", "or", "but", "did", "does", "do", "what", "when", "where", "who", "why", "how", "which",
    "would", "could", "should", "been", "being", "has", "have", "had", "with", "from", "about", "into", "than", "then", "their", "his", "her", "its", "they", "them", "he", "she", "i", "my", "me", "you",
    "your",
]
STOPWORDS = [
    *QUESTION_STOPWORDS,
    "we", "us", "our", "this", "that", "it", "so", "if", "not", "no", "by", "as", "just", "can", "will", "also", "very", "really", "like", "more", "some", "know", "think", "feel", "want", "need",
    "going", "get", "got",
]
#: Suffixes cut by the stemmers, tried in this order.
SUFFIXES = ["ing", "tion", "ness", "ment", "ed", "er", "es", "ly", "s"]
QUESTION_SUFFIXES = ["ing", "ed", "es", "s"]
ENTITY_STOPWORDS = ["the", "a", "an", "is", "are", "was", "were", "of", "in", "on", "at", "to", "for", "and", "or", "but", "speaker", "unknown"]


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def value_form(c: Column) -> Column:
    """Underscores as blanks, blanks single, ends trimmed."""
    return squeezed(F.translate(c, "_", " "))


def attribute_form(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.translate(c, " -", "__")), "_+", "_")


def entity_form(c: Column) -> Column:
    """Words that don't start in upper case are capitalized, acronyms and others stay."""
    words = F.split(value_form(c), " ")
    one = lambda w: F.when(F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))
    return F.array_join(F.transform(words, one), " ")


def match_form(c: Column) -> Column:
    """Lower case, runs of anything but a–z and 0–9 as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def same_answer(prediction: Column, truth: Column) -> Column:
    """Equal by letters and digits, or one within the other if the truth has at least four."""
    p, t = letters_only(prediction), letters_only(truth)
    return (p == t) | ((F.length(t) >= 4) & (F.contains(p, t) | F.contains(t, p)))


def asserted(answer: Column, true_value: Column, poison: Column) -> Column:
    has_true, has_poison = F.contains(letters_only(answer), letters_only(true_value)), F.contains(letters_only(answer), letters_only(poison))
    return F.when(has_true & has_poison, "both").when(has_poison, "poison").when(has_true, "true").otherwise("other")


def hit(answer: Column, value: Column) -> Column:
    """Whether a short value is in an answer: equal numbers count as the same, other values as a word, or within
    the text if they have at least four letters or a full stop."""
    tokens = F.regexp_extract_all(F.lower(answer), F.lit("[a-z0-9.]+"), F.lit(0))
    number, low = value.try_cast("double"), F.lower(value)
    long = F.length(letters_only(value)) >= 4
    text = F.array_contains(tokens, low) | (F.contains(F.lower(answer), low) & (long | F.contains(value, F.lit(".")))) | (F.contains(letters_only(answer), letters_only(value)) & long)
    return F.when(number.isNotNull(), F.exists(tokens, lambda t: F.coalesce(t.try_cast("double") == number, F.lit(False)))).otherwise(text)


def tokens(c: Column) -> Column:
    """Words of retrieval, in order and with repeats: no stopwords, none under three letters."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b[a-zA-Z0-9][a-zA-Z0-9_'-]*\b"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def stem(w: Column) -> Column:
    """Cuts the first suffix that leaves at least three letters off a word of more than four."""
    out = F.when(F.length(w) <= 4, w)
    for s in SUFFIXES:
        out = out.when(w.endswith(s) & (F.length(w) - len(s) >= 3), F.substring(w, F.lit(1), F.length(w) - len(s)))
    return out.otherwise(w)


def stems(c: Column) -> Column:
    return F.transform(tokens(c), stem)


def question_tokens(c: Column) -> Column:
    """Distinct words of a question, each with its stem beside it."""
    words = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b[a-zA-Z0-9][a-zA-Z0-9_-]*\b"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(QUESTION_STOPWORDS))

    def cut(w: Column) -> Column:
        out = None
        for s in QUESTION_SUFFIXES:
            rule = (w.endswith(s) & (F.length(w) > len(s) + 3), F.substring(w, F.lit(1), F.length(w) - len(s)))
            out = F.when(*rule) if out is None else out.when(*rule)
        return out

    return F.array_distinct(F.concat(words, F.array_compact(F.transform(words, cut))))


def core_text(c: Column, longest: int = 120) -> Column:
    """What two snippets of the same content share: no speaker, lower case, blanks single, the start."""
    bare = F.regexp_replace(F.trim(c), r"^[^:]{1,60}:\s*", "")
    return F.substring(F.regexp_replace(F.trim(F.lower(bare)), r"\s+", " "), 1, longest)


def percent(p: Column) -> Column:
    """A probability as whole percent, halves to even."""
    return F.concat(F.bround(p * 100, 0).cast("int").cast("string"), F.lit("%"))


def parsed_time(c: Column) -> Column:
    """Epoch seconds of the accepted time formats (UTC); null otherwise."""
    up = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)\bam\b", "AM"), r"(?i)\bpm\b", "PM")
    formats = ["yyyy-MM-dd HH:mm", "yyyy-MM-dd", "h:mm a 'on' d MMMM, yyyy", "h:mm a 'on' d MMM, yyyy"]
    return F.coalesce(*(F.try_to_timestamp(up, F.lit(f)).cast("double") for f in formats))
