"""Answer-quality metrics, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .info import let
from .text import match_form

#: The four categories of the macro average, and question types by their labels.
CATEGORIES = ["single-hop", "multi-hop", "temporal", "open-domain"]
ABSTENTIONS = ["unknown", "don't know", "do not know", "no information"]
SESSION_TYPES = {
    "single-session-user": "single-session",
    "single-session-assistant": "single-session",
    "single-session-preference": "single-session",
    "temporal-reasoning": "temporal",
    "knowledge-update": "knowledge-update",
    "multi-session": "multi-session",
}
CONVERSATION_CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}


def _words(c: Column) -> Column:
    return F.filter(F.split(match_form(c), " "), lambda w: w != "")


def token_f1(prediction: Column, truth: Column) -> Column:
    """Distinct common words over the words of either side, repeats included."""

    def score(p: Column, t: Column) -> Column:
        common = F.size(F.array_intersect(p, t)).cast("double")
        precision, recall = common / F.size(p), common / F.size(t)
        return F.when(common == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))

    return let(_words(prediction), lambda p: let(_words(truth), lambda t: score(p, t)))


def bleu1(prediction: Column, truth: Column) -> Column:
    """Share of predicted words, repeats included, that are in the truth; no brevity penalty."""
    hits = lambda p, t: F.size(F.filter(p, lambda w: F.array_contains(t, w))).cast("double") / F.size(p)
    return let(_words(prediction), lambda p: let(_words(truth), lambda t: F.when(F.size(p) == 0, 0.0).otherwise(hits(p, t))))


def context_recall(context: Column, truth: Column) -> Column:
    """1 if the truth stands in the context, else the share of its words of over two letters that do."""

    def share(c: Column, t: Column) -> Column:
        part = let(F.filter(F.split(t, " "), lambda w: F.length(w) > 2), lambda long: F.when(F.size(long) == 0, 0.0).otherwise(F.size(F.filter(long, lambda w: F.contains(c, w))).cast("double") / F.size(long)))
        return F.when((t == "") | (c == ""), 0.0).when(F.contains(c, t), 1.0).otherwise(part)

    return let(match_form(context), lambda c: let(match_form(truth), lambda t: share(c, t)))


def failure_bucket(answer: Column, f1: Column, recall: Column) -> Column:
    a = match_form(answer)
    return F.when(a == "", "api_or_empty_answer").when(a == "unknown", "unknown_answer").when(recall < 0.34, "retrieval_miss").when(f1 == 0, "answer_miss").when(f1 < 0.5, "partial_answer").otherwise("good")


def abstains(answer: Column) -> Column:
    found = F.lit(False)
    for phrase in ABSTENTIONS:
        found = found | F.contains(F.lower(answer), F.lit(phrase))
    return found


def rescored(results: DataFrame) -> DataFrame:
    """``category, n, token_f1, bleu1, judge`` per category and a ``macro`` row, the mean of the four
    categories' means; ``results`` has category, answer, ground_truth and judge."""
    per = results.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg(token_f1(F.col("answer"), F.col("ground_truth"))).alias("token_f1"), F.avg(bleu1(F.col("answer"), F.col("ground_truth"))).alias("bleu1"), F.avg("judge").alias("judge")
    )
    macro = per.where(F.col("category").isin(CATEGORIES)).agg(F.lit("macro").alias("category"), F.sum("n").alias("n"), F.avg("token_f1").alias("token_f1"), F.avg("bleu1").alias("bleu1"), F.avg("judge").alias("judge"))
    return per.unionByName(macro)


def session_type(label: Column) -> Column:
    """The question type of a label, which is its own if it is not listed."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SESSION_TYPES.items() for x in pair)), label), label)


def conversation_type(category: Column) -> Column:
    """The question type of a numbered category, null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in CONVERSATION_CATEGORIES.items() for x in pair)), category)


def calibration(rated: DataFrame) -> DataFrame:
    """``level, n, mean`` of ``rated(level, reliability)``, and as ``separation`` the mean of ``high`` less that of ``low``."""
    per = rated.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("reliability").alias("mean"))
    of = lambda level: F.avg(F.when(F.col("level") == level, F.col("reliability")))
    return per.unionByName(rated.agg(F.lit("separation").alias("level"), F.count_if(F.col("level").isin("high", "low")).alias("n"), (of("high") - of("low")).alias("mean")))


def holds_value(answer: Column, value: Column) -> Column:
    """Whether an answer holds a short value: an equal number, the whole word, or within words if the value has at
    least four letters and digits or, as written, a full stop."""
    words = F.regexp_extract_all(F.lower(answer), F.lit("[a-z0-9.]+"), F.lit(0))
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    number, long = value.try_cast("double"), F.length(bare(value)) >= 4
    within = F.array_contains(words, F.lower(value)) | (F.contains(F.lower(answer), F.lower(value)) & (long | F.contains(value, F.lit(".")))) | (F.contains(bare(answer), bare(value)) & long)
    return F.when(number.isNotNull(), F.exists(words, lambda w: F.coalesce(w.try_cast("double") == number, F.lit(False)))).otherwise(within)
