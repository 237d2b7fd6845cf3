"""Provenance-capped trust, decision strategies and how they stand up to poisoning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .beliefs import beliefs, last_write_wins, most_frequent
from .queries import top_beliefs

#: Trust tiers of channels, and the settings of the poisoning grids.
TIERS = {"repo": 0.9, "user": 0.9, "web": 0.2, "tool": 0.9}
TRUSTED, N_TRUSTED, CONTENT_CONFIDENCE = 0.9, 4, 0.96


def tier(channel: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair)), channel)


def provenance_tier(channel: Column, origin: Column | None = None) -> Column:
    """The channel's tier, or the lesser of it and the tier of a tainted origin."""
    return tier(channel) if origin is None else F.least(tier(channel), tier(origin))


def effective_reliability(channel: Column, content: Column, origin: Column | None = None) -> Column:
    """Content may lower trust below the channel's ceiling, never raise it."""
    return F.least(provenance_tier(channel, origin), content)


def modelled(model: Column, content: Column, provenance: Column) -> Column:
    """Reliability under ``content_only``, ``provenance_only``, ``hybrid_min`` or ``hybrid_max``."""
    return F.when(model == "content_only", content).when(model == "provenance_only", provenance).when(model == "hybrid_min", F.least(content, provenance)).when(model == "hybrid_max", F.greatest(content, provenance))


def laundered(policy: Column, origin_tier: float = 0.2, through_tier: float = TRUSTED, content: float = CONTENT_CONFIDENCE) -> Column:
    """Reliability of poison that comes through a trusted intermediary: ``direct`` knows its origin,
    ``naive_inherit`` forgets it, ``taint_propagate`` carries it along."""
    kept = F.when(policy == "direct", origin_tier).when(policy == "naive_inherit", through_tier).when(policy == "taint_propagate", min(origin_tier, through_tier))
    return F.least(kept, F.lit(content))


def min_capped(is_true_source: Column, content: Column, true_tier: Column, noise_tier: float = TRUSTED) -> Column:
    return F.least(F.when(is_true_source, true_tier).otherwise(noise_tier), content)


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of the parameter values given: a few rows, made on the driver."""
    from itertools import product

    kinds = {str: "string", float: "double", int: "int"}
    schema = ", ".join(f"{name} {kinds[type(values[0])]}" for name, values in axes.items())
    return spark.createDataFrame(list(product(*axes.values())), schema)


def poison_claims(cells: DataFrame, key: Column, n_trusted: Column, n_poison: Column, reliability: Column) -> DataFrame:
    """Claims of one attack per cell: trusted observations of V, then poison W at the given reliability."""
    at = cells.select(key.alias("entity"), n_trusted.alias("t"), n_poison.alias("m"), reliability.alias("r"))
    steps = at.select("entity", "t", "r", F.explode(F.sequence(F.lit(1), F.col("t") + F.col("m"))).alias("seq"))
    good = F.col("seq") <= F.col("t")
    return steps.select("entity", F.lit("fact").alias("attribute"), F.when(good, "V").otherwise("W").alias("value"), F.when(good, TRUSTED).otherwise(F.col("r")).cast("double").alias("reliability"), "seq")


def decisions(claims: DataFrame) -> DataFrame:
    """``entity, attribute, strategy, value`` under the three strategies that need no reader of texts."""
    bayes = top_beliefs(beliefs(claims)).select("entity", "attribute", F.lit("bayes").alias("strategy"), "value")
    last = last_write_wins(claims).select("entity", "attribute", F.lit("last_write_wins").alias("strategy"), "value")
    often = most_frequent(claims).select("entity", "attribute", F.lit("frequency").alias("strategy"), "value")
    return bayes.unionAll(last).unionAll(often)


def retrieved(texts: DataFrame, keywords: Column, key: str = "scenario") -> DataFrame:
    """Append-and-retrieve: of each key's texts those with one of its keywords, or all if none has."""
    hit = F.exists(keywords, lambda k: F.contains(F.lower(F.col("text")), k))
    marked = texts.withColumn("_hit", hit)
    some = marked.groupBy(key).agg(F.max("_hit").alias("_some"))
    return marked.join(some, key).where("_hit or not _some").drop("_hit", "_some")


def success_rate(outcomes: DataFrame, by: list[str], won: Column) -> DataFrame:
    """Percent of trials in which ``won`` holds."""
    return outcomes.groupBy(*by).agg((F.avg(won.cast("double")) * 100).alias("rate"), F.count(F.lit(1)).alias("n_trials"))


def accuracy_table(outcomes: DataFrame, guard: str = "adversarial") -> DataFrame:
    """``type, strategy, n, accuracy`` with sub-totals over all types and, as ``realistic``, all but the guard
    type; totals weigh every outcome alike."""
    right = (F.avg((F.col("value") == F.col("truth")).cast("double")) * 100).alias("accuracy")
    cells = outcomes.groupingSets([["type", "strategy"], ["strategy"]], "type", "strategy").agg(F.count(F.lit(1)).alias("n"), right)
    both = cells.withColumn("type", F.coalesce("type", F.lit("all")))
    realistic = outcomes.where(F.col("type") != guard).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), right).withColumn("type", F.lit("realistic"))
    return both.select("type", "strategy", "n", "accuracy").unionByName(realistic.select("type", "strategy", "n", "accuracy"))


def fragmented(claims: DataFrame) -> DataFrame:
    """``fact, n_true, n_poison, fragmented`` of ``claims(fact, kind, entity, attribute, value, target)``: whether the ``true``
    claims of a fact that carry its target (either contains the other, letters and digits alone) share no dimension with
    the ``poison`` claims that carry theirs, so that they never compete."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    v, t = bare(F.col("value")), bare(F.col("target"))
    carried = F.contains(v, t) | F.contains(t, v)
    dimension = F.when(carried, F.struct("entity", "attribute"))
    held = claims.groupBy("fact").agg(*(F.array_compact(F.collect_set(F.when(F.col("kind") == kind, dimension))).alias(kind) for kind in ("true", "poison")))
    return held.select("fact", F.size("true").alias("n_true"), F.size("poison").alias("n_poison"), (~F.arrays_overlap("true", "poison")).alias("fragmented"))


def extraction_tax(outcomes: DataFrame) -> DataFrame:
    """One row: percent right with claims given (``pinned``), with claims read from text (``unpinned``), and the difference."""
    pinned, unpinned = (F.avg(F.col(c).cast("double")) * 100 for c in ("pinned", "unpinned"))
    return outcomes.agg(F.count(F.lit(1)).alias("n"), pinned.alias("pinned"), unpinned.alias("unpinned"), (pinned - unpinned).alias("tax"))


#: Regimes of observation sequences: observations of V, W and V again, as (fewest, most), with reliabilities
#: of V and W; the truth is what V or V2 names.
REGIMES = {
    "stable_noise": [("V", 4, 8, 0.9), ("W", 1, 3, 0.4)], "clean_change": [("W", 3, 6, 0.9), ("V", 3, 6, 0.9)], "recent_change": [("W", 4, 8, 0.9), ("V", 1, 1, 0.9)],
    "noisy_change": [("W", 3, 5, 0.9), ("V", 2, 4, 0.9), ("N", 1, 2, 0.4), ("V", 1, 2, 0.9)], "reliability": [("V", 2, 3, 0.95), ("W", 4, 7, 0.3)],
}


def scenarios(spark: SparkSession, trials: int = 400, seed: int = 20260707) -> DataFrame:
    """Claims of seeded scenarios, ``entity`` being ``regime/trial``: the counts come from a hash of seed, trial
    and step, so any executor makes the same ones. The truth is always V."""
    plan = spark.createDataFrame([(name, i, *step) for name, steps in REGIMES.items() for i, step in enumerate(steps)], "regime string, step int, value string, fewest int, most int, reliability double")
    drawn = plan.select("*", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    n = F.col("fewest") + F.pmod(F.xxhash64(F.lit(seed), "regime", "trial", "step"), F.col("most") - F.col("fewest") + 1).cast("int")
    rows = drawn.withColumn("n", n).select(F.concat_ws("/", "regime", "trial").alias("entity"), F.lit("fact").alias("attribute"), "value", "reliability", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), "step")
    return rows.select("entity", "attribute", "value", "reliability", (F.col("step") * 100 + F.col("i")).alias("seq"))
