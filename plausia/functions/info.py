"""Information measures of categorical distributions (arrays of value and p), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the belief model.
MOST_SURPRISE, UNSEEN_P, TINY = 20.0, 0.05, 1e-10
HALF_LIFE_S = 30 * 86_400.0
UNKNOWN = "unknown"


def let(x: Column, body) -> Column:
    """Evaluates ``x`` once and hands it to ``body``; a lambda parameter would repeat its expression."""
    return F.element_at(F.transform(F.array(x), body), 1)


def unknown() -> Column:
    return F.array(F.struct(F.lit(UNKNOWN).alias("value"), F.lit(1.0).alias("p")))


def total(dist: Column) -> Column:
    return F.aggregate(dist, F.lit(0.0), lambda a, x: a + x["p"])


def probability(dist: Column, value: Column, default: float | None = UNSEEN_P) -> Column:
    found = F.try_element_at(F.filter(dist, lambda x: x["value"] == value), F.lit(1))["p"]
    return found if default is None else F.coalesce(found, F.lit(default))


def surprise(p: Column) -> Column:
    """Bits of surprise, between 0 and 20."""
    return F.when(p <= 0, MOST_SURPRISE).when(p >= 1, 0.0).otherwise(-F.log2(p))


def entropy(dist: Column) -> Column:
    return F.aggregate(dist, F.lit(0.0), lambda a, x: a - F.when(x["p"] > 0, x["p"] * F.log2(x["p"])).otherwise(0.0))


def certainty(dist: Column) -> Column:
    """1 less the entropy's share of the most it could be."""
    return F.when(F.size(dist) <= 1, 1.0).otherwise(1.0 - entropy(dist) / F.log2(F.size(dist).cast("double")))


def kl_divergence(post: Column, prior: Column) -> Column:
    def term(x: Column) -> Column:
        q = probability(prior, x["value"], 0.0)
        return F.when(x["p"] > 0, x["p"] * F.log2(x["p"] / F.when(q > 0, q).otherwise(TINY))).otherwise(0.0)

    return F.aggregate(post, F.lit(0.0), lambda a, x: a + term(x))


def bhattacharyya(a: Column, b: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.sqrt(x["p"] * probability(b, x["value"], 0.0)))


def normalized(dist: Column) -> Column:
    """Divided by its sum; uniform if that is not positive, ``unknown`` if there is nothing."""
    even = lambda d: F.transform(d, lambda x: F.struct(x["value"].alias("value"), (F.lit(1.0) / F.size(d)).alias("p")))
    return F.when(F.size(dist) <= 0, unknown()).otherwise(let(dist, lambda d: let(total(d), lambda t: F.when(t > 0, F.transform(d, lambda x: F.struct(x["value"].alias("value"), (x["p"] / t).alias("p")))).otherwise(even(d)))))


def decayed(dist: Column, last_accessed: Column, now: Column, half_life_s: float = HALF_LIFE_S) -> Column:
    """Mixed with the uniform distribution as time passes; unchanged if none has."""
    gone = F.greatest(F.lit(0.0), now - last_accessed)
    factor = F.pow(F.lit(0.5), gone / half_life_s)
    mixed = F.transform(dist, lambda x: F.struct(x["value"].alias("value"), (factor * x["p"] + (1 - factor) / F.size(dist)).alias("p")))
    return F.when(gone == 0, dist).otherwise(normalized(mixed))


def believed(dist: Column) -> Column:
    """The element of greatest ``p``, the first on ties; ``unknown`` only if nothing else is there."""
    known = F.filter(dist, lambda x: x["value"] != UNKNOWN)
    pool = F.when(F.size(known) > 0, known).otherwise(dist)
    return F.try_element_at(F.filter(pool, lambda x: x["p"] == F.array_max(F.transform(pool, lambda y: y["p"]))), F.lit(1))
