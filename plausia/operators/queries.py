"""Questions to the beliefs and their change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.info import UNKNOWN, believed, probability, surprise, unknown
from ..functions.text import value_form
from .deltas import SECONDS_PER_DAY


def current_dimensions(dimensions: DataFrame) -> DataFrame:
    """``id, entity, attribute, dist, last_accessed``: the latest row of each id that isn't removed; entity and
    attribute are read from the id at its last dot."""
    latest = dimensions.where("id is not null").groupBy("id").agg(F.max(F.struct("last_accessed", F.col("distribution").isNotNull().alias("there"), "distribution")).alias("now"))
    return latest.where("now.there").select("id", F.regexp_extract("id", r"(?s)^(.*)\.([^.]*)$", 1).alias("entity"), F.regexp_extract("id", r"(?s)^(.*)\.([^.]*)$", 2).alias("attribute"), F.col("now.distribution").alias("dist"), F.col("now.last_accessed").alias("last_accessed"))


def predict(beliefs: DataFrame, requested: DataFrame) -> DataFrame:
    """``entity, attribute, dist`` for each requested pair; an unseen one is ``unknown``. Nothing is written."""
    return requested.join(beliefs.select("entity", "attribute", "dist"), ["entity", "attribute"], "left").select("entity", "attribute", F.coalesce("dist", unknown()).alias("dist"))


def top_beliefs(beliefs: DataFrame) -> DataFrame:
    return beliefs.withColumn("_top", believed(F.col("dist"))).select("entity", "attribute", F.col("_top")["value"].alias("value"), F.col("_top")["p"].alias("p"))


def beliefs_at(deltas: DataFrame, probes: DataFrame, bucket_seconds: float = 7.0 * SECONDS_PER_DAY) -> DataFrame:
    """``dimension_id, at, dist``: the posterior of the last delta recorded at or before each probed instant,
    ``unknown`` before the first.

    An as-of join without a product of rows: within a bucket of time, deltas and probes are one ordered run;
    a bucket without an earlier delta takes the last one of the buckets before. A busy dimension is split by
    its buckets.
    """
    bucket = F.floor(F.col("at") / bucket_seconds)
    changes = deltas.where("dimension_id is not null and ts is not null").select("dimension_id", F.col("ts").alias("at"), "seq", F.coalesce("posterior", unknown()).alias("dist")).withColumn("bucket", bucket)
    asked = probes.select("dimension_id", "at").distinct().withColumn("bucket", bucket)
    both = changes.withColumn("probe", F.lit(0)).unionByName(asked.withColumn("probe", F.lit(1)), allowMissingColumns=True)
    run = Window.partitionBy("dimension_id", "bucket").orderBy("at", "probe", "seq").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("within", F.last("dist", True).over(run)).where("probe = 1").select("dimension_id", "at", "bucket", "within")
    ends = changes.groupBy("dimension_id", "bucket").agg(F.max_by("dist", F.struct("at", "seq")).alias("end"))
    marks = ends.unionByName(asked.select("dimension_id", "bucket").distinct(), allowMissingColumns=True).groupBy("dimension_id", "bucket").agg(F.first("end", True).alias("end"))
    before = marks.withColumn("before", F.last("end", True).over(Window.partitionBy("dimension_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("end")
    return here.join(before, ["dimension_id", "bucket"]).select("dimension_id", "at", F.coalesce("within", "before", unknown()).alias("dist"))


def history(deltas: DataFrame, dimension_id: str | None = None) -> DataFrame:
    """The change log by recording time, of one dimension or all."""
    own = deltas if dimension_id is None else deltas.where(F.col("dimension_id") == dimension_id)
    return own.orderBy("ts", "seq")


def explain(deltas: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(dimension_id, value)``: the deltas that raised the probability of the value, as written or with
    blanks for underscores."""
    raised = lambda v: probability(F.col("posterior"), v, 0.0) > probability(F.col("prior"), v, 0.0)
    return deltas.join(asked, "dimension_id").where(raised(F.col("value")) | raised(value_form(F.col("value"))))


def claim_surprise(claims: DataFrame, beliefs: DataFrame) -> DataFrame:
    """The claims with the bits of surprise that each would be; beliefs stay as they are."""
    known = claims.join(beliefs.select("entity", "attribute", "dist"), ["entity", "attribute"], "left")
    return known.withColumn("surprise", surprise(probability(F.coalesce("dist", unknown()), F.col("value")))).drop("dist")


def entity_registry(beliefs: DataFrame, edges: DataFrame) -> DataFrame:
    """``entity, n_attributes`` of everything known: entities of beliefs and ends of edges, whose attribute is
    the relation or, at the far end, ``related_entity``."""
    of_edges = edges.where("source_entity is not null and target_entity is not null")
    known = beliefs.select("entity", "attribute").unionAll(of_edges.select(F.col("source_entity").alias("entity"), F.lower("relation").alias("attribute"))).unionAll(of_edges.select(F.col("target_entity").alias("entity"), F.lit("related_entity").alias("attribute")))
    return known.groupBy("entity").agg(F.count_distinct("attribute").alias("n_attributes"))


def observed_values(deltas: DataFrame, most: int = 8) -> DataFrame:
    """``dimension_id, values``: up to ``most`` distinct values (ignoring case) ever believed with at least five
    percent, or new in a posterior, in the order first seen."""
    prior = F.transform(F.coalesce("prior", F.array().cast("array<struct<value:string,p:double>>")), lambda x: x["value"])
    strong = F.filter("posterior", lambda x: (x["value"] != UNKNOWN) & (x["p"] >= 0.05))
    ranked = F.array_sort(F.transform(strong, lambda x, i: F.struct((-x["p"]).alias("k"), i.alias("i"), x["value"].alias("value"))))
    fresh = F.filter("posterior", lambda x: (x["value"] != UNKNOWN) & ~F.array_contains(F.col("_prior"), x["value"]))
    shown = F.concat(F.transform(ranked, lambda x: x["value"]), F.transform(fresh, lambda x: x["value"]))
    seen = deltas.where("dimension_id is not null and posterior is not null").withColumn("_prior", prior).select("dimension_id", "ts", "seq", F.posexplode(shown).alias("pos", "value"))
    first = seen.groupBy("dimension_id", F.lower("value").alias("folded")).agg(F.min(F.struct("ts", "seq", "pos", "value")).alias("f"))
    nth = F.row_number().over(Window.partitionBy("dimension_id").orderBy("f"))
    return first.withColumn("_n", nth).where(F.col("_n") <= most).groupBy("dimension_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col("f.value").alias("value")))), lambda x: x["value"]).alias("values"))


def top_evidence(deltas: DataFrame, most: int = 5) -> DataFrame:
    """``entity, rank, snippet``: each entity's most surprising distinct evidence, dated."""
    entity = F.regexp_extract("dimension_id", r"(?s)^(.*)\.([^.]*)$", 1)
    said = deltas.where(F.col("dimension_id").contains(".")).select(entity.alias("entity"), "surprise", "ts", "seq", F.trim(F.col("evidence")).alias("evidence")).where("evidence <> ''")
    best = said.groupBy("entity", "evidence").agg(F.min(F.struct((-F.coalesce("surprise", F.lit(0.0))).alias("k"), "ts", "seq")).alias("b"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy("b"))).where(F.col("rank") <= most)
    date = F.when(F.col("b.ts") > 1_000_000, F.concat(F.lit(" ["), F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("b.ts") / SECONDS_PER_DAY).cast("int")), "yyyy-MM-dd"), F.lit("]")))
    return ranked.select("entity", "rank", F.concat("evidence", F.coalesce(date, F.lit(""))).alias("snippet"))


def rendered(beliefs: DataFrame, dimension: Column) -> DataFrame:
    """One line per belief: ``- id = value (confidence 0.00)``."""
    top = believed(F.col("dist"))
    return beliefs.select(F.format_string("- %s = %s (confidence %.2f)", dimension, top["value"], top["p"]).alias("line"))
