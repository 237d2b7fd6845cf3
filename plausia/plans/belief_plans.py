"""Queries of the belief operators over the supplied tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import broadcast_if_small
from ..functions import info
from ..operators import beliefs as B
from ..operators import identity, queries, trust
from ..operators.deltas import first_deliveries, nonblank
from .problems import Query, table

INSTANTS = [1_740_000_000.0, 1_755_000_000.0, 1_770_000_000.0]
_COLUMNS = ["dimension_id", "prior", "posterior", "surprise", "evidence", "source", "source_reliability", "ts", "cascaded_from"]


def event_claims(spark: SparkSession, d: str) -> DataFrame:
    reliability = F.when(F.col("value") >= 50, 0.9).when(F.col("value") >= 15, 0.6).otherwise(0.25)
    return B.claims_of(table(spark, d, "events"), F.col("user_id"), F.lit("event_type"), F.col("event_type"), reliability, F.unix_micros(F.col("ts").cast("timestamp")))


def order_claims(spark: SparkSession, d: str) -> DataFrame:
    reliability = F.when(F.col("o_orderstatus") == "F", 0.9).when(F.col("o_orderstatus") == "O", 0.6).otherwise(0.25)
    return B.claims_of(table(spark, d, "orders"), F.col("o_custkey"), F.lit("priority"), F.col("o_orderpriority"), reliability, F.col("o_orderkey"))


def log(spark: SparkSession, d: str) -> DataFrame:
    return first_deliveries(table(spark, d, "deltas"), *_COLUMNS)


def current(spark: SparkSession, d: str) -> DataFrame:
    return queries.current_dimensions(table(spark, d, "dimensions"))


def _values(df: DataFrame, *keys: str, dist: str = "dist") -> DataFrame:
    return df.select(*keys, F.explode(dist).alias("x")).select(*keys, F.col("x.value").alias("value"), F.round("x.p", 6).alias("p"))


def upd1_beliefs(spark: SparkSession, d: str) -> DataFrame:
    return _values(B.beliefs(event_claims(spark, d)), "entity", "attribute")


def upd1_beliefs_orders(spark: SparkSession, d: str) -> DataFrame:
    return _values(B.beliefs(order_claims(spark, d)), "entity", "attribute")


def upd3_flat(spark: SparkSession, d: str) -> DataFrame:
    return B.last_write_wins(event_claims(spark, d))


def upd8_change_log(spark: SparkSession, d: str) -> DataFrame:
    log_ = B.change_log(order_claims(spark, d))
    p = lambda c: F.round(info.probability(F.col(c), F.col("value"), 0.0), 6)
    return log_.select("entity", "seq", "value", p("prior").alias("p_before"), p("posterior").alias("p_after"), F.size("posterior").cast("long").alias("n_values"), F.round("surprise", 6).alias("surprise"), "last")


def q1_predict(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "attribute_types").select("attribute")
    asked = table(spark, d, "relationship_edges").select(F.col("source_entity").alias("entity")).where("source_entity is not null").distinct()
    asked = asked.withColumn("attribute", F.explode(F.array(F.lit("employer"), F.lit("role"), F.lit("status"))))
    return _values(queries.predict(current(spark, d), asked.join(broadcast_if_small(kinds, 10_000), "attribute", "left_semi")), "entity", "attribute")


def q2_top_beliefs(spark: SparkSession, d: str) -> DataFrame:
    return queries.top_beliefs(current(spark, d)).withColumn("p", F.round("p", 6))


def q3_beliefs_at(spark: SparkSession, d: str) -> DataFrame:
    deltas = log(spark, d)
    probes = deltas.select("dimension_id").where("dimension_id is not null").distinct().select("dimension_id", F.explode(F.array(*map(F.lit, INSTANTS))).alias("at"))
    return _values(queries.beliefs_at(deltas, probes), "dimension_id", "at")


def q4_history(spark: SparkSession, d: str) -> DataFrame:
    return queries.history(log(spark, d)).select("dimension_id", "id", "ts", "seq")


def q5_explain(spark: SparkSession, d: str) -> DataFrame:
    asked = queries.top_beliefs(current(spark, d)).select(F.concat_ws(".", "entity", "attribute").alias("dimension_id"), "value")
    return queries.explain(log(spark, d), asked).select("dimension_id", F.col("id").alias("delta_id"), "value")


def q6_surprise(spark: SparkSession, d: str) -> DataFrame:
    claims = log(spark, d).where(F.col("dimension_id").contains(".")).select(F.regexp_extract("dimension_id", r"(?s)^(.*)\.([^.]*)$", 1).alias("entity"), F.regexp_extract("dimension_id", r"(?s)^(.*)\.([^.]*)$", 2).alias("attribute"), info.believed(F.col("posterior"))["value"].alias("value"), "source")
    surprised = queries.claim_surprise(claims.where("value is not null"), current(spark, d))
    return surprised.groupBy("source").agg(F.count(F.lit(1)).alias("n_claims"), F.round(F.sum(F.round("surprise", 6)), 3).alias("bits"))


def q7_profile(spark: SparkSession, d: str) -> DataFrame:
    return queries.top_beliefs(current(spark, d)).groupBy("entity").agg(F.count(F.lit(1)).alias("n_attributes"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "attribute", "value"))), "; ").alias("profile"))


def q8_entities(spark: SparkSession, d: str) -> DataFrame:
    return queries.entity_registry(current(spark, d), table(spark, d, "relationship_edges"))


def q10_observed_values(spark: SparkSession, d: str) -> DataFrame:
    return queries.observed_values(log(spark, d)).select("dimension_id", F.array_join("values", "|").alias("observed"))


def q11_top_evidence(spark: SparkSession, d: str) -> DataFrame:
    return queries.top_evidence(log(spark, d)).withColumn("rank", F.col("rank").cast("long"))


def q12_rendered(spark: SparkSession, d: str) -> DataFrame:
    return queries.rendered(current(spark, d).where(F.size("dist") > 0), F.col("id"))


def math_information(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c, name: F.round(c, 6).alias(name)
    c = current(spark, d)
    dist = F.col("dist")
    return c.select("id", r(info.entropy(dist), "entropy"), r(info.certainty(dist), "certainty"), r(info.surprise(info.probability(dist, info.believed(dist)["value"])), "surprise"))


def math2_kl(spark: SparkSession, d: str) -> DataFrame:
    both = log(spark, d).where("prior is not null and posterior is not null")
    return both.select(F.col("id").alias("delta_id"), F.round(info.kl_divergence(F.col("posterior"), F.col("prior")), 6).alias("bits"), F.round(info.bhattacharyya(F.col("posterior"), F.col("prior")), 6).alias("overlap"))


def math5_decay(spark: SparkSession, d: str) -> DataFrame:
    c = current(spark, d)
    return _values(c.select("id", info.decayed(F.col("dist"), F.col("last_accessed"), F.lit(1_790_000_000.0)).alias("dist")), "id")


def _joint(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(broadcast_if_small(table(spark, d, "nation"), 10_000), F.col("c_nationkey") == F.col("n_nationkey"))
    n = table(spark, d, "customer").count()
    pairs = [("nation", F.col("n_name"), "region", F.col("n_regionkey").cast("string")), ("nation", F.col("n_name"), "segment", F.col("c_mktsegment")), ("segment", F.col("c_mktsegment"), "region", F.col("n_regionkey").cast("string"))]
    cells = F.array(*(F.struct(F.lit(a).alias("dim_a"), F.lit(b).alias("dim_b"), va.alias("va"), vb.alias("vb")) for a, va, b, vb in pairs))
    return c.select(F.explode(cells).alias("x")).select("x.*").groupBy("dim_a", "dim_b", "va", "vb").agg((F.count(F.lit(1)) / F.lit(float(max(1, n)))).alias("p"))


def math3_mutual_information(spark: SparkSession, d: str) -> DataFrame:
    m = identity.mutual_information(_joint(spark, d))
    return m.select("dim_a", "dim_b", *(F.round(c, 6).alias(c) for c in ("mi", "h_a", "h_b")))


def math7_redundant(spark: SparkSession, d: str) -> DataFrame:
    return identity.redundant_dimensions(_joint(spark, d))


def customer_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """Shares of order priorities and states, and the segment, of each customer."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    said = o.select(F.col("o_custkey").alias("entity"), F.explode(F.array(F.struct(F.lit("priority").alias("attribute"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("state").alias("attribute"), F.col("o_orderstatus").alias("value")))).alias("s")).select("entity", "s.*")
    said = said.unionAll(c.select(F.col("c_custkey").alias("entity"), F.lit("segment").alias("attribute"), F.col("c_mktsegment").alias("value")))
    counted = said.groupBy("entity", "attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy("entity", "attribute").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("v"), F.sum("n").alias("all"))
    return per.select("entity", "attribute", F.transform("v", lambda x: F.struct(x["value"].alias("value"), (x["n"] / F.col("all")).alias("p"))).alias("dist"))


def cpl1_coupling(spark: SparkSession, d: str) -> DataFrame:
    known = customer_beliefs(spark, d)
    return identity.merge_candidates(known.where(F.col("entity") % 20 == 0).select("entity"), known, identity.MERGE_UNLIKE, digits=6)


def cpl4_name_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "relationship_edges").where("source_entity <> '' and target_entity <> ''").select("source_entity", "target_entity").distinct()
    a, b = F.col("source_entity"), F.col("target_entity")
    return e.select("source_entity", "target_entity", F.round(identity.name_similarity(a, b), 6).alias("similarity"), identity.should_merge(F.lit(0.98), a, b).alias("merge_at_98"))


def str_decisions(spark: SparkSession, d: str) -> DataFrame:
    return trust.decisions(event_claims(spark, d))


def str4_retrieved(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "evidence_events").where("text is not null").select(F.col("source").alias("scenario"), "text")
    return trust.retrieved(texts, F.array(F.lit("travel budget"), F.lit("pottery"))).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))


def prv1_reliability(spark: SparkSession, d: str) -> DataFrame:
    channel = F.when(F.col("source").isin("web", "gossip"), "web").when(F.col("source").isin("tool", "crm_import"), "tool").otherwise("user")
    origin = F.when(F.col("cascaded_from").isNotNull(), "web").otherwise("repo")
    out = log(spark, d).withColumn("cascaded_from", nonblank(F.col("cascaded_from"))).withColumn("channel", channel).withColumn("origin", origin)
    content, provenance = F.col("source_reliability"), trust.provenance_tier(F.col("channel"), F.col("origin"))
    models = {m: F.round(trust.modelled(F.lit(m), content, provenance), 6).alias(m) for m in ("content_only", "provenance_only", "hybrid_min", "hybrid_max")}
    return out.select(F.col("id").alias("delta_id"), F.round(trust.effective_reliability(F.col("channel"), content, F.col("origin")), 6).alias("effective"), *models.values())


def _grid(spark: SparkSession) -> DataFrame:
    return trust.grid(spark, tier=[0.2, 0.45, 0.5, 0.55, 0.6, 0.9], m=[1, 3, 5, 10, 20, 50])


def prv6_poisoning(spark: SparkSession, d: str) -> DataFrame:
    key = lambda: F.format_string("%.2f/%d", "tier", "m")
    cells = _grid(spark)
    claims = trust.poison_claims(cells, key(), F.lit(trust.N_TRUSTED), F.col("m"), F.col("tier"))
    outcomes = trust.decisions(claims).join(broadcast_if_small(cells.withColumn("entity", key()), 10_000), "entity")
    return trust.success_rate(outcomes, ["strategy", "tier", "m"], F.col("value") == "W").withColumn("rate", F.round("rate", 3))


def prv4_laundering(spark: SparkSession, d: str) -> DataFrame:
    cells = trust.grid(spark, policy=["direct", "naive_inherit", "taint_propagate"], m=[1, 3, 10, 50])
    key = lambda: F.concat_ws("/", "policy", "m")
    claims = trust.poison_claims(cells, key(), F.lit(trust.N_TRUSTED), F.col("m"), trust.laundered(F.col("policy")))
    top = queries.top_beliefs(B.beliefs(claims)).join(broadcast_if_small(cells.withColumn("entity", key()), 10_000), "entity")
    return trust.success_rate(top, ["policy", "m"], F.col("value") == "W").withColumn("rate", F.round("rate", 3))


def eval9_accuracy(spark: SparkSession, d: str) -> DataFrame:
    made = trust.decisions(trust.scenarios(spark)).select(F.split("entity", "/")[0].alias("type"), "strategy", "value", F.lit("V").alias("truth"))
    return trust.accuracy_table(made, guard="recent_change").withColumn("accuracy", F.round("accuracy", 3))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        upd1_beliefs, upd1_beliefs_orders, upd3_flat, upd8_change_log, q1_predict, q2_top_beliefs, q3_beliefs_at, q4_history, q5_explain, q6_surprise, q7_profile, q8_entities, q10_observed_values, q11_top_evidence, q12_rendered,
        math_information, math2_kl, math5_decay, math3_mutual_information, math7_redundant, cpl1_coupling, cpl4_name_similarity, str_decisions, str4_retrieved, prv1_reliability, prv6_poisoning, prv4_laundering, eval9_accuracy,
    )
}

_EVENTS = "c AS (SELECT CAST(user_id AS VARCHAR) AS entity, event_type AS value, CASE WHEN value >= 50 THEN 0.9 WHEN value >= 15 THEN 0.6 ELSE 0.25 END::DOUBLE AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) AS seq FROM events)"
_ORDERS = "c AS (SELECT CAST(o_custkey AS VARCHAR) AS entity, o_orderpriority AS value, CASE o_orderstatus WHEN 'F' THEN 0.9 WHEN 'O' THEN 0.6 ELSE 0.25 END::DOUBLE AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS seq FROM orders)"


def _fold(claims: str) -> str:
    """The fold as recursion over rows: one row per key and step, the distribution a list."""
    p = "list_transform({0}, lambda x: x.p)"
    over = lambda d, by: f"list_transform({d}, lambda x: {{'value': x.value, 'p': x.p / {by}}})"
    return f"""WITH RECURSIVE {claims},
f AS (SELECT entity, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS value, CAST([] AS STRUCT(value VARCHAR, p DOUBLE)[]) AS prior, [{{'value': 'unknown', 'p': CAST(1 AS DOUBLE)}}] AS dist FROM (SELECT DISTINCT entity FROM c)
UNION ALL
SELECT entity, n, seq, value, prior, {over("kept", f"list_sum({p.format('kept')})")} FROM (
 SELECT *, CASE WHEN len(list_filter(post, lambda x: x.p >= 0.01)) > 0 THEN list_filter(post, lambda x: x.p >= 0.01) ELSE list_filter(post, lambda x: x.p = list_max({p.format("post")}))[1:1] END AS kept FROM (
  SELECT *, {over("u", f"list_sum({p.format('u')})")} AS post FROM (
   SELECT entity, n, seq, value, prior, CASE WHEN fresh THEN list_append(old, {{'value': value, 'p': (1.0::DOUBLE / k) * r}}) ELSE old END AS u FROM (
    SELECT *, list_transform(prior, lambda x: {{'value': x.value, 'p': x.p * CASE WHEN x.value = value THEN r ELSE (1.0::DOUBLE - r) / greatest(1, k - 1) END}}) AS old FROM (
     SELECT c.entity, c.n, c.seq, c.value, c.r, f.dist AS prior, NOT list_contains(list_transform(f.dist, lambda x: x.value), c.value) AS fresh,
      len(f.dist) + CASE WHEN list_contains(list_transform(f.dist, lambda x: x.value), c.value) THEN 0 ELSE 1 END AS k
     FROM f JOIN c ON c.entity = f.entity AND c.n = f.n + 1)))))),
fin AS (SELECT * FROM f QUALIFY n = max(n) OVER (PARTITION BY entity))
"""


_FIRST = "d AS (SELECT * FROM deltas WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)"
_CUR = r"""cur AS (SELECT id, regexp_extract(id, '(?s)^(.*)\.([^.]*)$', 1) AS entity, regexp_extract(id, '(?s)^(.*)\.([^.]*)$', 2) AS attribute, distribution AS dist, last_accessed
 FROM (SELECT * FROM dimensions WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_accessed DESC NULLS LAST, distribution IS NULL) = 1) WHERE distribution IS NOT NULL)"""


def _best(d: str, field: str) -> str:
    pool = f"CASE WHEN len(list_filter({d}, lambda x: x.value <> 'unknown')) > 0 THEN list_filter({d}, lambda x: x.value <> 'unknown') ELSE {d} END"
    return f"list_filter({pool}, lambda z: z.p = list_max(list_transform({pool}, lambda y: y.p)))[1].{field}"


_EXPLODE = "UNNEST(dist, recursive := true)"
_PICK = lambda d, v: f"list_filter({d}, lambda x: x.value = {v})[1].p"
_JOINT = """j AS (SELECT dim_a, dim_b, va, vb, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM customer) AS p FROM (
 SELECT 'nation' AS dim_a, 'region' AS dim_b, n_name AS va, CAST(n_regionkey AS VARCHAR) AS vb FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
 SELECT 'nation', 'segment', n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
 SELECT 'segment', 'region', c_mktsegment, CAST(n_regionkey AS VARCHAR) FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY ALL),
ma AS (SELECT dim_a, dim_b, va, sum(p) AS pa FROM j GROUP BY ALL), mb AS (SELECT dim_a, dim_b, vb, sum(p) AS pb FROM j GROUP BY ALL),
mi AS (SELECT dim_a, dim_b, sum(p * log2(p / (pa * pb))) AS mi FROM j JOIN ma USING (dim_a, dim_b, va) JOIN mb USING (dim_a, dim_b, vb) GROUP BY ALL),
ha AS (SELECT dim_a, dim_b, sum(-pa * log2(pa)) AS h_a FROM ma GROUP BY ALL), hb AS (SELECT dim_a, dim_b, sum(-pb * log2(pb)) AS h_b FROM mb GROUP BY ALL),
m AS (SELECT dim_a, dim_b, mi, h_a, h_b FROM mi JOIN ha USING (dim_a, dim_b) JOIN hb USING (dim_a, dim_b))"""
_CUST = """s AS (SELECT o_custkey AS entity, 'priority' AS attribute, o_orderpriority AS value FROM orders UNION ALL SELECT o_custkey, 'state', o_orderstatus FROM orders UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer),
v AS (SELECT entity, attribute, value, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY entity, attribute) AS DOUBLE) AS p FROM v),
dist AS (SELECT entity, attribute, count(*) AS k, string_agg(value, '|' ORDER BY value) AS names, CASE WHEN count(*) <= 1 THEN 1.0 ELSE 1 - sum(-p * log2(p)) / log2(count(*)) END AS sure FROM p GROUP BY ALL),
bc AS (SELECT a.entity AS ea, b.entity AS eb, a.attribute, sum(sqrt(a.p * b.p)) AS bc FROM p a JOIN p b ON a.attribute = b.attribute AND a.value = b.value AND a.entity <> b.entity WHERE a.entity % 20 = 0 GROUP BY ALL),
pr AS (SELECT a.entity AS ea, b.entity AS eb, a.attribute, a.k AS ka, b.k AS kb, a.names = b.names AS same, (a.sure + b.sure) / 2 + 0.1 AS w FROM dist a JOIN dist b ON a.attribute = b.attribute AND a.entity <> b.entity WHERE a.entity % 20 = 0),
sc AS (SELECT ea, eb, count(*) AS n, count(*) FILTER (ka <= 1 AND kb <= 1 AND NOT same) AS clash, count(*) FILTER (NOT (ka <= 1 AND kb <= 1)) AS telling, sum(coalesce(bc, 0) * w) / sum(w) AS score FROM pr LEFT JOIN bc USING (ea, eb, attribute) GROUP BY ALL),
ok AS (SELECT ea, eb, score FROM sc WHERE n >= 3 AND clash = 0 AND telling >= 2 AND score >= 0.995)"""
_GRAMS = "list_distinct(CASE WHEN length({0}) <= 1 THEN [{0}] ELSE list_transform(range(1, length({0})), lambda i: substring({0}, i, 2)) END)"
_SIM = f"""e AS (SELECT DISTINCT source_entity, target_entity, trim(lower(source_entity)) AS x, trim(lower(target_entity)) AS y FROM relationship_edges WHERE source_entity <> '' AND target_entity <> ''),
g AS (SELECT *, {_GRAMS.format("x")} AS gx, {_GRAMS.format("y")} AS gy FROM e),
m AS (SELECT *, CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.8 ELSE len(list_intersect(gx, gy)) / CAST(len(gx) + len(gy) - len(list_intersect(gx, gy)) AS DOUBLE) END AS sim FROM g)"""
_POISON = "cells AS (SELECT CAST(tier AS DOUBLE) AS tier, m FROM (SELECT UNNEST([0.2, 0.45, 0.5, 0.55, 0.6, 0.9]) AS tier) CROSS JOIN (SELECT UNNEST([1, 3, 5, 10, 20, 50]) AS m))"
_POISON_C = "c AS (SELECT concat(tier, '/', m) AS entity, tier, m, i AS n, i AS seq, CASE WHEN i <= 4 THEN 'V' ELSE 'W' END AS value, CASE WHEN i <= 4 THEN 0.9 ELSE tier END::DOUBLE AS r FROM (SELECT tier, m, UNNEST(range(1, 5 + m)) AS i FROM cells))"

ORACLE_SQL = {
    "upd1_beliefs": _fold(_EVENTS) + f"SELECT entity, 'event_type' AS attribute, value, round(p, 6) AS p FROM (SELECT entity, {_EXPLODE} FROM fin)",
    "upd1_beliefs_orders": _fold(_ORDERS) + f"SELECT entity, 'priority' AS attribute, value, round(p, 6) AS p FROM (SELECT entity, {_EXPLODE} FROM fin)",
    "upd3_flat": "SELECT CAST(user_id AS VARCHAR) AS entity, 'event_type' AS attribute, arg_max(event_type, ts) AS value FROM events GROUP BY user_id",
    "upd8_change_log": _fold(_ORDERS) + f"""SELECT entity, seq, value, round(coalesce({_PICK("prior", "value")}, 0), 6) AS p_before, round(coalesce({_PICK("dist", "value")}, 0), 6) AS p_after, CAST(len(dist) AS BIGINT) AS n_values,
 round(CASE WHEN coalesce({_PICK("prior", "value")}, 0.05) >= 1 THEN 0.0 ELSE -log2(coalesce({_PICK("prior", "value")}, 0.05)) END, 6) AS surprise, n = max(n) OVER (PARTITION BY entity) AS last FROM f WHERE n > 0""",
    "q1_predict": f"""WITH {_CUR}, a AS (SELECT DISTINCT source_entity AS entity, UNNEST(['employer', 'role', 'status']) AS attribute FROM relationship_edges WHERE source_entity IS NOT NULL),
x AS (SELECT a.entity, a.attribute, coalesce(dist, [{{'value': 'unknown', 'p': CAST(1 AS DOUBLE)}}]) AS dist FROM a LEFT JOIN cur ON cur.entity = a.entity AND cur.attribute = a.attribute)
SELECT entity, attribute, value, round(p, 6) AS p FROM (SELECT entity, attribute, {_EXPLODE} FROM x)""",
    "q2_top_beliefs": f"WITH {_CUR} SELECT entity, attribute, {_best('dist', 'value')} AS value, round({_best('dist', 'p')}, 6) AS p FROM cur",
    "q3_beliefs_at": f"""WITH {_FIRST}, k AS (SELECT DISTINCT dimension_id, UNNEST({INSTANTS}::DOUBLE[]) AS "at" FROM d WHERE dimension_id IS NOT NULL),
x AS (SELECT k.dimension_id, k."at", arg_max(coalesce(posterior, [{{'value': 'unknown', 'p': CAST(1 AS DOUBLE)}}]), ROW(ts, seq)) AS dist FROM k JOIN d ON d.dimension_id = k.dimension_id AND d.ts <= k."at" GROUP BY ALL),
y AS (SELECT k.dimension_id, k."at", coalesce(dist, [{{'value': 'unknown', 'p': CAST(1 AS DOUBLE)}}]) AS dist FROM k LEFT JOIN x ON x.dimension_id = k.dimension_id AND x."at" = k."at")
SELECT dimension_id, "at", value, round(p, 6) AS p FROM (SELECT dimension_id, "at", {_EXPLODE} FROM y)""",
    "q4_history": f"WITH {_FIRST} SELECT dimension_id, id, ts, seq FROM d",
    "q5_explain": f"""WITH {_FIRST}, {_CUR}, a AS (SELECT concat(entity, '.', attribute) AS dimension_id, {_best("dist", "value")} AS value FROM cur), b AS (SELECT *, trim(regexp_replace(replace(value, '_', ' '), '\\s+', ' ', 'g')) AS plain FROM a)
SELECT dimension_id, d.id AS delta_id, value FROM d JOIN b USING (dimension_id) WHERE coalesce({_PICK("posterior", "value")}, 0) > coalesce({_PICK("prior", "value")}, 0) OR coalesce({_PICK("posterior", "plain")}, 0) > coalesce({_PICK("prior", "plain")}, 0)""",
    "q6_surprise": f"""WITH {_FIRST}, {_CUR}, x AS (SELECT dimension_id, source, {_best("posterior", "value")} AS said FROM d WHERE contains(dimension_id, '.')),
y AS (SELECT source, CASE WHEN dist IS NULL THEN CASE WHEN said = 'unknown' THEN 1.0 ELSE 0.05 END ELSE coalesce({_PICK("dist", "said")}, 0.05) END AS p FROM x LEFT JOIN cur ON cur.id = x.dimension_id WHERE said IS NOT NULL)
SELECT source, count(*) AS n_claims, round(sum(round(CASE WHEN p <= 0 THEN 20.0 WHEN p >= 1 THEN 0.0 ELSE -log2(p) END, 6)), 3) AS bits FROM y GROUP BY source""",
    "q7_profile": f"WITH {_CUR}, t AS (SELECT entity, attribute, {_best('dist', 'value')} AS value FROM cur), s AS (SELECT entity, concat_ws('=', attribute, value) AS line FROM t) SELECT entity, count(*) AS n_attributes, string_agg(line, '; ' ORDER BY line) AS profile FROM s GROUP BY entity",
    "q8_entities": f"""WITH {_CUR}, e AS (SELECT * FROM relationship_edges WHERE source_entity IS NOT NULL AND target_entity IS NOT NULL)
SELECT entity, count(DISTINCT attribute) AS n_attributes FROM (SELECT entity, attribute FROM cur UNION ALL SELECT source_entity, lower(relation) FROM e UNION ALL SELECT target_entity, 'related_entity' FROM e) GROUP BY entity""",
    "q10_observed_values": f"""WITH {_FIRST}, s AS (SELECT dimension_id, ts, seq, list_transform(list_sort(list_transform(list_filter(posterior, lambda x: x.value <> 'unknown' AND x.p >= 0.05), lambda x, i: {{'k': -x.p, 'i': i, 'v': x.value}})), lambda z: z.v)
 || list_transform(list_filter(posterior, lambda x: x.value <> 'unknown' AND NOT list_contains(list_transform(coalesce(prior, []), lambda y: y.value), x.value)), lambda z: z.value) AS vs FROM d WHERE dimension_id IS NOT NULL AND posterior IS NOT NULL),
u AS (SELECT dimension_id, ts, seq, UNNEST(range(1, len(vs) + 1)) AS i, vs FROM s),
o AS (SELECT *, vs[i] AS v FROM u QUALIFY row_number() OVER (PARTITION BY dimension_id, lower(vs[i]) ORDER BY ts, seq, i) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY dimension_id ORDER BY ts, seq, i) AS r FROM o)
SELECT dimension_id, string_agg(v, '|' ORDER BY r) AS observed FROM n WHERE r <= 8 GROUP BY dimension_id""",
    "q11_top_evidence": f"""WITH {_FIRST}, s AS (SELECT regexp_extract(dimension_id, '(?s)^(.*)\\.([^.]*)$', 1) AS entity, trim(evidence) AS evidence, coalesce(surprise, 0.0) AS surprise, ts, seq FROM d WHERE contains(dimension_id, '.') AND trim(evidence) <> ''),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY entity, evidence ORDER BY surprise DESC, ts, seq) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY surprise DESC, ts, seq) AS rank FROM o)
SELECT entity, rank, evidence || CASE WHEN ts > 1000000 THEN ' [' || strftime(make_timestamp(CAST(ts * 1000000 AS BIGINT)), '%Y-%m-%d') || ']' ELSE '' END AS snippet FROM n WHERE rank <= 5""",
    "q12_rendered": f"WITH {_CUR} SELECT '- ' || id || ' = ' || {_best('dist', 'value')} || ' (confidence ' || printf('%.2f', {_best('dist', 'p')}) || ')' AS line FROM cur WHERE len(dist) > 0",
    "math_information": f"""WITH {_CUR}, h AS (SELECT id, dist, coalesce(list_sum(list_transform(dist, lambda x: CASE WHEN x.p > 0 THEN -x.p * log2(x.p) ELSE 0 END)), 0) AS h, {_best("dist", "p")} AS p FROM cur)
SELECT id, round(h, 6) AS entropy, round(CASE WHEN len(dist) <= 1 THEN 1.0 ELSE 1 - h / log2(len(dist)) END, 6) AS certainty, round(CASE WHEN coalesce(p, 0.05) <= 0 THEN 20.0 WHEN coalesce(p, 0.05) >= 1 THEN 0.0 ELSE -log2(coalesce(p, 0.05)) END, 6) AS surprise FROM h""",
    "math2_kl": f"""WITH {_FIRST}, u AS (SELECT id, prior, UNNEST(posterior, recursive := true) FROM d WHERE prior IS NOT NULL AND posterior IS NOT NULL), q AS (SELECT id, p, coalesce(list_filter(prior, lambda x: x.value = u.value)[1].p, 0) AS q FROM u)
SELECT d.id AS delta_id, round(coalesce(sum(CASE WHEN q.p > 0 THEN q.p * log2(q.p / CASE WHEN q.q > 0 THEN q.q ELSE 1e-10 END) ELSE 0 END), 0), 6) AS bits, round(coalesce(sum(sqrt(q.p * q.q)), 0), 6) AS overlap FROM d LEFT JOIN q ON q.id = d.id WHERE d.prior IS NOT NULL AND d.posterior IS NOT NULL GROUP BY d.id""",
    "math5_decay": f"""WITH {_CUR}, g AS (SELECT id, dist, pow(0.5::DOUBLE, greatest(0, 1790000000.0::DOUBLE - last_accessed) / 2592000.0) AS f FROM cur),
m AS (SELECT id, len(dist) AS k, f, UNNEST(dist, recursive := true) FROM g), s AS (SELECT id, value, f * p + (1 - f) / k AS p FROM m)
SELECT id, value, round(p / sum(p) OVER (PARTITION BY id), 6) AS p FROM s UNION ALL SELECT id, 'unknown', 1.0 FROM cur WHERE len(dist) = 0""",
    "math3_mutual_information": f"WITH {_JOINT} SELECT dim_a, dim_b, round(mi, 6) AS mi, round(h_a, 6) AS h_a, round(h_b, 6) AS h_b FROM m",
    "math7_redundant": f"WITH {_JOINT} SELECT DISTINCT dimension FROM (SELECT CASE WHEN h_b > 0 AND mi / h_b >= 0.9 THEN dim_b WHEN h_a > 0 AND mi / h_a >= 0.9 THEN dim_a END AS dimension FROM m) WHERE dimension IS NOT NULL",
    "cpl1_coupling": f"WITH {_CUST} SELECT ea AS entity_a, eb AS entity_b, round(score, 6) AS coupling FROM ok",
    "cpl4_name_similarity": f"WITH {_SIM} SELECT source_entity, target_entity, round(sim, 6) AS similarity, CASE WHEN sim >= 0.6 THEN true ELSE false END AS merge_at_98 FROM m",
    "str_decisions": _fold(_EVENTS) + f"""SELECT entity, 'event_type' AS attribute, 'bayes' AS strategy, {_best("dist", "value")} AS value FROM fin UNION ALL
SELECT entity, 'event_type', 'last_write_wins', arg_max(value, n) FROM c GROUP BY entity UNION ALL
SELECT entity, 'event_type', 'frequency', arg_max(value, ROW(k, latest)) FROM (SELECT entity, value, count(*) AS k, max(n) AS latest FROM c GROUP BY ALL) GROUP BY entity""",
    "str4_retrieved": """WITH h AS (SELECT source AS scenario, contains(lower(text), 'travel budget') OR contains(lower(text), 'pottery') AS hit FROM evidence_events WHERE text IS NOT NULL)
SELECT scenario, CASE WHEN bool_or(hit) THEN count(*) FILTER (hit) ELSE count(*) END AS n FROM h GROUP BY scenario""",
    "prv1_reliability": f"""WITH {_FIRST}, t AS (SELECT id, source_reliability AS c, least(CASE WHEN source IN ('web', 'gossip') THEN 0.2 ELSE 0.9 END, CASE WHEN trim(cascaded_from) <> '' THEN 0.2 ELSE 0.9 END)::DOUBLE AS p FROM d)
SELECT id AS delta_id, round(least(p, c), 6) AS effective, round(c, 6) AS content_only, round(p, 6) AS provenance_only, round(least(c, p), 6) AS hybrid_min, round(greatest(c, p), 6) AS hybrid_max FROM t""",
    "prv6_poisoning": _fold(_POISON + ", " + _POISON_C) + f"""SELECT strategy, tier, m, round(avg(CASE WHEN value = 'W' THEN 100.0 ELSE 0.0 END), 3) AS rate, count(*) AS n_trials FROM (
 SELECT entity, 'bayes' AS strategy, {_best("dist", "value")} AS value FROM fin UNION ALL SELECT entity, 'last_write_wins', arg_max(value, n) FROM c GROUP BY entity UNION ALL
 SELECT entity, 'frequency', arg_max(value, ROW(k, latest)) FROM (SELECT entity, value, count(*) AS k, max(n) AS latest FROM c GROUP BY ALL) GROUP BY entity) JOIN (SELECT DISTINCT entity, tier, m FROM c) USING (entity) GROUP BY ALL""",
    "prv4_laundering": _fold("""c AS (SELECT concat(policy, '/', m) AS entity, policy, m, i AS n, i AS seq, CASE WHEN i <= 4 THEN 'V' ELSE 'W' END AS value, CASE WHEN i <= 4 OR policy = 'naive_inherit' THEN 0.9 ELSE 0.2 END::DOUBLE AS r
 FROM (SELECT policy, m, UNNEST(range(1, 5 + m)) AS i FROM (SELECT UNNEST(['direct', 'naive_inherit', 'taint_propagate']) AS policy) CROSS JOIN (SELECT UNNEST([1, 3, 10, 50]) AS m)))""")
    + f"SELECT policy, m, CASE WHEN {_best('dist', 'value')} = 'W' THEN 100.0 ELSE 0.0 END::DOUBLE AS rate, CAST(1 AS BIGINT) AS n_trials FROM fin JOIN (SELECT DISTINCT entity, policy, m FROM c) USING (entity)",
}
