"""Queries of answers, observation, rules, seams, relations, calibration and dense retrieval, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import fresh_path
from ..functions import answers, metrics
from ..functions.text import value_form
from ..operators import context, extract, graph, observe, search, trust
from ..operators.deltas import first_deliveries, top_value
from ..sources import store
from . import text_sql
from .belief_plans import _EXPLODE, _FIRST, _fold, event_claims
from .problems import Query, table
from .text_plans import _ranks, evidence, named_edges

#: Questions, in turn, about the documents as if they were answers.
QUESTIONS = [
    "What did the charity race raise awareness for?", "What did Ann research?", "Which career path does Ann want?", "Which activities does Ann partake in?", "What is the room used for?", "What did Ann paint last week?",
    "What are Ann's plans?", "Where does Ann live?",
]
CATEGORIES = ["temporal", "single-hop", "open-domain", "multi-hop", "adversarial"]
_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"


def _listed(values: list[str], i) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def fn10_answers(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    reply = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.col("text").alias("answer")))).otherwise(F.col("text"))
    asked = said.select("doc_id", reply.alias("reply"), _listed(CATEGORIES, F.pmod("doc_id", F.lit(5))).alias("category"), _listed(QUESTIONS, F.pmod("doc_id", F.lit(8))).alias("question"))
    return asked.select("doc_id", "category", answers.answer_text(F.col("reply"), F.col("category"), F.col("question")).alias("answer"))


#: What is said of a customer, one way for each rule, and the attribute that it gives.
SAYINGS = [
    ("employer", "works at {0} Labs."), ("employer", "joined {0} Press last week."), ("former_employer", "left {0} Foods."), ("role", "is a software engineer."), ("location", "is based in {0}."), ("model", "switched to {0} XL."),
    ("model", "powered by {0} Small."), ("project", "is building {0}."), ("preference", "prefers {0} tea."), ("type", "is a translation tool."), ("team", "is on the {0} team."), ("language", "implemented in {0}."),
]
SAID_VALUES = ["{0} Labs", "{0} Press", "{0} Foods", "software engineer", "{0}", "{0} XL", "{0} Small", "{0}", "{0} tea", "translation tool", "{0}", "{0}"]


def _sayings(spark: SparkSession, d: str) -> DataFrame:
    of = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Customer"), F.col("c_custkey").cast("string")).alias("who"), F.concat(F.lit("Place"), F.col("c_nationkey").cast("string")).alias("what"))
    lines = F.array(*(F.struct(F.lit(i).alias("i"), F.concat("who", F.lit(" " + said.split("{0}")[0]), *([F.col("what"), F.lit(said.split("{0}")[1])] if "{0}" in said else [])).alias("text")) for i, (_, said) in enumerate(SAYINGS)))
    return of.select("c_custkey", F.explode(lines).alias("s")).select((F.col("c_custkey") * 12 + F.col("s.i")).alias("turn_id"), F.col("s.text").alias("text"))


def ext2_rules(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_claims(_sayings(spark, d)).select("turn_id", "entity", "attribute", "value")


def _preferences(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Customer"), F.col("o_custkey").cast("string"), F.lit(" prefers "), F.regexp_replace("o_orderpriority", " ", "_"), F.lit("."))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("turn_id"), said.alias("text"), F.col("o_orderkey").cast("double").alias("ts"), F.col("o_orderkey").alias("seq"))


def upd4_observed_deltas(spark: SparkSession, d: str) -> DataFrame:
    log = observe.observe_turns(_preferences(spark, d))["deltas"]
    return log.select("entity", "attribute", F.floor(F.col("seq") / 1_000_000).cast("long").alias("turn_id"), "value", F.round("surprise", 6).alias("surprise"))


def upd4_observed_beliefs(spark: SparkSession, d: str) -> DataFrame:
    states = observe.observe_turns(_preferences(spark, d))["dimensions"]
    return states.select("id", F.explode("distribution").alias("x"), "last_accessed").select("id", "x.value", F.round("x.p", 6).alias("p"), "last_accessed")


def snk3_replaced_events(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "evidence_events")
    kept = store.Store(spark, fresh_path(spark, "store"))
    kept.append("evidence_events", events)
    kept.replace_events(events.where(F.length("id") % 2 == 0).withColumn("text", F.upper("text")))
    kept.replace_events(events.where(F.col("id") < "8").withColumn("text", F.lit("gone")))
    return kept.read("evidence_events").select("id", "text", "ts", "speaker")


def upd6_last_accessed(spark: SparkSession, d: str) -> DataFrame:
    states = observe.believed_states(event_claims(spark, d), "seq")
    return states.select("id", F.size("distribution").cast("long").alias("n_values"), "last_accessed")


def ir13_events(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "evidence_events").where("text is not null").select(F.col("id").alias("turn_id"), "text", "entities", "terms")
    claims = turns.select("turn_id", F.explode(F.arrays_zip(F.coalesce("entities", F.array().cast("array<string>")).alias("entity"), F.coalesce("terms", F.array().cast("array<string>")).alias("value"))).alias("c")).select("turn_id", "c.entity", "c.value")
    out = observe.turn_events(turns.select("turn_id", "text"), claims)
    return out.select("turn_id", "speaker", F.array_join("entities", "|").alias("entities"))


def ext7_parsed_questions(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "relationship_edges").where("source_entity is not null and relation is not null").select("source_entity", "relation").distinct()
    body = F.to_json(F.array(F.struct(F.col("source_entity").alias("entity"), F.col("relation").alias("attribute")), F.struct(F.lit(" ").alias("entity"), F.lit("x").alias("attribute"))))
    replies = pairs.select(F.concat_ws("/", "source_entity", "relation").alias("turn_id"), F.when(F.length("relation") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("reply"))
    return extract.parsed_questions(replies).select("turn_id", "entity", "attribute")


def ext11_split_questions(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "eval_items").where("text is not null").select(F.col("item_id").alias("question_id"), "text")
    words = F.split(F.trim("text"), r"\s+")
    reply = F.when(F.col("question_id") % 3 == 0, F.to_json(F.slice(words, 1, 4))).when(F.col("question_id") % 3 == 1, F.lit("sorry")).otherwise(F.concat(F.lit("```json"), F.to_json(F.slice(words, 1, 2)), F.lit("```")))
    typed = asked.withColumn("type", F.when(F.col("question_id") % 2 == 0, "multi-hop").otherwise("open"))
    return extract.split_questions(typed, asked.select("question_id", reply.alias("reply")))


def ctx2_merged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "deltas").where("entity is not null and attribute is not null and seq is not null").select(
        F.pmod("seq", F.lit(500)).alias("question_id"), F.pmod("seq", F.lit(3)).cast("int").alias("part"), F.when(F.col("seq") % 2 == 0, F.lit("Relevant evidence")).otherwise(F.col("entity")).alias("section"),
        F.pmod("seq", F.lit(4)).cast("int").alias("section_pos"), F.concat_ws(" ", F.lpad(F.col("seq").cast("string"), 12, "0"), "attribute").alias("line"), F.col("seq").cast("int").alias("line_pos"),
    )
    return context.merged_parts(rows)


def gr9_believed_relations(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "relationship_edges").where("source_entity is not null and target_entity is not null and confidence is not null")
    n = F.count(F.lit(1)).cast("double")
    per = edges.groupBy(F.col("source_entity").alias("entity"), F.element_at(F.array(*map(F.lit, graph.RELATIONS)), F.pmod(F.length("relation"), F.lit(16)) + 1).alias("attribute"), F.col("target_entity").alias("value")).agg(n.alias("n"))
    dist = F.array_sort(F.collect_list(F.struct("value", "n")))
    believed = per.groupBy("entity", "attribute").agg(dist.alias("x"), F.sum("n").alias("all")).select("entity", "attribute", F.transform("x", lambda v: F.struct(v["value"].alias("value"), (v["n"] / F.col("all")).alias("p"))).alias("dist"))
    both = graph.relations_from_beliefs(believed, True).withColumn("wide", F.lit(True)).unionByName(graph.relations_from_beliefs(believed).withColumn("wide", F.lit(False)))
    return both.select("wide", "entity", "relation", "related", F.round("p", 6).alias("p"))


TERMS = ["inc", "gmbh", "ltd", "foods", "press", "institute", "consulting", "robotics"]


def gr7_term_boost(spark: SparkSession, d: str) -> DataFrame:
    edges = named_edges(spark, d)
    seeds = edges.where("source_entity <> ''").select(F.col("source_entity").alias("question_id"), F.col("source_entity").alias("entity"), F.lit(1).alias("position")).distinct()
    terms = seeds.select("question_id", F.array(*map(F.lit, TERMS)).alias("words"))
    found = graph.traverse(seeds, edges, 1, 0.7, None, terms)
    return found.select("question_id", "entity", F.array_join("path", ">").alias("path"))


def gr4_added_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "relationship_edges").select("source_entity", "relation", "target_entity", "confidence")
    again = edges.where("confidence >= 0.9").withColumn("target_entity", F.when(F.length("relation") % 2 == 0, F.lit("")).otherwise(F.col("target_entity")))
    out = graph.added_edges(edges, again)
    return out.groupBy("source_entity").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("target_entity") == "").alias("n_empty"))


def ir4_incremental_idf(spark: SparkSession, d: str) -> DataFrame:
    idf = search.incremental_idf(evidence(spark, d), F.concat_ws(" ", F.coalesce("speaker", F.lit("")), "text"), ["doc_id"])
    return idf.select("term", F.round("idf", 6).alias("idf"))


def ir8_dense(spark: SparkSession, d: str) -> DataFrame:
    """Each turn has the vector numbered by the length of its text, each question the vector of its number."""
    docs, vectors = evidence(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    questions = table(spark, d, "eval_items").where(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("question_id"), "text")
    of_docs = docs.select("doc_id", F.length("text").cast("long").alias("v")).join(vectors.withColumnRenamed("doc_id", "v"), "v").select("doc_id", "embedding")
    of_questions = questions.select("question_id").join(vectors.withColumnRenamed("doc_id", "question_id"), "question_id")
    return _ranks(search.hybrid(docs, questions, doc_vectors=of_docs, question_vectors=of_questions))


def prv5_min_cap(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "deltas").where("source_reliability is not null and seq is not null").select("seq", "id", (F.pmod("seq", F.lit(2)) == 0).alias("true_source"), F.col("source_reliability").alias("content"), (F.pmod("seq", F.lit(5)) / 5 + 0.1).alias("tier"))
    return cells.select("seq", F.round(trust.min_capped(F.col("true_source"), F.col("content"), F.col("tier")), 6).alias("reliability"))


def prv8_fragmented(spark: SparkSession, d: str) -> DataFrame:
    first = first_deliveries(table(spark, d, "deltas"), "dimension_id", "entity", "attribute", top_value(F.col("posterior")).alias("top"), "cascaded_from").where("entity is not null and attribute is not null and top is not null")
    kind = F.when(F.col("seq") % 2 == 0, "true").otherwise("poison")
    claims = first.select(F.col("entity").alias("fact"), kind.alias("kind"), "entity", "attribute", F.col("top").alias("value"), F.upper(F.translate("top", "_", " ")).alias("target"))
    return trust.fragmented(claims).select("fact", F.col("n_true").cast("long").alias("n_true"), F.col("n_poison").cast("long").alias("n_poison"), "fragmented")


def eval7_types(spark: SparkSession, d: str) -> DataFrame:
    labels = [*metrics.SESSION_TYPES, "other"]
    rows = table(spark, d, "eval_items").select("item_id", _listed(labels, F.pmod("item_id", F.lit(len(labels)))).alias("label"), (F.pmod("item_id", F.lit(7))).cast("int").alias("number"))
    return rows.select("item_id", metrics.session_type(F.col("label")).alias("session_type"), metrics.conversation_type(F.col("number")).alias("conversation_type"))


def _rated(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("source_reliability") >= 0.8, "high").when(F.col("source_reliability") >= 0.5, "mid").otherwise("low")
    return first_deliveries(table(spark, d, "deltas"), "source_reliability", "evidence").where("source_reliability is not null and evidence is not null").select(level.alias("level"), extract.worded_reliability(F.col("evidence")).alias("reliability"))


def eval8_calibration(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration(_rated(spark, d)).select("level", "n", F.round("mean", 6).alias("mean"))


def eval12_extraction_tax(spark: SparkSession, d: str) -> DataFrame:
    log = first_deliveries(table(spark, d, "deltas"), "evidence", top_value(F.col("posterior")).alias("top")).where("evidence is not null and top is not null")
    outcomes = log.select(metrics.holds_value(F.col("top"), F.col("top")).alias("pinned"), metrics.holds_value(F.col("evidence"), value_form(F.col("top"))).alias("unpinned"))
    return trust.extraction_tax(outcomes).select("n", *(F.round(c, 6).alias(c) for c in ("pinned", "unpinned", "tax")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        fn10_answers, ext2_rules, upd4_observed_deltas, upd4_observed_beliefs, snk3_replaced_events, upd6_last_accessed, ir13_events, ext7_parsed_questions, ext11_split_questions, ctx2_merged, gr4_added_edges, gr7_term_boost, gr9_believed_relations, ir4_incremental_idf, ir8_dense,
        prv5_min_cap, prv8_fragmented, eval7_types, eval8_calibration, eval12_extraction_tax,
    )
}


def _at(values: list[str], i: str) -> str:
    return "[" + ", ".join(map(_QUOTED, values)) + f"][{i} + 1]"


def _rx(pattern: str) -> str:
    """The pattern with its flag where this dialect has it."""
    return _QUOTED(pattern)


_TRIMMED = lambda c: f"regexp_replace({c}, '^[ ,;:]+|[ ,;:]+$', '', 'g')"
_CUT = lambda c, p: f"string_split_regex({c}, {_rx(p)})[1]"
_COUNT = lambda c: f"len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"
_HEAD = lambda c, n: f"array_to_string(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')[1:{n}], ' ')"
_TIMES = ", ".join(f"nullif(trim(regexp_extract(a, {_rx('(?i)' + p)})), '')" for p in answers.TIMES)
_HELD = lambda p: f"regexp_replace({_CUT(f'''regexp_replace(regexp_extract(a, {_rx('(?i)' + p)}, 1), '^[ ,;:\"'']+|[ ,;:\"'']+$', '', 'g')''', answers.REASON)}, '(?i)^(?:a|an|the)\\s+', '')"
_FRAMED = ", ".join(f"CASE WHEN regexp_matches(lower(q), {_rx(asked)}) AND {_COUNT(_HELD(p))} BETWEEN 1 AND 12 THEN {_HELD(p)} END" for asked, frames in answers.FRAMES for p in frames)
_OPENED = "a"
for _p in answers.OPENINGS:
    _OPENED = f"regexp_replace({_OPENED}, {_rx(_p)}, '')"
_SAID = _TRIMMED(_CUT(f"substr(a, length(regexp_extract(a, {_rx(answers.JUDGEMENT)}, 1)) + 1)", r"(?i)\b(?:because|since|as)\b|[.;]"))
_FN10 = f"""WITH r AS (SELECT doc_id, {_at(CATEGORIES, "(doc_id % 5)")} AS category, {_at(QUESTIONS, "(doc_id % 8)")} AS q, trim(text) AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT *, regexp_extract(t, '(?s)\\{{.*?\\}}') AS o FROM r),
b AS (SELECT doc_id, category, q, trim(CASE WHEN doc_id % 3 <> 0 AND json_valid(o) THEN coalesce(json_extract_string(o, '$.answer'), t) ELSE t END) AS x FROM i),
n AS (SELECT doc_id, category, q, trim(regexp_replace(regexp_replace(regexp_replace(x, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g'), '\\s+', ' ', 'g')) AS a FROM b),
s AS (SELECT *, trim(split_part(a, '.', 1)) AS first, {_SAID} AS said, regexp_extract(a, {_rx(answers.JUDGEMENT)}, 1) AS judged, coalesce({_FRAMED}, '') AS framed, {_TRIMMED(f"trim(split_part({_CUT(_OPENED, answers.REASON)}, '.', 1))")} AS fact FROM n)
SELECT doc_id, category, CASE WHEN a = '' THEN a WHEN category = 'temporal' THEN coalesce({_TIMES}, a) WHEN category IN ('single-hop', 'multi-hop') THEN CASE WHEN framed <> '' THEN framed ELSE fact END
 WHEN category = 'open-domain' THEN CASE WHEN judged = '' THEN {_TRIMMED(f"CASE WHEN {_COUNT('first')} > 18 THEN {_HEAD('first', 18)} ELSE first END")} WHEN said = '' THEN judged ELSE {_TRIMMED(f"concat(judged, '; ', {_HEAD('said', 8)})")} END ELSE a END AS answer FROM s"""
_PREFERRED = "c AS (SELECT concat('Customer', o_custkey) AS entity, o_orderpriority AS value, 0.9::DOUBLE AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS seq FROM orders)"
_PICKED = lambda d, v: f"list_filter({d}, lambda x: x.value = {v})[1].p"
_ALNUM = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_HOLDS = lambda a, v: f"""CASE WHEN try_cast({v} AS DOUBLE) IS NOT NULL THEN len(list_filter(regexp_extract_all(lower({a}), '[a-z0-9.]+'), lambda w: coalesce(try_cast(w AS DOUBLE) = try_cast({v} AS DOUBLE), false))) > 0
 ELSE list_contains(regexp_extract_all(lower({a}), '[a-z0-9.]+'), lower({v})) OR (contains(lower({a}), lower({v})) AND (length({_ALNUM(v)}) >= 4 OR contains({v}, '.'))) OR (contains({_ALNUM(a)}, {_ALNUM(v)}) AND length({_ALNUM(v)}) >= 4) END"""  # noqa: E731
_TOPV = "list_filter(posterior, lambda x: x.value <> 'unknown' AND x.p = list_max(list_transform(list_filter(posterior, lambda y: y.value <> 'unknown'), lambda y: y.p)))[1].value"
_WORDED = text_sql.ORACLE_SQL["ext6_worded_reliability"].split(" AS reliability")[0].split("SELECT id, ", 1)[1].replace("lower(text)", "lower(evidence)")
_SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_DENSE = f"""dv AS (SELECT docs.doc_id, embedding AS v FROM docs JOIN embeddings e ON e.vec_id = length(text)), qe AS (SELECT question_id, embedding AS v FROM q JOIN embeddings e ON e.vec_id = question_id),
best AS (SELECT question_id, max(score) AS best FROM ftop GROUP BY question_id),
mx AS (SELECT t.question_id, t.doc_id, {search.DENSE_BM25} * score / CASE WHEN best = 0 THEN 1.0 ELSE best END + coalesce({search.DENSE_COSINE} * list_cosine_similarity(qe.v::DOUBLE[], dv.v::DOUBLE[]), 0) AS score FROM ftop t JOIN best USING (question_id) JOIN qe USING (question_id) LEFT JOIN dv ON dv.doc_id = t.doc_id)"""

ORACLE_SQL = {
    "fn10_answers": _FN10,
    "ext2_rules": "WITH s AS (SELECT c_custkey, c_nationkey, UNNEST(range(12)) AS i FROM customer) SELECT c_custkey * 12 + i AS turn_id, 'Customer' || c_custkey AS entity, "
    + _at([a for a, _ in SAYINGS], "i") + " AS attribute, replace(" + _at(SAID_VALUES, "i") + ", '{0}', 'Place' || c_nationkey) AS value FROM s",
    "upd4_observed_deltas": _fold(_PREFERRED) + f"SELECT entity, 'preference' AS attribute, seq AS turn_id, value, round(CASE WHEN coalesce({_PICKED('prior', 'value')}, 0.05) >= 1 THEN 0.0 ELSE -log2(coalesce({_PICKED('prior', 'value')}, 0.05)) END, 6) AS surprise FROM f WHERE n > 0",
    "upd4_observed_beliefs": _fold(_PREFERRED) + f"SELECT entity || '.preference' AS id, value, round(p, 6) AS p, last_accessed FROM (SELECT entity, seq::DOUBLE AS last_accessed, {_EXPLODE} FROM fin)",
    "snk3_replaced_events": "SELECT id, CASE WHEN id < '8' THEN 'gone' WHEN length(id) % 2 = 0 THEN upper(text) ELSE text END AS text, ts, speaker FROM evidence_events WHERE id IS NOT NULL",
    "upd6_last_accessed": _fold("c AS (SELECT CAST(user_id AS VARCHAR) AS entity, event_type AS value, CASE WHEN value >= 50 THEN 0.9 WHEN value >= 15 THEN 0.6 ELSE 0.25 END::DOUBLE AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) AS seq FROM events)")
    + "SELECT entity || '.event_type' AS id, len(dist)::BIGINT AS n_values, seq AS last_accessed FROM fin",
    "ir13_events": """WITH t AS (SELECT id, text, CASE WHEN contains(text, ':') THEN regexp_replace(split_part(text, ':', 1), '^\\s+|\\s+$', '', 'g') END AS s, entities, terms FROM evidence_events WHERE text IS NOT NULL),
c AS (SELECT id, UNNEST(list_concat(coalesce(entities, []), list_filter(coalesce(terms, []), lambda v: v IS NOT NULL AND len(list_filter(string_split_regex(v, '\\s+'), lambda w: substring(w, 1, 1) <> lower(substring(w, 1, 1)))) > 0))) AS name FROM t),
g AS (SELECT id, list(DISTINCT name) AS names FROM c WHERE name IS NOT NULL GROUP BY id),
k AS (SELECT t.id, CASE WHEN s <> '' AND length(s) <= 80 THEN s END AS speaker, coalesce(names, []) AS names FROM t LEFT JOIN g ON g.id = t.id)
SELECT id AS turn_id, speaker, coalesce(array_to_string(list_sort(list_distinct(CASE WHEN speaker IS NULL THEN names ELSE list_append(names, speaker) END)), '|'), '') AS entities FROM k""",
    "ext7_parsed_questions": f"""WITH p AS (SELECT DISTINCT source_entity, relation FROM relationship_edges WHERE source_entity IS NOT NULL AND relation IS NOT NULL), v AS (SELECT *, trim(source_entity) AS e, trim(relation) AS a FROM p)
SELECT concat_ws('/', source_entity, relation) AS turn_id, {text_sql._ENTITY.format("e")} AS entity, {text_sql._ATTRIBUTE.format("a")} AS attribute FROM v WHERE e <> '' AND a <> ''""",
    "ext11_split_questions": """WITH q AS (SELECT item_id, text, string_split_regex(trim(text), '\\s+') AS w FROM eval_items WHERE text IS NOT NULL),
p AS (SELECT item_id, CASE WHEN len(w) > 12 AND item_id % 2 = 0 AND item_id % 3 <> 1 THEN CASE WHEN item_id % 3 = 0 THEN w[1:3] ELSE w[1:2] END ELSE [text] END AS parts FROM q)
SELECT item_id AS question_id, CAST(i - 1 AS INT) AS part, parts[i] AS text FROM (SELECT item_id, parts, UNNEST(range(1, len(parts) + 1)) AS i FROM p)""",
    "ctx2_merged": """WITH r AS (SELECT seq % 500 AS question_id, CAST(seq % 3 AS INT) AS part, CASE WHEN seq % 2 = 0 THEN 'Relevant evidence' ELSE entity END AS section, CAST(seq % 4 AS INT) AS section_pos, concat_ws(' ', lpad(CAST(seq AS VARCHAR), 12, '0'), attribute) AS line, seq AS line_pos
 FROM deltas WHERE entity IS NOT NULL AND attribute IS NOT NULL AND seq IS NOT NULL),
k AS (SELECT *, min(part) OVER w AS p, first_value(section_pos) OVER (PARTITION BY question_id, section ORDER BY part, section_pos) AS place FROM r WINDOW w AS (PARTITION BY question_id, section)),
m AS (SELECT * FROM k WHERE section = 'Relevant evidence' OR part = p)
SELECT question_id, section, place AS section_pos, line, row_number() OVER (PARTITION BY question_id, section ORDER BY part, line_pos, line) AS line_pos FROM m""",
    "gr9_believed_relations": f"""WITH e AS (SELECT source_entity AS entity, {_at(graph.RELATIONS, "(length(relation) % 16)")} AS attribute, target_entity AS value, count(*) AS n FROM relationship_edges WHERE source_entity IS NOT NULL AND target_entity IS NOT NULL AND confidence IS NOT NULL GROUP BY ALL),
p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY entity, attribute) AS DOUBLE) AS p FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY entity, attribute ORDER BY p DESC, value) AS k FROM p WHERE attribute IS NOT NULL),
b AS (SELECT true AS wide, * FROM r WHERE k <= 5 AND p > 0.10 UNION ALL SELECT false, * FROM r WHERE k <= 1 AND p > 0.30) SELECT wide, entity, attribute AS relation, value AS related, round(p, 6) AS p FROM b WHERE value <> 'unknown'""",
    "gr7_term_boost": f"""WITH {text_sql._EDGES}, k AS (SELECT source_entity AS s, relation AS r, target_entity AS t, max(coalesce(confidence, 0.5)) AS c FROM e WHERE source_entity <> '' AND target_entity <> '' AND source_entity <> target_entity GROUP BY ALL),
w AS (SELECT *, len(list_intersect(list_distinct(string_split_regex(lower(t), '\\s+')), [{", ".join(map(_QUOTED, TERMS))}])) AS shared FROM k)
SELECT s AS question_id, t AS entity, concat_ws('>', s, r, t) AS path FROM w WHERE c * (1 + 0.3 * shared) >= 0.7 QUALIFY row_number() OVER (PARTITION BY s, t ORDER BY r) = 1""",
    "gr4_added_edges": """WITH a AS (SELECT source_entity, relation, target_entity, confidence FROM relationship_edges), b AS (SELECT * FROM a UNION ALL SELECT source_entity, relation, CASE WHEN length(relation) % 2 = 0 THEN '' ELSE target_entity END, confidence FROM a WHERE confidence >= 0.9)
SELECT source_entity, count(*) AS n_edges, count(*) FILTER (target_entity = '') AS n_empty FROM b GROUP BY source_entity""",
    "ir4_incremental_idf": f"""WITH {text_sql._DOCS}, w AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, {text_sql._STEMS.format("concat_ws(' ', coalesce(speaker, ''), text)")} AS s FROM docs),
t AS (SELECT n, UNNEST(list_distinct(s)) AS term FROM w) SELECT term, round(ln((max(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM t GROUP BY term""",
    "ir8_dense": f"""WITH {text_sql._INDEX}, {text_sql._ITEMS}, {text_sql._BM25}, {text_sql._ranked("sc", 30, prefix="f")}, {_DENSE}, {text_sql._ranked("mx", 10)} {text_sql._TOP()}""",
    "prv5_min_cap": "SELECT seq, round(least(CASE WHEN seq % 2 = 0 THEN (seq % 5) / 5.0::DOUBLE + 0.1 ELSE 0.9 END, source_reliability), 6) AS reliability FROM deltas WHERE source_reliability IS NOT NULL AND seq IS NOT NULL",
    "prv8_fragmented": f"""WITH {_FIRST}, v AS (SELECT entity, attribute, seq, {_TOPV} AS top FROM d WHERE entity IS NOT NULL AND attribute IS NOT NULL),
k AS (SELECT entity AS fact, seq % 2 = 0 AS good, attribute, {_ALNUM("top")} AS v, {_ALNUM("upper(translate(top, '_', ' '))")} AS t FROM v WHERE top IS NOT NULL),
g AS (SELECT fact, list(DISTINCT attribute) FILTER (good AND (contains(v, t) OR contains(t, v))) AS a, list(DISTINCT attribute) FILTER (NOT good AND (contains(v, t) OR contains(t, v))) AS b FROM k GROUP BY fact)
SELECT fact, coalesce(len(a), 0)::BIGINT AS n_true, coalesce(len(b), 0)::BIGINT AS n_poison, NOT coalesce(list_has_any(a, b), false) AS fragmented FROM g""",
    "eval7_types": f"""SELECT item_id, CASE {_at([*metrics.SESSION_TYPES, "other"], "(item_id % 7)")} {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in metrics.SESSION_TYPES.items())} ELSE 'other' END AS session_type,
 CASE item_id % 7 {" ".join(f"WHEN {a} THEN '{b}'" for a, b in metrics.CONVERSATION_CATEGORIES.items())} END AS conversation_type FROM eval_items""",
    "eval8_calibration": f"""WITH {_FIRST}, r AS (SELECT CASE WHEN source_reliability >= 0.8 THEN 'high' WHEN source_reliability >= 0.5 THEN 'mid' ELSE 'low' END AS level, {_WORDED} AS r FROM d WHERE source_reliability IS NOT NULL AND evidence IS NOT NULL)
SELECT level, count(*) AS n, round(avg(r), 6) AS mean FROM r GROUP BY level UNION ALL SELECT 'separation', count(*) FILTER (level <> 'mid'), round(avg(r) FILTER (level = 'high') - avg(r) FILTER (level = 'low'), 6) FROM r""",
    "eval12_extraction_tax": f"""WITH {_FIRST}, v AS (SELECT evidence, {_TOPV} AS top FROM d WHERE evidence IS NOT NULL), w AS (SELECT evidence, top, {_SQUEEZED.format("translate(top, '_', ' ')")} AS shown FROM v WHERE top IS NOT NULL),
o AS (SELECT CASE WHEN {_HOLDS("top", "top")} THEN 100.0 ELSE 0 END AS a, CASE WHEN {_HOLDS("evidence", "shown")} THEN 100.0 ELSE 0 END AS b FROM w) SELECT count(*) AS n, round(avg(a), 6) AS pinned, round(avg(b), 6) AS unpinned, round(avg(a) - avg(b), 6) AS tax FROM o""",
}
