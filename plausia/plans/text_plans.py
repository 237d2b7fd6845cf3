"""Queries of sources, extraction, graph, search, context and metrics over the supplied tables, and the same
in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import broadcast_if_small, fresh_path
from ..functions import metrics, temporal, text
from ..operators import context, extract, graph, queries, search
from ..operators.deltas import first_deliveries, top_value
from ..sources import loaders, store
from . import text_sql
from .answering import build_context, build_context_text
from .belief_plans import current
from .problems import Query, table

PHRASES = ["yesterday", "last week", "next month", "last year", "last friday", "next mon", "two months ago", "3 weekends ago", "10 days ago", "no time at all"]
_TALK = (
    '[{"sample_id": "s1", "conversation": {"speaker_a": "Ann", "session_2": [{"speaker": "Bob", "text": "Hi"}], "session_1": [{"speaker": "Ann", "text": "Hello"}, {"speaker": "Bob", "text": "Hey"}],'
    ' "session_1_date_time": "1:56 pm on 8 May, 2023", "session_2_date_time": "2023-05-09 10:00"}, "qa": [{"question": "Who?", "answer": "Ann", "category": 4}, {"question": "Why?", "answer": "no", "category": 5}]}]'
)


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence_events").select(F.col("id").alias("doc_id"), "speaker", "text", "ts", "entities").where("text is not null")


def search_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").where(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("question_id"), "text")


def role_questions(spark: SparkSession, d: str) -> DataFrame:
    about = table(spark, d, "documents").where((F.col("doc_id") % 20 == 0) & F.col("subject").isNotNull())
    return about.select(F.col("doc_id").alias("question_id"), F.concat(F.lit("What is the role of "), "subject", F.lit("?")).alias("text"))


def named_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with relations in one notation, without the preposition."""
    relation = F.regexp_replace(text.attribute_form(F.col("relation")), "_of$", "")
    return table(spark, d, "relationship_edges").withColumn("relation", relation)


def src2_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return store.load(spark, d, "dimensions").where(F.col("id") == "Harbourlight.status").select("id", "last_accessed", F.size("distribution").cast("long").alias("n_values"))


def src3_deltas_of(spark: SparkSession, d: str) -> DataFrame:
    return queries.history(store.load(spark, d, "deltas"), "Harbourlight.status").select("id", "ts", "seq", "surprise")


def src4_events_in_order(spark: SparkSession, d: str) -> DataFrame:
    return store.load(spark, d, "evidence_events").orderBy("ts").select("id", "ts", "speaker", F.size("entities").cast("long").alias("n_entities"))


def src5_edges_in_order(spark: SparkSession, d: str) -> DataFrame:
    return store.load(spark, d, "relationship_edges").orderBy("source_entity", "relation", F.col("confidence").desc())


def src6_missing_texts(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "evidence_events").where("source = 'chat'").select(F.md5("text").alias("text_hash")).distinct()
    return store.missing_texts(table(spark, d, "evidence_events"), cache).select("text_hash")


def stub_vectors(texts: list[str]) -> list[list[float]]:
    """Stands in for an embedding service: four numbers from a hash of the text."""
    import hashlib

    return [[float(b) for b in hashlib.md5(t.encode()).digest()[:4]] for t in texts]


def src7_embedded(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "evidence_events")
    cache = spark.createDataFrame([], "text_hash string, embedding array<float>")
    vectors = store.with_vectors(events, store.embed_missing(events, cache, stub_vectors))
    return vectors.select("id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


def src9_conversation_turns(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.createDataFrame([(_TALK,)], "value string").select(F.explode(F.from_json("value", "array<string>")).alias("doc")).select(F.get_json_object("doc", "$.sample_id").alias("sample_id"), "doc")
    return loaders.conversation_turns(docs)


def snk1_latest_dimensions(spark: SparkSession, d: str) -> DataFrame:
    latest = store.latest_dimensions(table(spark, d, "dimensions"), ["last_accessed"])
    return latest.select("id", "last_accessed", top_value(F.col("distribution")).alias("top"))


def snk2_append(spark: SparkSession, d: str) -> DataFrame:
    """Two halves of the log appended to a new store and read back."""
    s = store.Store(spark, fresh_path(spark, "store"))
    deltas = table(spark, d, "deltas")
    s.append("deltas", deltas.where("source_reliability >= 0.8"))
    s.append("deltas", deltas.where("source_reliability < 0.8 or source_reliability is null"))
    return s.read("deltas").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("sum_seq"))


def snk4_upserted_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.upserted_edges(table(spark, d, "relationship_edges"), ["ts", "evidence"])


def snk5_cached_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.cached_edges(table(spark, d, "relationship_edges"), ["ts", "evidence"]).select("source_entity", "relation", "target_entity", "confidence", "evidence")


def snk6_results(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "results")
    loaders.write_results(table(spark, d, "eval_items"), path)
    return loaders.read_results(spark, path, "item_id long, text string, lang string, category string")


def ext1_rule_claims(spark: SparkSession, d: str) -> DataFrame:
    place = table(spark, d, "customer").join(broadcast_if_small(table(spark, d, "nation"), 10_000), F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.concat(F.lit("Customer"), F.col("c_custkey").cast("string"), F.lit(" lives in "), F.initcap(F.translate("n_name", " ", "")), F.lit("."))
    return extract.extract_claims(place.select(F.col("c_custkey").alias("turn_id"), said.alias("text"))).select("turn_id", "entity", "attribute", "value")


def ext1_turn_claims(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "evidence_events").select(F.col("id").alias("turn_id"), "text")
    return extract.extract_claims(turns).select("turn_id", "entity", "attribute", "value", "position")


def ext5_parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    log = first_deliveries(table(spark, d, "deltas"), "entity", "attribute", top_value(F.col("posterior")).alias("value"), F.col("source_reliability").alias("reliability")).where("entity is not null and attribute is not null")
    body = F.to_json(F.struct("entity", "attribute", "value", "reliability"))
    fenced, cut = F.concat(F.lit("```json\n["), body, F.lit("]\n```")), F.concat(F.lit("["), body, F.lit(',{"entity": "X", "attr'))
    replies = log.select(F.col("id").alias("turn_id"), F.when(F.col("seq") % 2 == 0, fenced).otherwise(cut).alias("reply"))
    return extract.parsed_claims(replies).select("turn_id", "entity", "attribute", "value", F.round("reliability", 6).alias("reliability"))


def ext6_worded_reliability(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence_events").select("id", extract.worded_reliability(F.col("text")).alias("reliability"))


def ext10_aliases(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "relationship_edges").where("source_entity is not null").select(F.col("source_entity").alias("entity")).distinct()
    aliases = table(spark, d, "nation").select(F.col("n_name").alias("alias"), F.col("n_name").alias("canonical")).unionAll(names.where(F.contains("entity", F.lit(" "))).select(F.upper("entity").alias("alias"), F.concat(F.lit("#"), F.upper("entity")).alias("canonical")).distinct())
    return extract.resolve_aliases(names.withColumn("written", F.col("entity")), aliases).select("written", "entity")


def gr1_stored_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.stored_edges(named_edges(spark, d)).select("source_entity", "relation", "target_entity", "confidence")


def gr2_valid_targets(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "relationship_edges").select(F.explode(F.array("target_entity", "evidence")).alias("target")).distinct()
    return said.select("target", graph.valid_target(F.col("target")).alias("valid"))


def gr3_relationships(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.upserted_edges(named_edges(spark, d), ["ts", "evidence"])
    asked = edges.select(F.col("target_entity").alias("entity")).where("entity <> ''").distinct()
    return graph.relationships(edges, asked).select("entity", "source_entity", "relation", "target_entity", "confidence", F.col("rank").cast("long").alias("rank"))


def _self_seeds(edges: DataFrame) -> DataFrame:
    return edges.where("source_entity <> ''").select(F.col("source_entity").alias("question_id")).distinct().select("question_id", F.col("question_id").alias("entity"), F.lit(1).alias("position"))


def gr6_traversal(spark: SparkSession, d: str) -> DataFrame:
    edges = named_edges(spark, d)
    return graph.traverse(_self_seeds(edges), edges, 2, 0.3, None).select("question_id", "entity", F.col("depth").cast("long").alias("depth"), F.array_join("path", ">").alias("path"))


def gr6_traversal_capped(spark: SparkSession, d: str) -> DataFrame:
    edges = named_edges(spark, d)
    return graph.traverse(_self_seeds(edges), edges, 2, 0.3, 12).select("question_id", "entity", F.col("depth").cast("long").alias("depth"), F.array_join("path", ">").alias("path"))


def _linked_pairs(edges: DataFrame) -> DataFrame:
    return graph.neighbours(edges).where("source_entity <> '' and target_entity <> '' and source_entity <> target_entity").select(F.col("source_entity").alias("from_entity"), F.col("target_entity").alias("to_entity")).distinct()


def gr8_paths(spark: SparkSession, d: str) -> DataFrame:
    """Only the paths of at most two edges, as its SQL; ``gr8_paths_whole`` has the default's four."""
    edges = named_edges(spark, d)
    return graph.paths_between(_linked_pairs(edges), edges, hops=1).select("from_entity", "to_entity", F.array_join("path", ">").alias("path"))


def gr8_paths_whole(spark: SparkSession, d: str) -> DataFrame:
    edges = named_edges(spark, d)
    return graph.paths_between(_linked_pairs(edges), edges).select("from_entity", "to_entity", F.array_join("path", ">").alias("path"))


def ir1_tokens(spark: SparkSession, d: str) -> DataFrame:
    e = evidence(spark, d)
    return e.select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"), F.array_join(text.stems(F.col("text")), " ").alias("stems"), F.array_join(F.array_sort(text.question_tokens(F.col("text"))), " ").alias("question_tokens"))


def ir3_idf(spark: SparkSession, d: str) -> DataFrame:
    posted, n, _ = search.indexed(evidence(spark, d), search.turn_text())
    return search.bm25_idf(posted, n).withColumn("idf", F.round("idf", 6))


def _ranks(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


def ir5_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(search.search_turns(evidence(spark, d), search_questions(spark, d)))


def ir5_bm25_entities(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "documents").where((F.col("doc_id") % 20 == 0) & F.col("subject").isNotNull()).select(F.col("doc_id").alias("question_id"), F.col("subject").alias("entity"))
    return _ranks(search.search_turns(evidence(spark, d), role_questions(spark, d), wanted))


def ir6_tfidf(spark: SparkSession, d: str) -> DataFrame:
    scores = search.tfidf(evidence(spark, d), search_questions(spark, d)).withColumnRenamed("tfidf", "score")
    return _ranks(search.ranked(scores, evidence(spark, d), 10))


def ir7_nearest(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return _ranks(search.nearest(v, v.where(F.col("doc_id") % 20 == 0).withColumnRenamed("doc_id", "query_id")))


def ir8_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(search.hybrid(evidence(spark, d), search_questions(spark, d)))


def ir11_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(search.search_evidence(evidence(spark, d), search_questions(spark, d)))


def ir14_mentioned(spark: SparkSession, d: str) -> DataFrame:
    return context.mentioned(role_questions(spark, d), queries.entity_registry(current(spark, d), table(spark, d, "relationship_edges")))


def q9_answers(spark: SparkSession, d: str) -> DataFrame:
    asked = role_questions(spark, d)
    known = queries.entity_registry(current(spark, d), table(spark, d, "relationship_edges"))
    return context.answers_from_beliefs(asked, context.mentioned(asked, known), current(spark, d))


def ctx1_question_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", context.question_type(F.col("text")).alias("type"))


def ctx5_facts(spark: SparkSession, d: str) -> DataFrame:
    return context.facts(current(spark, d)).select("entity", "attribute", "line")


def ctx6_focus(spark: SparkSession, d: str) -> DataFrame:
    asked = role_questions(spark, d)
    known = queries.entity_registry(current(spark, d), table(spark, d, "relationship_edges"))
    return context.focused_attributes(asked, context.mentioned(asked, known), current(spark, d)).withColumn("score", F.col("score").cast("long"))


def ctx8_edge_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relationship_edges").where("source_entity is not null and target_entity is not null and confidence is not null").select(context.edge_line().alias("line"))


def ctx9_evidence_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence_events").select("id", temporal.evidence_line(F.col("text"), F.col("ts")).alias("line"))


def ctx10_annotations(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "evidence_events").select("id", temporal.event_day(F.col("ts")).alias("day"), F.explode(F.array(*map(F.lit, PHRASES))).alias("phrase"))
    return said.where("day is not null").select("id", "phrase", F.array_join(temporal.annotations(F.concat(F.lit("It was "), "phrase", F.lit(".")), F.col("day")), "; ").alias("note"))


def _context_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    t = lambda name: table(spark, d, name)
    return role_questions(spark, d), t("dimensions"), t("deltas"), t("relationship_edges"), t("evidence_events").where("text is not null")


def ctx3_context(spark: SparkSession, d: str) -> DataFrame:
    return build_context(*_context_tables(spark, d))


def ctx11_context_text(spark: SparkSession, d: str) -> DataFrame:
    return build_context_text(*_context_tables(spark, d))


def fn_forms(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("id")
    return table(spark, d, "dimensions").select("id").distinct().select("id", text.value_form(c).alias("value"), text.attribute_form(c).alias("attribute"), text.match_form(c).alias("match"), text.letters_only(c).alias("letters"), text.core_text(c).alias("core"))


def fn_answers(spark: SparkSession, d: str) -> DataFrame:
    c = current(spark, d)
    both = c.where(F.size("dist") >= 1).select("id", F.col("dist")[0]["value"].alias("a"), F.element_at("dist", -1)["value"].alias("b"))
    a, b = F.col("a"), F.col("b")
    return both.select("id", text.same_answer(a, b).alias("same"), text.asserted(F.concat_ws(" and ", a, b), a, b).alias("asserted"), text.hit(F.concat_ws(" or ", a, F.lit("none")), b).alias("hit"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    pairs = docs.where("text is not null").join(broadcast_if_small(items.select("item_id", "category", F.col("text").alias("ground_truth")), 10_000), F.pmod("doc_id", F.lit(300)) + 1 == F.col("item_id"))
    return pairs.select("doc_id", F.translate("category", "_", "-").alias("category"), F.col("text").alias("answer"), "ground_truth", F.col("text").alias("context"), (F.col("doc_id") % 2).cast("double").alias("judge"))


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    a, t = F.col("answer"), F.col("ground_truth")
    m = _answers(spark, d).withColumn("f1", metrics.token_f1(a, t)).withColumn("recall", metrics.context_recall(F.col("context"), t))
    return m.select("doc_id", F.round("f1", 6).alias("f1"), F.round(metrics.bleu1(a, t), 6).alias("bleu1"), F.round("recall", 6).alias("recall"), metrics.failure_bucket(a, F.col("f1"), F.col("recall")).alias("bucket"), metrics.abstains(t).alias("abstains"))


def eval5_rescored(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rescored(_answers(spark, d)).select("category", "n", *(F.round(c, 6).alias(c) for c in ("token_f1", "bleu1", "judge")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        src2_point_lookup, src3_deltas_of, src4_events_in_order, src5_edges_in_order, src6_missing_texts, src7_embedded, src9_conversation_turns, snk1_latest_dimensions, snk2_append, snk4_upserted_edges, snk5_cached_edges, snk6_results,
        ext1_rule_claims, ext1_turn_claims, ext5_parsed_replies, ext6_worded_reliability, ext10_aliases, gr1_stored_edges, gr2_valid_targets, gr3_relationships, gr6_traversal, gr6_traversal_capped, gr8_paths, gr8_paths_whole,
        ir1_tokens, ir3_idf, ir5_bm25, ir5_bm25_entities, ir6_tfidf, ir7_nearest, ir8_hybrid, ir11_evidence, ir14_mentioned, q9_answers, ctx1_question_types, ctx3_context, ctx5_facts, ctx6_focus, ctx8_edge_lines, ctx9_evidence_lines, ctx10_annotations, ctx11_context_text,
        fn_forms, fn_answers, eval_metrics, eval5_rescored,
    )
}
ORACLE_SQL = text_sql.ORACLE_SQL
