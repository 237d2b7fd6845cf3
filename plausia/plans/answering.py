"""From a batch of questions to the context for an answering model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import among, broadcast_if_small, materialize
from ..functions.temporal import evidence_line
from ..functions.text import percent
from ..operators import context as C
from ..operators import graph, queries, search
from ..operators.deltas import first_deliveries

#: Fixed value: with so many entities known, a search of the graph goes no further.
MOST_SEEDS = 12


def _believed_relations(shown: DataFrame, beliefs: DataFrame, listed: DataFrame) -> DataFrame:
    """Lines of relations that are believed but not ``listed`` as edges, after the edges of their entity."""
    wide = graph.relations_from_beliefs(beliefs, wide=True).withColumn("_wide", F.lit(True))
    few = graph.relations_from_beliefs(beliefs).withColumn("_wide", F.lit(False))
    fits = shown.join(wide.unionByName(few), "entity").where(F.col("_wide") == (F.col("type") == "relationship"))
    key = [F.lower("entity").alias("e"), F.lower("relation").alias("r"), F.lower("related").alias("t")]
    new = fits.select("*", *key).join(listed, ["question_id", "e", "r", "t"], "left_anti")
    line = F.concat("entity", F.lit(" --"), F.translate("relation", "_", " "), F.lit("--> "), "related", F.lit(" ("), percent(F.col("p")), F.lit(" belief)"))
    return new.select("question_id", "position", F.lit(0).alias("part"), (1 - F.col("p")).alias("k"), line.alias("line"))


def _log_of(deltas: DataFrame, shown: DataFrame) -> DataFrame:
    """The first deliveries of the raw log ``deltas`` whose entity may be ``shown``. Of other rows only what tells the first
    delivery moves."""
    entity = F.regexp_extract("dimension_id", r"(?s)^(.*)\.([^.]*)$", 1)
    kept = F.when(F.col("_among"), F.struct("dimension_id", "prior", "posterior", "surprise", "evidence", "ts"))
    rows = among(deltas, entity, shown.select("entity")).select("id", "seq", kept.alias("_row"))
    return materialize(first_deliveries(rows, "_row").where("_row is not null").select("id", "seq", "_row.*"), "log", "zstd")


def _profiles(shown: DataFrame, beliefs: DataFrame, log: DataFrame, aggregate_observed: bool) -> DataFrame:
    """``entity, lines``: all lines of each shown entity in order."""
    observed = None
    if aggregate_observed:
        seen = queries.observed_values(log).where(F.col("dimension_id").contains("."))
        observed = seen.select(F.regexp_extract("dimension_id", r"(?s)^(.*)\.([^.]*)$", 1).alias("entity"), F.regexp_extract("dimension_id", r"(?s)^(.*)\.([^.]*)$", 2).alias("attribute"), "values")
    about = C.facts(beliefs, observed).select("entity", F.concat_ws("\u0001", "attribute", F.col("line_pos").cast("string")).alias("o"), "line")
    told = queries.top_evidence(log).select("entity", F.concat(F.lit("￿"), F.col("rank").cast("string")).alias("o"), F.col("snippet").alias("line"))
    own = about.unionAll(told).join(shown.select("entity").distinct(), "entity", "left_semi")
    return own.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]).alias("lines"))


def contexts_of_texts(questions: DataFrame, dimensions: DataFrame, deltas: DataFrame, edges: DataFrame, events: DataFrame, top_k: int = 5, aggregate_observed: bool = True) -> tuple[DataFrame, DataFrame]:
    """The contexts of the distinct texts of ``questions(question_id, text)``, each under one of the questions that ask it, and
    which (``_as``) that is for each ``question_id``; ``deltas`` is the raw log.

    Of the entities that share a word with a question, however many, only those are told apart that are shown or searched
    from; evidence is looked for by the word. The log is read for shown entities only, whose lines are made once, and relations
    for questions only that show them.
    """
    repeated = materialize(questions.select("question_id", "text", F.min("question_id").over(Window.partitionBy("text")).alias("_as")), "questions")
    questions = repeated.where("question_id = _as").select("question_id", "text").distinct()
    beliefs = materialize(queries.current_dimensions(dimensions), "beliefs", "zstd")
    registry = materialize(queries.entity_registry(beliefs, edges), "registry")
    types = broadcast_if_small(materialize(questions.select("question_id", C.question_type(F.col("text")).alias("type")), "types"), 500_000)
    few, (asked, members) = (lambda few, groups: (materialize(few, "few"), tuple(materialize(g, "groups") for g in groups)))(*C.mentioned_groups(questions, registry))
    seeds = materialize(C.seeds_or_popular(C.first_mentioned(few, asked, members, max(MOST_SEEDS, top_k)), questions, registry, top_k), "seeds")
    deep = F.when(F.col("type").isin("relationship", "multi-hop"), 2).otherwise(1)
    reached = materialize(graph.traverse(seeds.join(types.select("question_id", deep.alias("hops")), "question_id"), edges, 2, 0.3, MOST_SEEDS), "reached")
    wanted = seeds.select("question_id", "entity").unionAll(few).unionAll(reached.select("question_id", "entity"))
    docs = events.select(F.col("id").alias("doc_id"), "speaker", "text", "ts", "entities")
    limits = F.create_map(*(F.lit(x) for pair in C.EVIDENCE_LIMITS.items() for x in pair))
    hits = search.search_evidence(docs, questions, wanted, max(C.EVIDENCE_LIMITS.values()), (asked, members)).join(types, "question_id").where(F.col("rank") <= limits[F.col("type")])
    hits = materialize(hits.select("question_id", "doc_id", F.col("rank").alias("line_pos")), "hits")
    said = docs.select("doc_id", "text", "ts").join(hits.select("doc_id").distinct(), "doc_id")
    said = materialize(said.select("doc_id", evidence_line(F.col("text"), F.col("ts")).alias("line")), "said", "zstd")  # else a filter on lines makes them of all turns
    evidence = hits.join(said, "doc_id").select("question_id", "line_pos", "line")
    shown = seeds.where(F.col("position") <= top_k)
    found_order = F.row_number().over(Window.partitionBy("question_id").orderBy("depth", "entity"))
    further = reached.withColumn("position", F.lit(top_k) + found_order).where(F.col("position") <= 2 * top_k + 4)
    shown = materialize(shown.select("question_id", "entity", "position").unionByName(further.select("question_id", "entity", "position")), "shown")
    lines = materialize(_profiles(shown, beliefs, _log_of(deltas, shown), aggregate_observed), "profiles", "zstd")
    profiles = shown.join(lines, "entity").select("question_id", "entity", F.posexplode("lines").alias("_at", "line")).select("question_id", "entity", (F.col("_at") + 1).alias("line_pos"), "line")
    relating = types.where(F.col("type").isin(list(C.RELATION_LIMITS)))  # others show no relations
    seeded = shown.where(F.col("position") <= top_k).join(relating, "question_id")
    direct = seeded.join(edges.withColumn("_key", F.lower("source_entity")), F.lower("entity") == F.col("_key"))
    direct = direct.where(F.col("type").isin("relationship", "multi-hop") | (F.col("confidence") >= 0.5))
    lines_of = direct.select("question_id", "position", F.lit(0).alias("part"), (-F.coalesce("confidence", F.lit(0.0))).alias("k"), C.edge_line().alias("line"))
    listed = direct.select(F.lower("entity").alias("e"), F.lower("relation").alias("r"), F.lower("target_entity").alias("t"), "question_id").distinct()
    relation_lines = lines_of.unionByName(_believed_relations(seeded, beliefs, listed))
    hops = reached.join(relating, "question_id", "left_semi").where(F.size("path") >= 3).select("question_id", F.lit(1_000).alias("position"), F.lit(1).alias("part"), F.col("depth").cast("double").alias("k"), C.path_line(F.col("path")).alias("line"))
    rel_order = F.row_number().over(Window.partitionBy("question_id").orderBy("part", "position", "k", "line"))
    relations = materialize(relation_lines.unionByName(hops).select("question_id", rel_order.alias("line_pos"), "line"), "relations")
    return C.assembled(types, profiles, relations, evidence), repeated.select("_as", "question_id")


def build_context(questions: DataFrame, dimensions: DataFrame, deltas: DataFrame, edges: DataFrame, events: DataFrame, top_k: int = 5, aggregate_observed: bool = True) -> DataFrame:
    """``question_id, section, section_pos, line, line_pos``: :func:`contexts_of_texts` for every question."""
    of_text, repeated = contexts_of_texts(questions, dimensions, deltas, edges, events, top_k, aggregate_observed)
    return of_text.withColumnRenamed("question_id", "_as").join(repeated, "_as").select("question_id", "section", "section_pos", "line", "line_pos")


def build_context_text(questions: DataFrame, dimensions: DataFrame, deltas: DataFrame, edges: DataFrame, events: DataFrame, top_k: int = 5, aggregate_observed: bool = True) -> DataFrame:
    """``question_id, text``: :func:`context.context_text` of :func:`build_context`, made once for each distinct text."""
    of_text, repeated = contexts_of_texts(questions, dimensions, deltas, edges, events, top_k, aggregate_observed)
    return C.context_text(of_text).withColumnRenamed("question_id", "_as").join(repeated, "_as").select("question_id", "text")
