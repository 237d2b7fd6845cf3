"""The relationship graph: edges, neighbours, bounded traversal, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import materialize
from ..functions.text import squeezed

#: Relations that hold both ways, and those with an inverse.
SYMMETRIC = ["friend", "partner", "spouse", "sibling", "colleague", "roommate", "neighbor", "classmate"]
INVERSE = {"parent": "child", "child": "parent", "pet": "owner", "owner": "pet", "boss": "employee", "employee": "boss", "mentor": "mentee", "mentee": "mentor"}
RELATIONS = ["friend", "partner", "spouse", "family", "sibling", "parent", "child", "colleague", "mentor", "pet", "owner", "roommate", "neighbor", "boss", "employee", "classmate"]
#: Common nouns that may be a relation's target, and words that no target has.
GENERIC_TARGETS = [
    "kid", "kids", "child", "children", "son", "daughter", "family", "fam", "friend", "friends", "best friend", "husband", "wife", "partner", "spouse", "mother", "father", "mom", "dad", "parent", "parents",
    "grandma", "grandmother", "grandpa", "grandfather", "mentor", "mentors", "teacher", "teachers", "colleague", "colleagues", "roommate", "roommates", "neighbor", "neighbors", "classmate", "classmates",
    "puppy", "pup", "dog", "cat", "kitty", "pet", "pets", "rescue dog", "church friends", "friends from church",
]
MARKERS = [
    "awesome", "great", "supportive", "important", "everything", "love", "reason", "thing", "things", "worth", "helpful", "amazing", "special", "cool",
    "nice", "fun", "work", "activity", "activities", "making", "enjoying",
]


def valid_target(target: Column) -> Column:
    """Whether a phrase can name someone or something: a generic noun, or up to four words without digits and
    vague words, one of them capitalized or the last one generic."""
    t = squeezed(target)
    words = F.split(F.lower(t), " ")
    vague = F.arrays_overlap(words, F.array(*map(F.lit, MARKERS)))
    capital = F.exists(F.split(t, " "), lambda w: F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)))
    return (
        F.when(t.isNull() | (t == "") | (F.length(t) > 60), False).when(F.lower(t).isin(GENERIC_TARGETS), True).when(t.rlike(r"\p{Nd}"), False)
        .when(F.size(words) > 4, False).when(vague, False).otherwise(capital | F.element_at(words, -1).isin(GENERIC_TARGETS))
    )


def stored_edges(edges: DataFrame) -> DataFrame:
    """The edges that a store takes, relations in lower case, each with its inverse if there is one. Blank ends,
    edges to oneself and targets that name nothing are left out."""
    inverse = F.coalesce(F.when(F.col("relation").isin(SYMMETRIC), F.col("relation")), F.element_at(F.create_map(*(F.lit(x) for pair in INVERSE.items() for x in pair)), F.col("relation")))
    clean = edges.withColumn("source_entity", F.trim("source_entity")).withColumn("target_entity", F.trim("target_entity")).withColumn("relation", F.trim(F.lower("relation")))
    clean = clean.where((F.col("source_entity") != "") & (F.col("target_entity") != "") & (F.lower("source_entity") != F.lower("target_entity")) & valid_target(F.col("target_entity")))
    rest = [c for c in edges.columns if c not in ("source_entity", "relation", "target_entity")]
    way = lambda s, r, t: F.struct(s.alias("source_entity"), r.alias("relation"), t.alias("target_entity"))
    both = F.when(inverse.isNotNull(), F.array(way(F.col("source_entity"), F.col("relation"), F.col("target_entity")), way(F.col("target_entity"), inverse, F.col("source_entity")))).otherwise(F.array(way(F.col("source_entity"), F.col("relation"), F.col("target_entity"))))
    return clean.select(F.explode(both).alias("e"), *rest).select("e.*", *rest)


def added_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges as a graph takes them one by one: none is merged, and empty targets stay."""
    return edges.unionByName(more.select(*edges.columns))


def upserted_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """One row per (source, relation, target): the greatest confidence seen, evidence and time of the last."""
    return edges.groupBy("source_entity", "relation", "target_entity").agg(F.max("confidence").alias("confidence"), F.max_by("evidence", F.struct(*order)).alias("evidence"), F.max_by("ts", F.struct(*order)).alias("ts"))


def cached_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """The other rule: the whole edge of greatest confidence, the last of those that tie."""
    best = F.max(F.struct("confidence", *order, F.struct("evidence", "ts").alias("kept")))
    return edges.groupBy("source_entity", "relation", "target_entity").agg(best.alias("b")).select("source_entity", "relation", "target_entity", F.col("b.confidence").alias("confidence"), "b.kept.evidence", "b.kept.ts")


def relationships(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Edges out of each asked ``entity``, ignoring case, with their rank by confidence."""
    found = asked.select("entity", F.lower("entity").alias("_key")).distinct().join(edges.withColumn("_key", F.lower("source_entity")), "_key").drop("_key")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.col("confidence").desc(), "relation", "target_entity")))


def neighbours(edges: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    return edges.where(F.coalesce("confidence", F.lit(0.5)) >= min_confidence)


def traverse(seeds: DataFrame, edges: DataFrame, hops: int = 2, min_confidence: float = 0.3, most_entities: int | None = 15, terms: DataFrame | None = None) -> DataFrame:
    """``question_id, entity, depth, path``: what breadth-first search reaches from each question's seeds
    (``question_id, entity, position``), seeds left out, by the first path in order of parents and edges.

    A node is expanded only while fewer than ``most_entities`` are known, seeds included; one expansion may go
    past that. ``terms`` (``question_id, words``) raises confidence by 0.3 per word that a target shares with
    the question. Names match exactly. Edges are taken in order of relation, target. A question searches ``hops`` deep, or
    less if its seeds have a column ``hops``.
    """
    links = edges.where("source_entity is not null and target_entity <> ''").groupBy("source_entity", "relation", "target_entity").agg(F.max(F.coalesce("confidence", F.lit(0.5))).alias("confidence"))
    if terms is None:
        links = links.where(F.col("confidence") >= min_confidence)
    links = materialize(links, "links") if hops > 1 else links
    own_hops = seeds.groupBy("question_id").agg(F.max("hops").alias("_hops")) if "hops" in seeds.columns else None
    first = seeds.groupBy("question_id", "entity").agg(F.min("position").alias("position"))
    seen = first.select("question_id", "entity", F.lit(0).alias("depth"), F.row_number().over(Window.partitionBy("question_id").orderBy("position", "entity")).cast("long").alias("visit"), F.array("entity").alias("path"))
    for depth in range(1, hops + 1):
        seen = materialize(seen, "visited")
        front = seen.where(F.col("depth") == depth - 1)
        if own_hops is not None:
            front = front.join(own_hops.where(F.col("_hops") >= depth), "question_id", "left_semi")
        step = front.join(links, front["entity"] == links["source_entity"]).select("question_id", F.col("visit").alias("parent"), "relation", "target_entity", "confidence", "path")
        if terms is not None:
            shared = F.size(F.array_intersect(F.array_distinct(F.split(F.lower("target_entity"), r"\s+")), F.col("words")))
            step = step.join(terms, "question_id", "left").where(F.col("confidence") * (1 + 0.3 * F.coalesce(shared, F.lit(0))) >= min_confidence).drop("words")
        new = step.join(seen.select("question_id", F.col("entity").alias("target_entity")), ["question_id", "target_entity"], "left_anti")
        one = new.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", "target_entity").orderBy("parent", "relation"))).where("_n = 1")
        if most_entities is not None:
            known = seen.groupBy("question_id").agg(F.count(F.lit(1)).alias("known"))
            per = one.groupBy("question_id", "parent").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("question_id").orderBy("parent").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            open_parents = per.join(known, "question_id").where(F.col("known") + F.col("before") < most_entities).select("question_id", "parent")
            one = one.join(open_parents, ["question_id", "parent"], "left_semi")
        base = seen.groupBy("question_id").agg(F.max("visit").alias("base"))
        visit = F.row_number().over(Window.partitionBy("question_id").orderBy("parent", "relation", "target_entity"))
        found = one.withColumn("nth", visit).join(base, "question_id").select("question_id", F.col("target_entity").alias("entity"), F.lit(depth).alias("depth"), (F.col("base") + F.col("nth")).alias("visit"), F.concat("path", F.array("relation", "target_entity")).alias("path"))
        seen = seen.unionAll(found)
    return seen.where("depth > 0").select("question_id", "entity", "depth", "path")


def paths_between(pairs: DataFrame, edges: DataFrame, hops: int = 3, min_confidence: float = 0.3) -> DataFrame:
    """``from_entity, to_entity, path``: all simple paths of up to ``hops`` + 1 edges between each pair, nodes
    and relations in turn. Walks of half the length from each end meet in the middle."""
    links = neighbours(edges, min_confidence).where("target_entity <> ''").select("source_entity", "relation", "target_entity").distinct()
    first = links.where("source_entity <> target_entity").select(F.col("source_entity").alias("start"), F.col("target_entity").alias("end"), F.array("source_entity").alias("nodes"), F.array("source_entity", "relation", "target_entity").alias("path"))
    walks = {1: materialize(first, "walks")}  # by number of edges; nodes are all but the last
    for n in range(2, (hops + 2) // 2 + 1):
        longer = walks[n - 1].join(walks[1].select(F.col("start").alias("end"), F.col("end").alias("next"), F.col("path").alias("step")), "end").where(~F.array_contains("nodes", F.col("next")))
        walks[n] = materialize(longer.select("start", F.col("next").alias("end"), F.concat("nodes", F.array("end")).alias("nodes"), F.concat("path", F.slice("step", 2, 2)).alias("path")), "walks")
    done = pairs.where("from_entity = to_entity").select("from_entity", "to_entity", F.array("from_entity").alias("path"))
    apart = pairs.where("from_entity <> to_entity").select("from_entity", "to_entity")
    for n in range(1, hops + 2):
        head, tail = walks[(n + 1) // 2].withColumnsRenamed({"start": "from_entity", "end": "middle"}), walks.get(n // 2)
        if tail is None:
            done = done.unionAll(apart.join(head.withColumnRenamed("middle", "to_entity"), ["from_entity", "to_entity"]).select("from_entity", "to_entity", "path"))
            continue
        rest = tail.select(F.col("start").alias("middle"), F.col("end").alias("to_entity"), F.col("nodes").alias("later"), F.col("path").alias("rest"))
        met = apart.join(head, "from_entity").where(~F.array_contains("nodes", F.col("to_entity"))).join(rest, ["middle", "to_entity"]).where(~F.arrays_overlap("nodes", "later"))
        done = done.unionAll(met.select("from_entity", "to_entity", F.concat("path", F.expr("slice(rest, 2, size(rest) - 1)")).alias("path")))
    return done


def relations_from_beliefs(beliefs: DataFrame, wide: bool = False) -> DataFrame:
    """``entity, relation, related, p``: beliefs on relation attributes, the first over 0.30; or, for questions
    about relationships, the first five over 0.10."""
    limit, least = (5, 0.10) if wide else (1, 0.30)
    ranked = F.slice(F.array_sort(F.transform("dist", lambda x, i: F.struct((-x["p"]).alias("k"), i.alias("i"), x["value"].alias("value"), x["p"].alias("p")))), 1, limit)
    rows = beliefs.where(F.col("attribute").isin(RELATIONS)).select("entity", F.col("attribute").alias("relation"), F.explode(ranked).alias("r"))
    return rows.where((F.col("r.value") != "unknown") & (F.col("r.p") > least)).select("entity", "relation", F.col("r.value").alias("related"), F.col("r.p").alias("p"))
