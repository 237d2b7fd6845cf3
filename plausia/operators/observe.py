"""From text turns to the whole state of the store: events, change log, beliefs, edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.info import UNKNOWN
from ..functions.text import value_form
from .beliefs import DEFAULT_RELIABILITY, beliefs, change_log, claims_of
from .extract import extract_claims
from .graph import RELATIONS, stored_edges

#: Text before the first colon of a turn names its speaker if it has at most so many characters.
LONGEST_SPEAKER = 80


@dataclass(frozen=True)
class Settings:
    """What a caller may choose, passed on explicitly; nothing is read from the environment."""

    reliability: float = DEFAULT_RELIABILITY
    source: str = "user"
    most_evidence: int = 10
    hops: int = 2
    min_confidence: float = 0.3


def turn_speaker(text: Column) -> Column:
    """The speaker written before the first colon, or null."""
    name = F.trim(F.regexp_replace(F.substring_index(text, ":", 1), r"^\s+|\s+$", ""))
    return F.when((F.instr(text, ":") > 0) & (name != "") & (F.length(name) <= LONGEST_SPEAKER), name)


def turn_events(turns: DataFrame, claims: DataFrame) -> DataFrame:
    """``turns`` with ``speaker`` and ``entities``: in order of name the speaker, the entities of the turn's claims, and
    values with a capitalized word. Turns without claims have their speaker alone, or none."""
    capital = F.exists(F.split("value", r"\s+"), lambda w: F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)))
    named = claims.select("turn_id", F.explode(F.array_compact(F.array(F.col("entity"), F.when(capital, F.col("value"))))).alias("name")).distinct()
    per = named.groupBy("turn_id").agg(F.collect_list("name").alias("names"))
    said = turns.withColumn("speaker", turn_speaker(F.col("text"))).join(per, "turn_id", "left")
    every = F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array_compact(F.array("speaker")))
    return said.withColumn("entities", F.array_sort(F.array_distinct(every))).drop("names")


def believed_states(claims: DataFrame, time: str = "ts") -> DataFrame:
    """``id, entity, attribute, distribution, last_accessed``: the fold of the claims with the time of the last one."""
    latest = claims.groupBy("entity", "attribute").agg(F.max(time).alias("last_accessed"))
    return beliefs(claims).join(latest, ["entity", "attribute"]).select(F.concat_ws(".", "entity", "attribute").alias("id"), "entity", "attribute", F.col("dist").alias("distribution"), "last_accessed")


def observe_turns(turns: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """``events``, ``claims``, ``deltas``, ``dimensions`` and ``edges`` of ``turns(turn_id, text, ts, seq)``.

    Claims follow each other by ``seq`` and their place in the turn. A claim with a relation as attribute is also an
    edge, and its inverse, if it names someone.
    """
    found = extract_claims(turns).select("turn_id", "entity", "attribute", value_form(F.col("value")).alias("value"), "position", "ts", "seq")
    order = (F.col("seq") * 1_000_000 + F.col("position")).cast("long")
    claims = found.select("turn_id", "entity", "attribute", "value", F.lit(settings.reliability).alias("reliability"), order.alias("seq"), "ts")
    folded = claims_of(claims, F.col("entity"), F.col("attribute"), F.col("value"), F.col("reliability"), F.col("seq")).join(claims.select("entity", "attribute", "seq", "ts"), ["entity", "attribute", "seq"])
    related = claims.where(F.col("attribute").isin(RELATIONS) & (F.col("value") != UNKNOWN)).join(turns.select("turn_id", "text"), "turn_id")
    edges = stored_edges(related.select(F.col("entity").alias("source_entity"), F.col("attribute").alias("relation"), F.col("value").alias("target_entity"), F.col("reliability").alias("confidence"), F.col("text").alias("evidence"), "ts"))
    return {"events": turn_events(turns, found), "claims": claims, "deltas": change_log(folded), "dimensions": believed_states(folded), "edges": edges}
