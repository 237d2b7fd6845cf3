"""Claims from text: native rules, and the seam for extractors that call a model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import attribute_form, entity_form, squeezed, value_form

#: The parts of the rule patterns. An entity is a run of capitalized words or a handle; a value is
#: up to five words, ending before a word that opens another clause.
ENTITY = r"(?:[A-Z][a-zA-Z0-9]*(?:\s+[A-Z][a-zA-Z0-9]*)*|[a-z][a-z0-9_]+)"
STOP = r"(?:last|this|next|because|since|for|in|at|on|to|from|and|but|that|which|where|when|who|how|the\s)"
WORD = r"(?:[A-Z0-9][a-zA-Z0-9_\-\.]*|[a-z][a-z0-9_\-\.]+)"
VALUE = rf"{WORD}(?:\s+(?!{STOP}){WORD}){{0,4}}"
JOINED = rf"{WORD}(?:\s+(?!(?:last|this|next|week|month|year|ago|because)){WORD}){{0,3}}"
ROLE = r"(?:[A-Z][a-z]+\s+)*(?:engineer|developer|researcher|scientist|manager|founder|director|lead|analyst|designer|architect)"
KIND = r"(?:[a-z]+\s+){0,4}(?:assistant|tool|platform|system|app|service|library|framework|model|bot|agent|api)"
#: Attribute, what stands between entity and value, the value, what follows it; in this order.
RULES = [
    ("employer", r"(?:works\s+at|is\s+employed\s+(?:at|by))\s+", VALUE, ""),
    ("employer", r"joined\s+", JOINED, ""),
    ("former_employer", r"(?:left|quit|departed\s+from)\s+", VALUE, ""),
    ("role", r"is\s+(?:an?\s+)?", ROLE, ""),
    ("location", r"(?:lives?\s+in|moved?\s+to|is\s+(?:based|located)\s+in|relocated\s+to)\s+", VALUE, ""),
    ("model", r"(?:uses?|is\s+using|switched?\s+to|migrated?\s+to|now\s+uses?)\s+", rf"{WORD}(?:\s+{WORD}){{0,3}}", ""),
    ("model", r"(?:is\s+)?(?:built\s+on|powered\s+by|integrated\s+with)\s+", VALUE, ""),
    ("project", r"is\s+building\s+", ENTITY, ""),
    ("preference", r"prefer(?:s|red)?\s+", VALUE, ""),
    ("type", r"is\s+an?\s+", KIND, ""),
    ("team", r"(?:works?\s+on|is\s+on|joined)\s+the\s+", ENTITY, r"\s+team"),
    ("language", r"(?:is\s+)?(?:written\s+in|built\s+(?:with|using)|implemented\s+in)\s+", VALUE, ""),
]
#: Reliability of how a claim is worded: markers of the rubric's bands, tried in this order, and band middles.
WORDING = [
    (r"\b(?:heard|rumou?r|gossip|allegedly|supposedly|someone said)\b", 0.15), (r"\b(?:maybe|perhaps|might|not sure|possibly|could be)\b", 0.35), (r"\b(?:i think|probably|likely|i believe|seems?)\b", 0.55),
    (r"\b(?:definitely|certainly|for sure|confirmed|actually|correction|officially)\b", 0.95),
]
PLAIN_WORDING = 0.78


def cleaned(c: Column) -> Column:
    """Ends trimmed, leading article and closing punctuation off, blanks single."""
    return squeezed(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^(?:the|a|an)\s+", ""), r"[.,;:!?]+$", ""))


def worded_reliability(text: Column) -> Column:
    out = None
    for pattern, r in WORDING:
        out = F.when(F.lower(text).rlike(pattern), r) if out is None else out.when(F.lower(text).rlike(pattern), r)
    return out.otherwise(PLAIN_WORDING)


def _claim(rule: int, attribute: str) -> Callable[[Column, Column], Column]:
    return lambda hit, place: F.struct(F.lit(rule).alias("rule"), place.alias("place"), F.lit(attribute).alias("attribute"), cleaned(hit["entity"]).alias("entity"), cleaned(hit["value"]).alias("value"))


def _parts(pattern: str) -> Callable[[Column], Column]:
    return lambda match: F.struct(F.regexp_extract(match, pattern, 1).alias("entity"), F.regexp_extract(match, pattern, 2).alias("value"))


def extract_claims(turns: DataFrame) -> DataFrame:
    """``turns`` with its columns and, per claim, entity, attribute, value and position.

    ``turns`` needs ``turn_id`` and ``text``. Every match of every rule counts; of several for one entity and
    attribute of a turn the last one (by rule, then place) stands, in the position of the first. Empty parts
    and claims of a thing about itself are dropped.
    """
    found = []
    for i, (attribute, verb, value, rest) in enumerate(RULES):
        pattern = rf"(?i)({ENTITY})\s+{verb}({value}){rest}"
        hits = F.when(F.col("text").rlike(rf"(?i)\s{verb}"), F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), _parts(pattern)))  # most texts lack most verbs
        found.append(F.transform(F.coalesce(hits, F.array().cast("array<struct<entity:string,value:string>>")), _claim(i, attribute)))
    others = [c for c in turns.columns if c not in ("turn_id", "text")]
    held = turns.where("text is not null").select("turn_id", F.struct(*others, F.lit(0).alias("_")).alias("_turn"), F.explode(reduce(lambda a, b: F.concat(a, b), found)).alias("c"))
    rows = held.select("turn_id", "_turn", "c.*").where("entity <> '' and value <> '' and lower(entity) <> lower(value)")
    per = rows.groupBy("turn_id", "entity", "attribute").agg(F.max_by("value", F.struct("rule", "place")).alias("value"), F.min(F.struct("rule", "place")).alias("first"), F.first("_turn").alias("_turn"))
    claims = per.withColumn("position", F.row_number().over(Window.partitionBy("turn_id").orderBy("first", "entity")))
    return claims.select("turn_id", "entity", "attribute", "value", "position", *(F.col(f"_turn.`{c}`").alias(c) for c in others))


def parsed_claims(replies: DataFrame, default_reliability: float = 0.7) -> DataFrame:
    """Claims in a model's replies (``turn_id, reply``): code fences off, JSON parsed, a list that was cut short
    read up to its last whole object; parts normalized, reliability within 0 and 1 or the default."""
    schema = "array<struct<entity:string,attribute:string,value:string,reliability:string>>"
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("reply"), r"^```[^\n]*\n", ""), r"\s*```\s*$", ""))
    whole = F.from_json(bare, schema, {"mode": "PERMISSIVE"})
    ends = bare.rlike(r"(?s)\]\s*$")
    cut = F.from_json(F.concat(F.regexp_extract(bare, r"(?s)^(.*\})", 1), F.lit("]")), schema)
    rows = replies.select("turn_id", F.posexplode(F.coalesce(F.when(ends, whole), cut, F.array().cast(schema))).alias("position", "c"))
    named = rows.select("turn_id", "position", F.trim("c.entity").alias("entity"), F.trim("c.attribute").alias("attribute"), F.trim("c.value").alias("value"), F.col("c.reliability").alias("r"))
    named = named.where("entity <> '' and attribute <> '' and value <> ''")
    r = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("r").try_cast("double"), F.lit(default_reliability))))
    return named.select("turn_id", "position", entity_form(F.col("entity")).alias("entity"), attribute_form(F.col("attribute")).alias("attribute"), value_form(F.col("value")).alias("value"), r.alias("reliability"))


def resolve_aliases(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities by their canonical names (``alias, canonical``): an exact alias first, else one that differs in
    case only, else unchanged."""
    key = entity_form(F.col("entity"))
    exact = aliases.select(F.col("alias").alias("_exact"), F.col("canonical").alias("_by_name")).dropDuplicates(["_exact"])
    loose = aliases.groupBy(F.lower("alias").alias("_loose")).agg(F.min("canonical").alias("_by_case"))
    named = claims.withColumn("_key", key)
    joined = named.join(exact, F.col("_key") == F.col("_exact"), "left").join(loose, F.lower("_key") == F.col("_loose"), "left")
    return joined.withColumn("entity", F.coalesce("_by_name", "_by_case", "entity")).drop("_key", "_exact", "_by_name", "_loose", "_by_case")


Client = Callable[[list[str]], list[str | None]]


def ask(turns: DataFrame, client: Client, batch: int = 32, attempts: int = 4, wait_seconds: float = 15.0) -> DataFrame:
    """``turn_id, reply`` from a caller's client, called in batches within the tasks. A batch that fails is tried again
    after ``wait_seconds``, twice that, and so on; after ``attempts`` its replies are null. The client must be picklable
    and bring its own credentials."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                replies = [None] * len(part)
                for attempt in range(attempts):
                    try:
                        replies = client(list(part["text"]))
                        break
                    except Exception:  # noqa: BLE001 - one batch must not end the job
                        if attempt + 1 < attempts:
                            time.sleep(wait_seconds * (attempt + 1))
                yield pd.DataFrame({"turn_id": part["turn_id"], "reply": replies})

    return turns.select("turn_id", "text").mapInPandas(call, f"turn_id {dict(turns.dtypes)['turn_id']}, reply string")


def _bare_reply(reply: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[^\n]*\n", ""), r"\s*```\s*$", ""))


def parsed_questions(replies: DataFrame) -> DataFrame:
    """``turn_id, position, entity, attribute`` asked for, in replies (``turn_id, reply``) that list objects with both."""
    pairs = F.from_json(_bare_reply(F.col("reply")), "array<struct<entity:string,attribute:string>>")
    rows = replies.select("turn_id", F.posexplode(pairs).alias("position", "c")).where("trim(c.entity) <> '' and trim(c.attribute) <> ''")
    return rows.select("turn_id", "position", entity_form(F.trim("c.entity")).alias("entity"), attribute_form(F.trim("c.attribute")).alias("attribute"))


#: A question of more words than this, about relationships or over several hops, may be split, into at most so many.
SPLIT_FROM_WORDS, MOST_PARTS = 12, 3


def split_questions(questions: DataFrame, replies: DataFrame) -> DataFrame:
    """``question_id, part, text``: questions with their type (``question_id, text, type``) split by a model's replies
    (``question_id, reply``, a list of texts). Short questions, other types and replies that cannot be read leave the question whole."""
    parts = F.slice(F.from_json(F.trim(F.regexp_replace("reply", "```(?:json)?", "")), "array<string>"), 1, MOST_PARTS)
    long = (F.size(F.split(F.trim("text"), r"\s+")) > SPLIT_FROM_WORDS) & F.col("type").isin("multi-hop", "relationship")
    asked = questions.join(replies.groupBy("question_id").agg(F.min("reply").alias("reply")), "question_id", "left").withColumn("parts", parts)
    usable = long & (F.size("parts") > 0) & F.forall("parts", lambda p: p.isNotNull())
    return asked.select("question_id", F.posexplode(F.when(usable, F.col("parts")).otherwise(F.array("text"))).alias("part", "text"))
