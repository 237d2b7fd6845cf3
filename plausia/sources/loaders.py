"""Readers of conversation data sets and of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.metrics import CONVERSATION_CATEGORIES
from ..functions.text import parsed_time

_TURNS = "array<struct<speaker:string,text:string>>"
#: Fixed value: the time of a conversation without a readable one, 2023-01-01 UTC.
DEFAULT_START = 1_672_531_200.0
SECONDS_PER_TURN = 60


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """``sample_id, doc``: one JSON document per conversation of a file that holds a list of them."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "array<string>")).alias("doc")).select(F.get_json_object("doc", "$.sample_id").alias("sample_id"), "doc")


def conversation_turns(docs: DataFrame) -> DataFrame:
    """``sample_id, session, turn, text, ts``: turns as ``speaker: text`` in order of session number, a minute
    apart by a counter that runs through the conversation."""
    talk = F.from_json(F.get_json_object("doc", "$.conversation"), "map<string,string>")
    entry = docs.select("sample_id", talk.alias("talk")).select("sample_id", "talk", F.explode("talk").alias("name", "body")).where(F.col("name").rlike(r"^session_\d+$"))
    start = F.coalesce(parsed_time(F.col("talk")["session_1_date_time"]), F.lit(DEFAULT_START))
    own = parsed_time(F.try_element_at("talk", F.concat("name", F.lit("_date_time"))))
    sessions = entry.select("sample_id", F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("session"), F.coalesce(own, start).alias("begins"), F.from_json("body", _TURNS).alias("turns"))
    turns = sessions.select("sample_id", "session", "begins", F.posexplode("turns").alias("turn", "t"))
    nth = F.row_number().over(Window.partitionBy("sample_id").orderBy("session", "turn")) - 1
    text = F.concat(F.coalesce("t.speaker", F.lit("Unknown")), F.lit(": "), F.coalesce("t.text", F.lit("")))
    return turns.withColumn("_nth", nth).select("sample_id", "session", "turn", text.alias("text"), (F.col("begins") + F.col("_nth") * SECONDS_PER_TURN).alias("ts"))


def conversation_questions(docs: DataFrame) -> DataFrame:
    """``sample_id, position, question, answer, category``, adversarial ones left out."""
    qa = F.from_json(F.get_json_object("doc", "$.qa"), "array<struct<question:string,answer:string,category:int>>")
    names = F.create_map(*(F.lit(x) for pair in CONVERSATION_CATEGORIES.items() for x in pair))
    rows = docs.select("sample_id", F.posexplode(qa).alias("position", "q"))
    return rows.select("sample_id", "position", "q.question", "q.answer", names[F.col("q.category")].alias("category")).where("category <> 'adversarial'")


def long_memory_turns(spark: SparkSession, path: str) -> DataFrame:
    """``question_id, session, turn, text, ts``: the user's turns of each item's sessions, dated by session."""
    turn = "struct<role:string,content:string>"
    items = spark.read.schema(f"question_id string, haystack_sessions array<array<{turn}>>, haystack_dates array<string>").json(path, multiLine=True)
    sessions = items.select("question_id", "haystack_dates", F.posexplode("haystack_sessions").alias("session", "turns"))
    date = F.try_element_at("haystack_dates", F.col("session") + 1)
    turns = sessions.select("question_id", "session", F.try_to_timestamp(date).cast("double").alias("ts"), F.posexplode("turns").alias("turn", "t"))
    return turns.where("t.role = 'user'").select("question_id", "session", "turn", F.col("t.content").alias("text"), "ts")


def read_results(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One JSON object a line, blank lines skipped."""
    return spark.read.schema(ddl).json(path)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
