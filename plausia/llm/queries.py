"""Queries p2 and p7–p10 over the supplied tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leakage, ledger, mixing, names, residue

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(names.typed_names(_table(spark, d, "relationship_edges"), _table(spark, d, "dimensions")))


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return names.name_clusters(names.typed_names(_table(spark, d, "relationship_edges"), _table(spark, d, "dimensions")))


def _turn_batches(spark: SparkSession, d: str) -> list[DataFrame]:
    events = _table(spark, d, "evidence_events")
    imported = F.coalesce(F.col("source") == "import", F.lit(False))
    return [events.where(~imported), events.where(imported)]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return ledger.copies(_turn_batches(spark, d))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.ledger_of(_turn_batches(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_runs(_table(spark, d, "documents"), _table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items")).withColumn("score", F.round("score", 6))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets")), _table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_records(_table(spark, d, "documents")).select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_records(_table(spark, d, "documents")).withColumn("posterior", F.round("posterior", 4))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_clusters, p7_found, p7_counts, p8_found, p8_scores, p9_mixture, p9_shares, p10_found, p10_scores)}

_LETTERS = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_IS_FIELDS = "(len({0}) >= 2 AND list_bool_and([regexp_full_match(f, '(?s)[^:=]*[\\p{{L}}\\p{{N}}][^:=]*[:=].*[\\p{{L}}\\p{{N}}].*') FOR f IN {0}]))"
_FIELDS = "[f FOR f IN string_split_regex({0}, '[;|\\r\\n]+') IF trim(regexp_replace(f, '\\s', ' ', 'g')) <> '']"
_P7 = f"""WITH a AS (SELECT id, text, nullif({_LETTERS.format("speaker")}, '') AS spoken, CASE WHEN contains(text, ':') THEN split_part(text, ':', 1) END AS name FROM evidence_events WHERE id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT *, substr(text, length(name) + 2) AS rest, {_LETTERS.format("name")} AS named, {_FIELDS.format("text")} AS fields FROM a),
c AS (SELECT *, {_FIELDS.format("rest")} AS rest_fields FROM b),
p AS (SELECT *, coalesce(CASE WHEN spoken IS NULL THEN length(name) <= 60 AND named <> ''
  AND NOT ({_IS_FIELDS.format("fields")} AND NOT coalesce(regexp_full_match(rest_fields[1], '(?s)[^:=]*[\\p{{L}}\\p{{N}}][^:=]*[:=].*[\\p{{L}}\\p{{N}}].*'), false)) ELSE named = spoken END, false) AS prefixed FROM c),
q AS (SELECT id, CASE WHEN prefixed THEN coalesce(spoken, named) ELSE spoken END AS speaker_key, CASE WHEN prefixed THEN rest ELSE text END AS body, CASE WHEN prefixed THEN rest_fields ELSE fields END AS fields FROM p),
k AS (SELECT id, speaker_key, CASE WHEN {_IS_FIELDS.format("fields")} THEN array_to_string(list_sort([{_LETTERS.format("f")} FOR f IN fields]), '') ELSE {_LETTERS.format("body")} END AS text_key FROM q),
g AS (SELECT speaker_key, text_key, min(id) AS keep_id, count(*) AS n FROM k GROUP BY ALL)
"""

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_RUNS = "SELECT DISTINCT {0}, array_to_string(w[i:i + 12], ' ') AS run FROM (SELECT {0}, w, UNNEST(range(1, len(w) - 11)) AS i FROM (SELECT {0}, " + _WORDS + " AS w FROM {1} WHERE text IS NOT NULL) WHERE len(w) >= 13)"

ORACLE_SQL = {
    "p8_found": "WITH d AS (" + _RUNS.replace("{0}", "doc_id").replace("{1}", "documents") + "), i AS (" + _RUNS.replace("{0}", "item_id").replace("{1}", "eval_items") + ") SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)",
    "p7_found": _P7 + "SELECT keep_id, id AS copy_id FROM k JOIN g ON g.text_key = k.text_key AND g.speaker_key IS NOT DISTINCT FROM k.speaker_key WHERE id <> keep_id",
    "p7_counts": _P7 + "SELECT keep_id, n FROM g",
}
