"""Queries p1, p3–p6 over the supplied tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, history, lateness, references, widen

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return references.broken_references(table(spark, d, "deltas"), table(spark, d, "dimensions"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(table(spark, d, "deltas"), table(spark, d, "dimensions"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return history.belief_history(table(spark, d, "deltas")).select("dimension_id", "delta_id")


def p3_history(spark: SparkSession, d: str) -> DataFrame:
    return history.belief_history(table(spark, d, "deltas"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cascade_roots(table(spark, d, "deltas"))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cascade_paths(table(spark, d, "deltas"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cascade_descendants(table(spark, d, "deltas"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lateness.late_deltas(table(spark, d, "deltas"))


def p5_daily(spark: SparkSession, d: str) -> DataFrame:
    return lateness.daily_counts(table(spark, d, "deltas"))


def p5_provisional(spark: SparkSession, d: str) -> DataFrame:
    return lateness.provisional_counts(table(spark, d, "deltas"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return widen.unreadable_cells(table(spark, d, "dimensions"), table(spark, d, "attribute_types"))


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = widen.wide_table(table(spark, d, "dimensions"), table(spark, d, "attribute_types"))
    return wide.select(*(F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in wide.dtypes))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_counts, p3_found, p3_history, p4_found, p4_paths, p4_descendants, p5_found, p5_daily, p5_provisional, p6_found, p6_wide)}

_FIRST = "d AS (SELECT * FROM deltas WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)"
_P1 = f"""WITH {_FIRST},
dim AS (SELECT id, arg_max(CASE WHEN distribution IS NULL THEN 0 ELSE 1 END, last_accessed) AS alive FROM dimensions GROUP BY id),
refs AS (SELECT id, seq, dimension_id, CASE WHEN trim(cascaded_from) <> '' THEN cascaded_from END AS parent,
  strftime(make_timestamp(CAST(ts * 1000000 AS BIGINT)), '%Y-%m') AS m FROM d),
found AS (
  SELECT refs.id AS delta_id, 'dimension_id' AS ref_field, CASE WHEN dim.id IS NULL THEN 'missing' ELSE 'deleted' END AS kind, m AS month_utc
  FROM refs LEFT JOIN dim ON dim.id = refs.dimension_id WHERE refs.dimension_id IS NOT NULL AND (dim.id IS NULL OR dim.alive = 0)
  UNION ALL
  SELECT refs.id, 'cascaded_from', CASE WHEN p.id IS NULL THEN 'missing' ELSE 'later' END, m
  FROM refs LEFT JOIN d p ON p.id = refs.parent WHERE refs.parent IS NOT NULL AND (p.id IS NULL OR p.seq > refs.seq))
"""
_TOP = "list_filter({c}, lambda x: x.value <> 'unknown' AND x.p = list_max(list_transform(list_filter({c}, lambda y: y.value <> 'unknown'), lambda y: y.p)))[1].value"
_VALID = "CASE WHEN valid_time > 1000000 THEN CASE WHEN valid_time >= 1e11 THEN valid_time / 1000.0 ELSE valid_time END END"
_P3 = f"""WITH {_FIRST},
c AS (SELECT dimension_id, id AS delta_id, coalesce({_VALID}, ts) AS valid_from, seq, {_TOP.format(c="posterior")} AS top FROM d),
n AS (SELECT * EXCLUDE (top), trim(regexp_replace(lower(top), '[\\s_]+', ' ', 'g')) AS value FROM c WHERE top IS NOT NULL AND dimension_id IS NOT NULL AND valid_from IS NOT NULL),
v AS (SELECT * FROM n WINDOW w AS (PARTITION BY dimension_id ORDER BY valid_from, seq) QUALIFY lag(value) OVER w IS DISTINCT FROM value)
"""
_P4 = f"""WITH RECURSIVE {_FIRST},
link AS (SELECT id, CASE WHEN trim(cascaded_from) <> '' THEN cascaded_from END AS parent FROM d),
edge AS (SELECT c.id, p.id AS up FROM link c JOIN link p ON p.id = c.parent),
walk AS (SELECT id AS node, id AS at_id, 0 AS depth, [id] AS path, false AS loop FROM link WHERE parent IS NOT NULL
  UNION ALL
  SELECT node, up, depth + 1, list_append(path, up), list_contains(path, up) FROM walk JOIN edge ON edge.id = walk.at_id WHERE NOT loop),
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth DESC) = 1)
"""
_P5 = f"""WITH {_FIRST},
t AS (SELECT id AS delta_id, dimension_id, {_VALID} AS happened, ts, seq FROM d),
e AS (SELECT *, floor(happened / 86400.0) AS day, (floor(happened / 86400.0) + 1) * 86400.0 AS closes FROM t WHERE happened IS NOT NULL AND ts IS NOT NULL),
k AS (SELECT *, CASE WHEN ts > closes + 259200 THEN 'dropped' WHEN ts >= closes THEN 'corrected' ELSE 'in_time' END AS kind FROM e)
"""
_MONTH_NAMES = "['january','february','march','april','may','june','july','august','september','october','november','december']"
_P6 = f"""WITH cell AS (
  SELECT regexp_extract(id, '(?s)^(.*)\\.([^.]*)$', 1) AS entity,
    regexp_replace(lower(regexp_replace(regexp_extract(id, '(?s)^(.*)\\.([^.]*)$', 2), '[\\s-]', '_', 'g')), '_+', '_', 'g') AS attribute,
    last_accessed, regexp_replace({_TOP.format(c="distribution")}, '^\\s+|\\s+$', '', 'g') AS value
  FROM dimensions WHERE contains(id, '.')),
cur AS (SELECT entity, attribute, value, value_type FROM cell JOIN attribute_types USING (attribute)
  QUALIFY row_number() OVER (PARTITION BY entity, attribute ORDER BY last_accessed DESC NULLS LAST, value DESC NULLS LAST) = 1),
t AS (SELECT *,
  CASE WHEN regexp_full_match(value, '[+-]?(\\d{{1,3}}(,\\d{{3}})+|\\d+)') THEN try_cast(replace(value, ',', '') AS BIGINT) END AS as_bigint,
  CASE WHEN regexp_full_match(value, '[+-]?(\\d{{1,3}}(,\\d{{3}})+|\\d+)(\\.\\d+)?') THEN try_cast(replace(value, ',', '') AS DOUBLE) END AS as_double,
  CASE WHEN lower(value) IN ('true', 'yes', '1') THEN true WHEN lower(value) IN ('false', 'no', '0') THEN false END AS as_boolean,
  try_cast(CASE WHEN regexp_full_match(value, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN value
    WHEN regexp_full_match(value, '\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}') THEN concat(value[7:10], '-', value[4:5], '-', value[1:2])
    WHEN regexp_full_match(value, '\\d{{1,2}} [A-Za-z]+ \\d{{4}}') THEN concat(split_part(value, ' ', 3), '-', list_position({_MONTH_NAMES}, lower(split_part(value, ' ', 2))), '-', split_part(value, ' ', 1)) END AS DATE) AS as_date
  FROM cur)
"""
#: The listed attributes of attribute_types, by type.
_TYPES = {
    "string": "employer role location team preference language industry model type status", "bigint": "age headcount contributors", "double": "weekly_hours revenue_musd budget_keur",
    "date": "start_date founded_on deadline", "boolean": "works_remotely is_public open_source",
}
_SHOWN = {"string": "value", "bigint": "as_bigint", "double": "as_double", "date": "strftime(as_date, '%Y-%m-%d')", "boolean": "as_boolean"}
_WIDE = ", ".join(f"max(CASE WHEN attribute = '{a}' THEN {_SHOWN[t]} END) AS {a}" for t, names in _TYPES.items() for a in names.split())

ORACLE_SQL = {
    "p1_found": _P1 + "SELECT * FROM found",
    "p1_counts": _P1 + "SELECT CASE WHEN ref_field = 'dimension_id' THEN 'dimensions' ELSE 'deltas' END AS table_name, kind, month_utc, count(*) AS n_references FROM found GROUP BY ALL",
    "p3_found": _P3 + "SELECT dimension_id, delta_id FROM v",
    "p3_history": _P3 + "SELECT dimension_id, delta_id, value, valid_from, lead(valid_from) OVER (PARTITION BY dimension_id ORDER BY valid_from, seq) AS valid_to FROM v",
    "p4_found": _P4 + """, ring AS (SELECT id AS node, id AS at_id, id AS low FROM link WHERE false)
SELECT node AS delta_id, CASE WHEN loop THEN list_min(path[list_position(path, at_id):]) ELSE at_id END AS root_id, CAST(CASE WHEN loop THEN -1 ELSE depth END AS BIGINT) AS depth FROM last""",
    "p4_paths": _P4 + "SELECT node AS delta_id, at_id AS root_id, CAST(depth AS BIGINT) AS depth, array_to_string(list_reverse(path), '/') AS path FROM last WHERE NOT loop",
    "p4_descendants": _P4 + "SELECT at_id AS ancestor_id, node AS descendant_id, CAST(depth AS BIGINT) AS distance FROM walk WHERE depth > 0 AND node IN (SELECT node FROM last WHERE NOT loop)",
    "p5_found": _P5 + "SELECT delta_id, kind FROM k WHERE kind <> 'in_time'",
    "p5_daily": _P5 + """, r AS (SELECT *, lag(dimension_id) OVER w AS before, happened - lag(happened) OVER w AS gap, first_value(dimension_id) OVER w AS f, last_value(dimension_id) OVER w AS l FROM k WHERE kind <> 'dropped'
  WINDOW w AS (PARTITION BY day ORDER BY happened, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT day, count(*) AS n, any_value(f) AS first_dimension, any_value(l) AS last_dimension, count(*) FILTER (before <> dimension_id) AS n_switches, coalesce(max(gap), 0.0) AS gap FROM r GROUP BY day),
x AS (SELECT day, count(*) FILTER (kind = 'in_time') AS first_n, count(*) FILTER (kind = 'corrected') AS n_corrected, count(*) FILTER (kind = 'dropped') AS n_dropped FROM k GROUP BY day)
SELECT strftime(DATE '1970-01-01' + CAST(x.day AS INT), '%Y-%m-%d') AS day, coalesce(n, 0) AS n_final, first_n AS n_first_published, n_corrected, n_dropped, first_dimension, last_dimension, coalesce(n_switches, 0) AS n_switches, coalesce(round(gap, 3), 0.0) AS longest_gap_s
FROM x LEFT JOIN g ON g.day = x.day""",
    "p5_provisional": _P5 + """, s AS (SELECT day, unnest(range(4)) AS step FROM k GROUP BY day)
SELECT strftime(DATE '1970-01-01' + CAST(s.day AS INT), '%Y-%m-%d') AS day, strftime(DATE '1970-01-01' + CAST(s.day + 1 + step AS INT), '%Y-%m-%d') AS published_on,
  count(*) FILTER (CASE WHEN ts < closes THEN 0 ELSE floor((ts - closes) / 86400.0) + 1 END <= step AND kind <> 'dropped') AS n_so_far FROM s JOIN k ON k.day = s.day GROUP BY s.day, step""",
    "p6_found": _P6 + """SELECT entity, attribute FROM t WHERE value IS NOT NULL AND CASE value_type WHEN 'bigint' THEN as_bigint IS NULL WHEN 'double' THEN as_double IS NULL
WHEN 'boolean' THEN as_boolean IS NULL WHEN 'date' THEN as_date IS NULL ELSE false END""",
    "p6_wide": _P6 + f", w AS (SELECT entity, {_WIDE} FROM t GROUP BY entity) SELECT w.* REPLACE (n.entity AS entity) FROM (SELECT DISTINCT entity FROM cell) n LEFT JOIN w ON w.entity = n.entity",
}
ORACLE_SQL["p4_found"] = ORACLE_SQL["p4_found"].replace(", ring AS (SELECT id AS node, id AS at_id, id AS low FROM link WHERE false)\n", "")
