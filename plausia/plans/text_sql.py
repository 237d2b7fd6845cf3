"""The queries of text_plans in SQL."""

from __future__ import annotations

from ..functions import metrics, text
from ..operators import context, graph, search
from .belief_plans import _CUR, _best


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_VALUE = "trim(regexp_replace(replace({0}, '_', ' '), '\\s+', ' ', 'g'))"
_ATTRIBUTE = "regexp_replace(lower(replace(replace({0}, ' ', '_'), '-', '_')), '_+', '_', 'g')"
_LETTERS = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_MATCH = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_CORE = "substring(regexp_replace(trim(lower(regexp_replace(trim({0}), '^[^:]{{1,60}}:\\s*', ''))), '\\s+', ' ', 'g'), 1, 120)"
_RELATION = "regexp_replace(" + _ATTRIBUTE.format("relation") + ", '_of$', '')"
_EDGES = f"e AS (SELECT source_entity, {_RELATION} AS relation, target_entity, confidence, evidence, ts FROM relationship_edges)"
_UPPER_FIRST = "substring({0}, 1, 1) <> lower(substring({0}, 1, 1))"
_ENTITY = f"array_to_string(list_transform(string_split({_VALUE}, ' '), lambda w: CASE WHEN {_UPPER_FIRST.format('w')} THEN w ELSE upper(substring(w, 1, 1)) || lower(substring(w, 2)) END), ' ')"
_VALID = f"""CASE WHEN t IS NULL OR t = '' OR length(t) > 60 THEN false WHEN list_contains({_list(graph.GENERIC_TARGETS)}, lower(t)) THEN true WHEN regexp_matches(t, '\\p{{Nd}}') THEN false
 WHEN len(string_split(t, ' ')) > 4 THEN false WHEN list_has_any(string_split(lower(t), ' '), {_list(graph.MARKERS)}) THEN false
 ELSE len(list_filter(string_split(t, ' '), lambda w: {_UPPER_FIRST.format("w")})) > 0 OR list_contains({_list(graph.GENERIC_TARGETS)}, string_split(lower(t), ' ')[-1]) END"""
_PAIR = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in graph.INVERSE.items())

_WORDS = "list_filter(regexp_extract_all(lower({0}), '\\b[a-z0-9][a-z0-9_''-]*\\b'), lambda w: length(w) > 2 AND NOT list_contains(" + _list(text.STOPWORDS) + ", w))"
_STEM = "CASE WHEN length(w) <= 4 THEN w " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) - {len(s)} >= 3 THEN w[:length(w) - {len(s)}]" for s in text.SUFFIXES) + " ELSE w END"
_STEMS = f"list_transform({_WORDS}, lambda w: {_STEM})"
_QWORDS = "list_filter(regexp_extract_all(lower({0}), '\\b[a-z0-9][a-z0-9_-]*\\b'), lambda w: length(w) > 2 AND NOT list_contains(" + _list(text.QUESTION_STOPWORDS) + ", w))"
_QCUT = "CASE " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) > {len(s) + 3} THEN w[:length(w) - {len(s)}]" for s in text.QUESTION_SUFFIXES) + " END"
_QTOKENS = f"list_distinct(list_concat({_QWORDS}, list_filter(list_transform({_QWORDS}, lambda w: {_QCUT}), lambda w: w IS NOT NULL)))"
#: Letters outside ASCII count as word letters, which this dialect's word boundary does not know.
_PLAIN = "regexp_replace(lower({0}), '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{M}}\\p{{C}}]', 'q', 'g')"
_DOCS = "docs AS (SELECT id AS doc_id, speaker, text, ts, entities FROM evidence_events WHERE text IS NOT NULL)"
_INDEX = f"""{_DOCS}, w AS (SELECT doc_id, {_STEMS.format("concat_ws(' ', coalesce(speaker, ''), text)")} AS s FROM docs), size AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(s)) AS mean FROM w),
post AS (SELECT doc_id, len(s) AS dl, term, count(*) AS tf FROM (SELECT doc_id, s, UNNEST(s) AS term FROM w) GROUP BY doc_id, dl, term), idf AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post, size GROUP BY term, n)"""
_ITEMS = "q AS (SELECT item_id AS question_id, text FROM eval_items WHERE item_id % 20 = 0)"
_ROLES = "q AS (SELECT doc_id AS question_id, 'What is the role of ' || subject || '?' AS text, subject FROM documents WHERE doc_id % 20 = 0 AND subject IS NOT NULL)"
_TERMS = f"qt AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, UNNEST({_STEMS.format(_PLAIN.format('text'))}) AS term FROM q) GROUP BY ALL)"
_BM25 = f"{_TERMS}, sc AS (SELECT question_id, doc_id, sum(qtf * idf * tf * {search.K1 + 1} / (tf + {search.K1} * ({1 - search.B} + {search.B} * dl / mean))) AS score FROM post JOIN idf USING (term) JOIN qt USING (term), size GROUP BY ALL)"


def _ranked(scores: str, k: int, same: str = "trim(text)", prefix: str = "") -> str:
    return f"""{prefix}r1 AS (SELECT question_id, s.doc_id, round(score, 6) AS score, ts, {same} AS same FROM {scores} s JOIN docs ON docs.doc_id = s.doc_id),
{prefix}r2 AS (SELECT * FROM {prefix}r1 WHERE score > 0 AND same <> '' QUALIFY row_number() OVER (PARTITION BY question_id, same ORDER BY score DESC, ts DESC NULLS LAST, doc_id) = 1),
{prefix}r3 AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ts DESC NULLS LAST, doc_id) AS rank, doc_id, score FROM {prefix}r2),
{prefix}top AS (SELECT * FROM {prefix}r3 WHERE rank <= {k})"""


_TFIDF = f"""tw AS (SELECT doc_id, {_STEMS.format("text")} AS s FROM docs), tpost AS (SELECT doc_id, len(s) AS dl, term, count(*) AS tf FROM (SELECT doc_id, s, UNNEST(s) AS term FROM tw) GROUP BY doc_id, dl, term),
tidf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM tw)) / (1.0 + count(*))) + 1 AS idf FROM tpost GROUP BY term), tv AS (SELECT doc_id, term, tf / CAST(dl AS DOUBLE) * idf AS w FROM tpost JOIN tidf USING (term)),
tn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM tv GROUP BY doc_id), ql AS (SELECT question_id, len({_STEMS.format(_PLAIN.format("text"))}) AS ql FROM q),
qv AS (SELECT question_id, term, qtf / CAST(ql AS DOUBLE) * idf AS qw FROM qt JOIN ql USING (question_id) JOIN tidf USING (term)), qn AS (SELECT question_id, sqrt(sum(qw * qw)) AS qnorm FROM qv GROUP BY question_id),
tf AS (SELECT question_id, doc_id, sum(w * qw) / any_value(norm * qnorm) AS tfidf FROM tv JOIN qv USING (term) JOIN tn USING (doc_id) JOIN qn USING (question_id) GROUP BY ALL)"""
_TOP = lambda: "SELECT question_id, rank, doc_id, score FROM top"
_NAMES = f"""{_CUR}, ent AS (SELECT DISTINCT entity FROM (SELECT entity FROM cur UNION SELECT source_entity FROM relationship_edges WHERE source_entity IS NOT NULL AND target_entity IS NOT NULL UNION SELECT target_entity FROM relationship_edges WHERE source_entity IS NOT NULL AND target_entity IS NOT NULL) WHERE length(entity) > 2)"""
_WORDSET = "list_distinct(regexp_extract_all({0}, '\\w+'))"
_FOLD = "regexp_replace(lower({0}), '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{M}}\\p{{C}}]', 'q', 'g')"
_MENTIONED = f"""{_NAMES}, en AS (SELECT entity, list_filter(list_distinct(regexp_extract_all(lower(entity), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')), lambda w: NOT list_contains({_list(text.ENTITY_STOPWORDS)}, w)) AS sig FROM ent),
qw AS (SELECT question_id, lower(text) AS low, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS ws FROM q),
men AS (SELECT question_id, entity FROM qw, en WHERE contains(low, lower(entity)) OR (len(sig) > 0 AND len(list_intersect(sig, ws)) = len(sig)) OR len(list_filter(list_intersect(sig, ws), lambda w: length(w) >= 4)) > 0)"""


def _any(cues: list[str], hay: str) -> str:
    return f"len(list_filter({_list(cues)}, lambda c: contains({hay}, c))) > 0"


def _type(text_of: str) -> str:
    low, words = f"trim(lower({text_of}))", _QTOKENS.format(_PLAIN.format(text_of))
    return f"""CASE WHEN {_any(context.TEMPORAL_CUES, low)} THEN 'temporal' WHEN {_any(context.MULTI_HOP_CUES, low)} THEN 'multi-hop' WHEN list_has_any({words}, {_list(context.RELATION_WORDS)}) THEN 'relationship'
 WHEN list_has_any({words}, {_list(context.PROFILE_WORDS)}) OR len(list_filter({_list(context.PROFILE_STARTS)}, lambda c: starts_with({low}, c))) > 0 THEN 'profile' ELSE 'open' END"""


_ASKED = "[" + ", ".join(f"{{'cue': '{w}', 'attribute': '{a}'}}" for w, a in context.ASKED_ATTRIBUTES) + "]"
_FOCUS = "[" + ", ".join(f"{{'w': '{w}', 'a': '{a}'}}" for w, attributes in context.FOCUS.items() for a in attributes) + "]"
_PERCENT = "CAST(round_even({0} * 100, 0) AS INT) || '%'"
_DAY = "CASE WHEN ts > 1000000 THEN CAST(make_timestamp(CAST(floor(ts) * 1000000 AS BIGINT)) AS DATE) END"
_ISO = "strftime({0}, '%Y-%m-%d')"
_WD = "isodow(day) - 1"
_NOTES = f"""CASE phrase WHEN 'yesterday' THEN 'yesterday = ' || {_ISO.format("day - 1")} WHEN 'last week' THEN 'last week = ' || {_ISO.format("day - 7")} || ' to ' || {_ISO.format("day - 1")}
 WHEN 'next month' THEN 'next month = ' || strftime(day + INTERVAL 1 MONTH, '%B %Y') WHEN 'last year' THEN 'last year = ' || (year(day) - 1)
 WHEN 'last friday' THEN 'last friday = ' || {_ISO.format(f"day - CAST(CASE WHEN ({_WD} - 4 + 7) % 7 = 0 THEN 7 ELSE ({_WD} - 4 + 7) % 7 END AS INT)")}
 WHEN 'next mon' THEN 'next mon = ' || {_ISO.format(f"day + CAST(CASE WHEN (0 - ({_WD}) + 7) % 7 = 0 THEN 7 ELSE (0 - ({_WD}) + 7) % 7 END AS INT)")}
 WHEN 'two months ago' THEN 'two months ago = ' || strftime(day - INTERVAL 2 MONTH, '%B %Y') WHEN '3 weekends ago' THEN '3 weekends ago = ' || {_ISO.format("day - 21")} WHEN '10 days ago' THEN '10 days ago = ' || {_ISO.format("day - 10")} ELSE '' END"""
_ANSWERS = "a AS (SELECT doc_id, replace(category, '_', '-') AS category, d.text AS answer, i.text AS truth, d.text AS context, CAST(doc_id % 2 AS DOUBLE) AS judge FROM documents d JOIN eval_items i ON doc_id % 300 + 1 = item_id WHERE d.text IS NOT NULL)"
_TOKENS_OF = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
_SCORES = f"""{_ANSWERS}, n AS (SELECT *, {_MATCH.format("answer")} AS am, {_MATCH.format("truth")} AS tm, {_MATCH.format("context")} AS cm FROM a),
k AS (SELECT *, {_TOKENS_OF.format("am")} AS p, {_TOKENS_OF.format("tm")} AS t, list_filter(string_split(tm, ' '), lambda w: length(w) > 2) AS long FROM n), c AS (SELECT *, CAST(len(list_intersect(list_distinct(p), list_distinct(t))) AS DOUBLE) AS common FROM k),
s AS (SELECT *, CASE WHEN common = 0 THEN 0 ELSE 2 * (common / len(p)) * (common / len(t)) / (common / len(p) + common / len(t)) END AS f1,
 CASE WHEN len(p) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(p, lambda w: list_contains(t, w))) / CAST(len(p) AS DOUBLE) END AS bleu1,
 CASE WHEN tm = '' OR cm = '' THEN 0.0::DOUBLE WHEN contains(cm, tm) THEN 1.0 WHEN len(long) = 0 THEN 0.0 ELSE len(list_filter(long, lambda w: contains(cm, w))) / CAST(len(long) AS DOUBLE) END AS recall FROM c)"""

_WALK = f"""WITH {_EDGES}, l AS (SELECT source_entity AS s, relation AS r, target_entity AS t, max(coalesce(confidence, 0.5)) AS c FROM e WHERE source_entity IS NOT NULL AND target_entity <> '' GROUP BY ALL), k AS (SELECT s, r, t FROM l WHERE c >= 0.3),
q AS (SELECT DISTINCT source_entity AS q FROM e WHERE source_entity <> ''), h1 AS (SELECT q, t, r, row_number() OVER (PARTITION BY q ORDER BY r, t) AS v FROM (SELECT q, t, r FROM q JOIN k ON s = q WHERE t <> q QUALIFY row_number() OVER (PARTITION BY q, t ORDER BY r) = 1)),
h2 AS (SELECT q, k.t, h1.t AS via, h1.r AS r1, k.r AS r2, v FROM h1 JOIN k ON k.s = h1.t WHERE k.t <> q AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.q = h1.q AND x.t = k.t) QUALIFY row_number() OVER (PARTITION BY q, k.t ORDER BY v, k.r) = 1)"""
_REACHED = "SELECT q AS question_id, t AS entity, CAST(1 AS BIGINT) AS depth, concat_ws('>', q, r, t) AS path FROM h1 UNION ALL SELECT q, t, 2, concat_ws('>', q, r1, via, r2, t) FROM h2"

ORACLE_SQL = {
    "src2_point_lookup": "SELECT id, last_accessed, CAST(len(distribution) AS BIGINT) AS n_values FROM dimensions WHERE id = 'Harbourlight.status'",
    "src3_deltas_of": "SELECT id, ts, seq, surprise FROM deltas WHERE dimension_id = 'Harbourlight.status'",
    "src4_events_in_order": "SELECT id, ts, speaker, CAST(len(entities) AS BIGINT) AS n_entities FROM evidence_events",
    "src5_edges_in_order": "SELECT * FROM relationship_edges",
    "src6_missing_texts": "SELECT DISTINCT md5(text) AS text_hash FROM evidence_events WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM evidence_events WHERE source = 'chat' AND text IS NOT NULL)",
    "src9_conversation_turns": "SELECT 's1' AS sample_id, * FROM (VALUES (1, 0, 'Ann: Hello', 1683554160.0::DOUBLE), (1, 1, 'Bob: Hey', 1683554220.0), (2, 0, 'Bob: Hi', 1683626520.0)) AS t(session, turn, text, ts)",
    "snk1_latest_dimensions": f"""WITH l AS (SELECT * FROM dimensions WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_accessed DESC NULLS LAST) = 1), f AS (SELECT id, last_accessed, list_filter(distribution, lambda x: x.value <> 'unknown') AS dist FROM l)
SELECT id, last_accessed, {_best("dist", "value")} AS top FROM f""",
    "snk2_append": "SELECT source, count(*) AS n, sum(seq) AS sum_seq FROM deltas GROUP BY source",
    "snk4_upserted_edges": """SELECT source_entity, relation, target_entity, max(confidence) OVER w AS confidence, evidence, ts FROM relationship_edges WINDOW w AS (PARTITION BY source_entity, relation, target_entity)
QUALIFY row_number() OVER (PARTITION BY source_entity, relation, target_entity ORDER BY ts DESC NULLS LAST, evidence DESC NULLS LAST) = 1""",
    "snk5_cached_edges": "SELECT source_entity, relation, target_entity, confidence, evidence FROM relationship_edges QUALIFY row_number() OVER (PARTITION BY source_entity, relation, target_entity ORDER BY confidence DESC NULLS LAST, ts DESC NULLS LAST, evidence DESC NULLS LAST) = 1",
    "snk6_results": "SELECT item_id, text, lang, category FROM eval_items",
    "ext1_rule_claims": "SELECT c_custkey AS turn_id, 'Customer' || c_custkey AS entity, 'location' AS attribute, upper(n[1:1]) || lower(n[2:]) AS value FROM (SELECT c_custkey, replace(n_name, ' ', '') AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    "ext5_parsed_replies": f"""WITH d AS (SELECT * FROM deltas WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1), f AS (SELECT id, entity, attribute, source_reliability AS r, list_filter(posterior, lambda x: x.value <> 'unknown') AS dist FROM d WHERE entity IS NOT NULL AND attribute IS NOT NULL),
v AS (SELECT id, trim(entity) AS e, trim(attribute) AS a, trim({_best("dist", "value")}) AS v, r FROM f) SELECT id AS turn_id, {_ENTITY.format("e")} AS entity, {_ATTRIBUTE.format("a")} AS attribute, {_VALUE.format("v")} AS value, round(least(1.0, greatest(0.0, coalesce(r, 0.7))), 6) AS reliability FROM v WHERE e <> '' AND a <> '' AND v <> ''""",
    "ext6_worded_reliability": """SELECT id, CASE WHEN regexp_matches(lower(text), '\\b(?:heard|rumou?r|gossip|allegedly|supposedly|someone said)\\b') THEN 0.15 WHEN regexp_matches(lower(text), '\\b(?:maybe|perhaps|might|not sure|possibly|could be)\\b') THEN 0.35
 WHEN regexp_matches(lower(text), '\\b(?:i think|probably|likely|i believe|seems?)\\b') THEN 0.55 WHEN regexp_matches(lower(text), '\\b(?:definitely|certainly|for sure|confirmed|actually|correction|officially)\\b') THEN 0.95 ELSE 0.78 END::DOUBLE AS reliability FROM evidence_events""",
    "ext10_aliases": f"""WITH n AS (SELECT DISTINCT source_entity AS entity FROM relationship_edges WHERE source_entity IS NOT NULL), a AS (SELECT n_name AS alias, n_name AS canonical FROM nation UNION ALL SELECT DISTINCT upper(entity), '#' || upper(entity) FROM n WHERE contains(entity, ' ')),
l AS (SELECT lower(alias) AS k, min(canonical) AS c FROM a GROUP BY 1), k AS (SELECT entity, CASE WHEN entity = '' OR trim(entity) = '' THEN '' ELSE {_ENTITY.format("entity")} END AS f FROM n)
SELECT entity AS written, coalesce((SELECT min(canonical) FROM a WHERE alias = f), (SELECT c FROM l WHERE k = lower(f)), entity) AS entity FROM k""",
    "gr1_stored_edges": f"""WITH {_EDGES}, c AS (SELECT trim(source_entity) AS s, trim(relation) AS r, trim(target_entity) AS t0, trim(regexp_replace(target_entity, '\\s+', ' ', 'g')) AS t, confidence FROM e),
ok AS (SELECT s, r, t0, confidence, CASE WHEN list_contains({_list(graph.SYMMETRIC)}, r) THEN r ELSE CASE r {_PAIR} END END AS inv FROM c WHERE s <> '' AND t0 <> '' AND lower(s) <> lower(t0) AND {_VALID})
SELECT s AS source_entity, r AS relation, t0 AS target_entity, confidence FROM ok UNION ALL SELECT t0, inv, s, confidence FROM ok WHERE inv IS NOT NULL""",
    "gr2_valid_targets": f"WITH s AS (SELECT DISTINCT target, trim(regexp_replace(target, '\\s+', ' ', 'g')) AS t FROM (SELECT UNNEST([target_entity, evidence]) AS target FROM relationship_edges)) SELECT target, {_VALID} AS valid FROM s",
    "gr3_relationships": f"""WITH {_EDGES}, u AS (SELECT source_entity, relation, target_entity, max(confidence) AS confidence FROM e GROUP BY ALL), a AS (SELECT DISTINCT target_entity AS entity FROM u WHERE target_entity <> '')
SELECT entity, source_entity, relation, target_entity, confidence, row_number() OVER (PARTITION BY entity ORDER BY confidence DESC NULLS LAST, relation, target_entity, source_entity) AS rank FROM a JOIN u ON lower(entity) = lower(source_entity)""",
    "gr6_traversal": f"{_WALK} {_REACHED}",
    "gr6_traversal_capped": f"""{_WALK}, n1 AS (SELECT q, count(*) AS n FROM h1 GROUP BY q), c AS (SELECT q, v, count(*) AS n FROM h2 GROUP BY ALL),
o AS (SELECT q, v, 1 + n1.n + coalesce(sum(c.n) OVER (PARTITION BY q ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known FROM c JOIN n1 USING (q)) {_REACHED.replace("FROM h2", "FROM h2 JOIN o USING (q, v) WHERE known < 12")}""",
    "gr8_paths": f"""WITH {_EDGES}, k AS (SELECT DISTINCT source_entity AS s, relation AS r, target_entity AS t FROM e WHERE coalesce(confidence, 0.5) >= 0.3 AND target_entity <> ''), p AS (SELECT DISTINCT source_entity AS a, target_entity AS b FROM e WHERE coalesce(confidence, 0.5) >= 0.3 AND source_entity <> '' AND target_entity <> '' AND source_entity <> target_entity)
SELECT a AS from_entity, b AS to_entity, concat_ws('>', a, r, b) AS path FROM p JOIN k ON s = a AND t = b UNION ALL
SELECT a, b, concat_ws('>', a, x.r, x.t, y.r, b) FROM p JOIN k x ON x.s = a JOIN k y ON y.s = x.t AND y.t = b WHERE x.t <> a AND x.t <> b""",
    "ir1_tokens": f"WITH {_DOCS} SELECT doc_id, array_to_string({_WORDS.format('text')}, ' ') AS tokens, array_to_string({_STEMS.format('text')}, ' ') AS stems, array_to_string(list_sort({_QTOKENS.format('text')}), ' ') AS question_tokens FROM docs",
    "ir3_idf": f"WITH {_INDEX} SELECT term, round(idf, 6) AS idf FROM idf",
    "ir5_bm25": f"WITH {_INDEX}, {_ITEMS}, {_BM25}, {_ranked('sc', 10)} {_TOP()}",
    "ir5_bm25_entities": f"""WITH {_INDEX}, {_ROLES}, {_BM25}, nm AS (SELECT DISTINCT doc_id, UNNEST(list_distinct(list_transform(list_append(coalesce(entities, []), coalesce(speaker, '')), lambda x: lower(x)))) AS name FROM docs),
bo AS (SELECT question_id, doc_id, count(*) * 1.5 AS bonus FROM nm JOIN q ON name = lower(subject) WHERE name <> '' GROUP BY ALL), al AS (SELECT coalesce(sc.question_id, bo.question_id) AS question_id, coalesce(sc.doc_id, bo.doc_id) AS doc_id, coalesce(score, 0) + coalesce(bonus, 0) AS score
 FROM sc FULL JOIN bo ON sc.question_id = bo.question_id AND sc.doc_id = bo.doc_id), {_ranked("al", 10)} {_TOP()}""",
    "ir6_tfidf": f"WITH {_DOCS}, {_ITEMS}, {_TERMS}, {_TFIDF}, sc AS (SELECT question_id, doc_id, tfidf AS score FROM tf), {_ranked('sc', 10)} {_TOP()}",
    "ir7_nearest": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 6) AS cosine FROM n a, n b WHERE a.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rank, doc_id, cosine FROM s QUALIFY rank <= 10""",
    "ir8_hybrid": f"""WITH {_INDEX}, {_ITEMS}, {_BM25}, {_ranked("sc", 30, prefix="f")}, {_TFIDF}, mx AS (SELECT t.question_id, t.doc_id, 0.7 * score + 3.0 * coalesce(tfidf, 0) AS score FROM ftop t LEFT JOIN tf ON tf.question_id = t.question_id AND tf.doc_id = t.doc_id), {_ranked("mx", 10)} {_TOP()}""",
    "ir11_evidence": f"WITH {_INDEX}, {_ITEMS}, {_BM25}, {_ranked('sc', 16, prefix='f')}, {_ranked('ftop', 8, _CORE.format('text'))} {_TOP()}",
    "ir14_mentioned": f"WITH {_ROLES}, {_MENTIONED} SELECT question_id, entity FROM men",
    "q9_answers": f"""WITH {_ROLES}, {_MENTIONED}, ty AS (SELECT question_id, lower(text) AS low FROM q WHERE {_type("text")} = 'profile'), ask AS (SELECT question_id, pos, list_filter({_ASKED}, lambda c: contains(low, c.cue))[pos].attribute AS attribute FROM (SELECT question_id, low, UNNEST(range(1, 1 + len(list_filter({_ASKED}, lambda c: contains(low, c.cue))))) AS pos FROM ty)),
b AS (SELECT entity, attribute, list_filter(dist, lambda x: x.value <> 'unknown') AS dist FROM cur), sure AS (SELECT entity, attribute, {_best("dist", "value")} AS value FROM b WHERE {_best("dist", "p")} >= 0.8)
SELECT question_id, arg_min(value, ROW(entity, pos)) AS answer FROM men JOIN ask USING (question_id) JOIN sure USING (entity, attribute) GROUP BY question_id""",
    "ctx1_question_types": f"SELECT item_id, {_type('text')} AS type FROM eval_items",
    "ctx5_facts": f"""WITH {_CUR}, u AS (SELECT id, entity, attribute, i, dist[i].value AS v, dist[i].p AS p FROM (SELECT *, UNNEST(range(1, 1 + len(dist))) AS i FROM cur)), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, i) AS n FROM u WHERE p > 0.10 AND v <> 'unknown'),
g AS (SELECT entity, attribute, any_value(v) FILTER (n = 1) AS v, any_value(p) FILTER (n = 1) AS p, string_agg(v || ' (' || {_PERCENT.format("p")} || ')', ', ' ORDER BY n) FILTER (n <= 3) AS several FROM r GROUP BY id, entity, attribute)
SELECT entity, attribute, entity || '''s ' || replace(attribute, '_', ' ') || CASE WHEN p > 0.8 THEN ' is ' || v WHEN p > 0.5 THEN ' is likely ' || v || ' (' || {_PERCENT.format("p")} || ')' ELSE ' could be: ' || several END AS line FROM g""",
    "ctx8_edge_lines": f"SELECT source_entity || ' --' || replace(relation, '_', ' ') || '--> ' || target_entity || ' (' || {_PERCENT.format('confidence')} || ' confidence)' AS line FROM relationship_edges WHERE source_entity IS NOT NULL AND target_entity IS NOT NULL AND confidence IS NOT NULL",
    "ctx10_annotations": f"WITH e AS (SELECT id, {_DAY} AS day, UNNEST(['yesterday', 'last week', 'next month', 'last year', 'last friday', 'next mon', 'two months ago', '3 weekends ago', '10 days ago', 'no time at all']) AS phrase FROM evidence_events) SELECT id, phrase, {_NOTES} AS note FROM e WHERE day IS NOT NULL",
    "src7_embedded": "SELECT id, CAST(('0x' || md5(text)[1:2])::INT + ('0x' || md5(text)[3:4])::INT + ('0x' || md5(text)[5:6])::INT + ('0x' || md5(text)[7:8])::INT AS DOUBLE) AS total FROM evidence_events",
    "ctx6_focus": f"""WITH {_ROLES}, {_MENTIONED}, k AS (SELECT question_id, list_filter(list_distinct(string_split_regex(trim(regexp_replace(lower(text), '[^a-z\\s]', '', 'g')), '\\s+')), lambda w: NOT list_contains({_list(context.FOCUS_STOPWORDS)}, w)) AS qw FROM q),
b AS (SELECT entity, attribute, list_filter(dist, lambda x: x.p > 0.10 AND x.value <> 'unknown') AS v, list_distinct(string_split(lower(replace(attribute, '_', ' ')), ' ')) AS nm FROM cur), f AS (SELECT UNNEST({_FOCUS}, recursive := true)),
r AS (SELECT question_id, men.entity, attribute, qw, nm, v, list_filter((SELECT list({{'w': w, 'a': a}}) FROM f), lambda z: list_contains(qw, z.w) AND (list_contains(nm, z.a) OR z.a = lower(attribute))) AS hits FROM men JOIN k USING (question_id) JOIN b ON b.entity = men.entity WHERE len(v) > 0),
s AS (SELECT question_id, entity, attribute, 3 * len(list_intersect(qw, nm)) + 2 * len(list_distinct(list_transform(hits, lambda z: z.w))) + len(list_filter(v, lambda x: list_has_any(string_split_regex(lower(x.value), '\\s+'), qw))) AS score FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY question_id, entity ORDER BY score DESC, attribute) AS n, max(score) OVER (PARTITION BY question_id, entity) AS top FROM s)
SELECT question_id, entity, attribute, score FROM n WHERE (top > 0 AND score > 0 AND n <= 8) OR (top = 0 AND n <= 5)""",
    "ctx9_evidence_lines": f"SELECT id, CASE WHEN text IS NULL THEN NULL ELSE coalesce('[' || {_ISO.format(_DAY)} || '] ', '') || trim(text) END AS line FROM evidence_events",
    "fn_forms": f"SELECT DISTINCT id, {_VALUE.format('id')} AS value, {_ATTRIBUTE.format('id')} AS attribute, {_MATCH.format('id')} AS match, {_LETTERS.format('id')} AS letters, {_CORE.format('id')} AS core FROM dimensions",
    "fn_answers": f"""WITH {_CUR}, v AS (SELECT id, dist[1].value AS a, dist[-1].value AS b FROM cur WHERE len(dist) >= 1), n AS (SELECT *, {_LETTERS.format("a")} AS x, {_LETTERS.format("b")} AS y, lower(a || ' or none') AS low FROM v),
t AS (SELECT *, regexp_extract_all(low, '[a-z0-9.]+') AS ts, regexp_replace(low, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS plain FROM n)
SELECT id, x = y OR (length(y) >= 4 AND (contains(x, y) OR contains(y, x))) AS same, CASE WHEN x || 'and' || y IS NULL THEN NULL ELSE 'both' END AS asserted,
 CASE WHEN try_cast(b AS DOUBLE) IS NOT NULL THEN len(list_filter(ts, lambda s: try_cast(s AS DOUBLE) = try_cast(b AS DOUBLE))) > 0
 ELSE list_contains(ts, lower(b)) OR (contains(low, lower(b)) AND (length(y) >= 4 OR contains(b, '.'))) OR (contains(plain, y) AND length(y) >= 4) END AS hit FROM t""",
    "eval_metrics": f"""WITH {_SCORES} SELECT doc_id, round(f1, 6) AS f1, round(bleu1, 6) AS bleu1, round(recall, 6) AS recall, CASE WHEN am = '' THEN 'api_or_empty_answer' WHEN am = 'unknown' THEN 'unknown_answer' WHEN recall < 0.34 THEN 'retrieval_miss' WHEN f1 = 0 THEN 'answer_miss' WHEN f1 < 0.5 THEN 'partial_answer' ELSE 'good' END AS bucket,
 {_any(metrics.ABSTENTIONS, "lower(truth)")} AS abstains FROM s""",
    "eval5_rescored": f"""WITH {_SCORES}, g AS (SELECT category, count(*) AS n, avg(f1) AS token_f1, avg(bleu1) AS bleu1, avg(judge) AS judge FROM s GROUP BY category), m AS (SELECT 'macro' AS category, CAST(sum(n) AS BIGINT) AS n, avg(token_f1) AS token_f1, avg(bleu1) AS bleu1, avg(judge) AS judge FROM g WHERE list_contains({_list(metrics.CATEGORIES)}, category))
SELECT category, n, round(token_f1, 6) AS token_f1, round(bleu1, 6) AS bleu1, round(judge, 6) AS judge FROM (SELECT * FROM g UNION ALL SELECT * FROM m)""",
}
