"""Text functions, search, extraction, context, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from plausia.cluster import fresh_path
from plausia.functions import metrics, temporal, text
from plausia.operators import beliefs, context, extract, search
from plausia.plans import answering
from plausia.schema import CLAIMS, DIST_DDL
from plausia.sources import loaders, store
from plausia.streaming import ingest
from tests.data import deltas, dimensions, got


def scalar(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_stems(spark):
    cases = {"painting": "paint", "paints": "paint", "relaxing": "relax", "nation": "nation", "happiness": "happi", "payment": "pay", "walked": "walk", "teacher": "teach", "boxes": "box", "quickly": "quick", "this": "this", "bus": "bus"}
    assert {k: scalar(spark, text.stem(F.lit(k))) for k in cases} == cases


def test_forms(spark):
    one = lambda f, s: scalar(spark, f(F.lit(s)))
    assert one(text.value_form, " dark_mode  x ") == "dark mode x" and one(text.attribute_form, "Start - Date") == "start_date"
    assert one(text.entity_form, "ann_lee of IBM") == "Ann Lee Of IBM" and one(text.match_form, "It's 5 o'clock!") == "it s 5 o clock"
    assert one(text.core_text, "Ann:  Hello   There") == "hello there" and one(text.percent, 0.025) == "2%" and one(text.percent, 0.575) == "57%"
    assert one(text.parsed_time, "1:56 pm on 8 May, 2023") == 1_683_554_160.0 and one(text.parsed_time, "2023-05-09") == 1_683_590_400.0 and one(text.parsed_time, "soon") is None
    assert scalar(spark, text.hit(F.lit("about 30.0 of them"), F.lit("30"))) is True and scalar(spark, text.hit(F.lit("a b"), F.lit("c"))) is False
    assert [scalar(spark, text.asserted(F.lit(a), F.lit("Postgres"), F.lit("Mongo"))) for a in ("postgres!", "mongo", "postgres, not mongo", "?")] == ["true", "poison", "both", "other"]


def test_golden_bm25(spark):
    docs = spark.createDataFrame([(0, "Ann", "Ann paints landscapes every weekend", 1.0, []), (1, "Bob", "Painting is relaxing, painting helps Bob", 2.0, []), (2, "Ann", "The weekend market sells landscapes", 3.0, ["Market"])], "doc_id int, speaker string, text string, ts double, entities array<string>")
    q = spark.createDataFrame([(1, "painting landscapes")], "question_id int, text string")
    out = {r.doc_id: r.score for r in search.search_turns(docs, q).collect()}
    assert out == {0: 0.915766, 1: 0.658974, 2: 0.496277}
    wanted = spark.createDataFrame([(1, "market"), (1, "ann")], "question_id int, entity string")
    ranked = {r.doc_id: (r.rank, r.score) for r in search.search_turns(docs, q, wanted).collect()}
    assert ranked[2] == (1, 3.496277) and ranked[0] == (2, 2.415766)
    assert got(search.search_turns(docs.limit(0), q)) == [] and search.hybrid(docs, q).count() == 3


def test_nearest(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.random() - 0.5 for _ in range(8)]) for i in range(200)] + [(200, [0.0] * 8), (201, None)]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    asked = v.where("doc_id % 20 = 0 and doc_id < 200").withColumnRenamed("doc_id", "query_id")
    a, b = got(search.nearest(v, asked, 5)), got(search.nearest(v.repartition(5), asked, 5, block_rows=3))
    assert a == b and len(a) == 50 and all(r[3] == 1.0 and r[0] == r[2] for r in a if r[1] == 1)
    assert scalar(spark, search.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.70710678)


@pytest.mark.parametrize(("said", "claim"), [
    ("Mirela works at Quellwerk Labs.", ("Mirela", "employer", "Quellwerk Labs")), ("Tarek joined Obermann last week.", ("Tarek", "employer", "Obermann")), ("Runa quit Halden Press.", ("Runa", "former_employer", "Halden Press")),
    ("Joska is a senior engineer.", ("Joska", "role", "senior engineer")), ("Edda relocated to Port Velden.", ("Edda", "location", "Port Velden")), ("Ines is located in Tolmein.", ("Ines", "location", "Tolmein")),
    ("Orla switched to Kestrel XL.", ("Orla", "model", "Kestrel XL")), ("Ferrybot integrated with Lumen Small.", ("Ferrybot", "model", "Lumen Small")), ("Bram is building Ferrybot.", ("Bram", "project", "Ferrybot")),
    ("Nilo preferred paper tickets.", ("Nilo", "preference", "paper tickets")), ("Ferrybot is a timetable assistant.", ("Ferrybot", "type", "timetable assistant")), ("Petra is on the Harbour team.", ("Petra", "team", "Harbour")), ("Ferrybot implemented in Elixir.", ("Ferrybot", "language", "Elixir")),
])
def test_rules(spark, said, claim):
    out = extract.extract_claims(spark.createDataFrame([(1, said), (2, None), (3, "")], "turn_id int, text string"))
    assert claim in [(r.entity, r.attribute, r.value) for r in out.collect()]


def test_replies_and_aliases(spark):
    whole = json.dumps([{"entity": "ann_lee", "attribute": "Home Town", "value": " Oslo_x ", "reliability": 3}, {"entity": "", "attribute": "a", "value": "b"}, {"entity": "Bo", "attribute": "a", "value": 5}])
    replies = spark.createDataFrame([(1, f"```json\n{whole}\n```"), (2, whole[:-30]), (3, "sorry"), (4, None)], "turn_id int, reply string")
    out = got(extract.parsed_claims(replies).select("turn_id", "entity", "attribute", "value", "reliability"))
    assert out == [(1, "Ann Lee", "home_town", "Oslo x", 1.0), (1, "Bo", "a", "5", 0.7), (2, "Ann Lee", "home_town", "Oslo x", 1.0)]
    named = spark.createDataFrame([("i",), ("bob",), ("Cy",)], "entity string")
    aliases = spark.createDataFrame([("I", "Ann"), ("BOB", "Robert")], "alias string, canonical string")
    assert [r.entity for r in extract.resolve_aliases(named, aliases).orderBy("entity").collect()] == ["Ann", "Cy", "Robert"]

    def client(texts):
        if "boom" in texts:
            raise OSError("no service")
        return [t.upper() for t in texts]

    turns = spark.createDataFrame([(1, "a"), (2, "boom")], "turn_id int, text string").repartition(2, "turn_id")
    assert got(extract.ask(turns, client, batch=1)) == [(1, "A"), (2, None)]


DATES = {
    "yesterday": "2023-07-11", "tomorrow": "2023-07-13", "last week": "2023-07-05 to 2023-07-11", "next week": "2023-07-13 to 2023-07-19", "this month": "July 2023", "last month": "June 2023", "next month": "August 2023", "last year": "2022",
    "last saturday": "2023-07-08", "next saturday": "2023-07-15", "last wednesday": "2023-07-05", "next wednesday": "2023-07-19", "last monday": "2023-07-10", "two months ago": "May 2023", "3 weekends ago": "2023-06-21",
}


def test_time_expressions(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "phrase string").select("phrase", temporal.annotations(F.concat(F.lit("I saw it "), "phrase"), F.lit("2023-07-12").cast("date")).alias("a"))
    assert {r.phrase: r.a for r in df.collect()} == {k: [f"{k} = {v}"] for k, v in DATES.items()}
    line = scalar(spark, temporal.evidence_line(F.lit(" We met yesterday "), F.lit(1_689_120_000.0)))
    assert line == "[2023-07-12] We met yesterday (Temporal normalization: yesterday = 2023-07-11)"
    assert scalar(spark, temporal.evidence_line(F.lit("Today"), F.lit(None).cast("double"))) == "Today"


def test_question_types(spark):
    cases = {"When did Ann move?": "temporal", "Who is Ann's friend's boss?": "multi-hop", "Who are the siblings?": "relationship", "What is the role of Bo?": "profile", "Would Ann like tea?": "open"}
    assert {q: scalar(spark, context.question_type(F.lit(q))) for q in cases} == cases


def test_mentions(spark):
    q = spark.createDataFrame([(1, "Does Ann Leeds work with the board?"), (2, "cartwheel")], "question_id int, text string")
    names = spark.createDataFrame([("Ann Leeds",), ("Leeds United",), ("Ann",), ("art",), ("AI",), ("the board",), ("Bob",)], "entity string")
    assert sorted(map(tuple, context.mentioned(q, names).collect())) == [(1, "Ann"), (1, "Ann Leeds"), (1, "Leeds United"), (1, "the board"), (2, "art")]


def test_facts_and_context(spark):
    b = spark.createDataFrame([("Ann", "home_town", [("Oslo", 0.9), ("unknown", 0.1)]), ("Ann", "hobby", [("tea", 0.6), ("chess", 0.3)]), ("Ann", "pet", [("cat", 0.4), ("dog", 0.4), ("x", 0.05)]), ("Bo", "age", [("unknown", 1.0)])], f"entity string, attribute string, dist {DIST_DDL}")
    seen = spark.createDataFrame([("Ann", "hobby", ["tea", "chess"])], "entity string, attribute string, values array<string>")
    assert sorted(r.line for r in context.facts(b, seen).collect()) == ["Ann's hobby is likely tea (60%)", "Ann's home town is Oslo", "Ann's pet could be: cat (40%), dog (40%)", "Observed Ann hobby values include: tea, chess"]
    types = spark.createDataFrame([(1, "open"), (2, "multi-hop")], "question_id int, type string")
    rel = spark.createDataFrame([(q, i, f"r{i % 9}") for q in (1, 2) for i in range(12)], "question_id int, line_pos int, line string")
    prof = spark.createDataFrame([(1, "Ann", 1, "Ann is likely here (60%)"), (1, "Bo", 1, "ann is HERE")], "question_id int, entity string, line_pos int, line string")
    ev = spark.createDataFrame([(1, 1, "[2023-01-01] Ann: hi"), (1, 2, "[2023-01-02] ann: HI"), (2, 1, "x")], "question_id int, line_pos int, line string")
    whole = context.assembled(types, prof, rel, ev)
    assert whole.where("question_id = 1 and section = 'Relationships'").count() == 8 and whole.where("question_id = 2 and section = 'Relationships'").count() == 0
    out = {r.question_id: r.text for r in context.context_text(whole).collect()}
    assert out[2] == "EVIDENCE: x" and out[1].split("\n")[-2:] == ["FACT: Ann is here", "EVIDENCE: [2023-01-01] Ann: hi"]


def test_metrics(spark):
    p, t = F.lit("their own pots"), F.lit("pots")
    assert scalar(spark, metrics.token_f1(p, t)) == 0.5 and scalar(spark, metrics.bleu1(p, t)) == pytest.approx(1 / 3)
    assert scalar(spark, metrics.context_recall(F.lit("big pots here"), F.lit("big red pots"))) == pytest.approx(2 / 3)
    assert [scalar(spark, metrics.failure_bucket(F.lit(a), F.lit(f), F.lit(r))) for a, f, r in (("", 1.0, 1.0), ("Unknown.", 1.0, 1.0), ("a", 1.0, 0.1), ("a", 0.0, 1.0), ("a", 0.4, 1.0), ("a", 0.9, 1.0))] == ["api_or_empty_answer", "unknown_answer", "retrieval_miss", "answer_miss", "partial_answer", "good"]


def test_store(spark):
    s = store.Store(spark, fresh_path(spark, "store"))
    edge = "source_entity string, relation string, target_entity string, confidence double, evidence string, ts double"
    s.upsert("relationship_edges", spark.createDataFrame([("A", "r", "B", 0.9, "one", 1.0)], edge), store.merge_edges)
    s.upsert("relationship_edges", spark.createDataFrame([("A", "r", "B", 0.4, "two", 2.0), ("A", "r", "C", 0.4, "x", 2.0)], edge), store.merge_edges)
    assert got(s.read("relationship_edges")) == [("A", "r", "B", 0.9, "two", 2.0), ("A", "r", "C", 0.4, "x", 2.0)]
    assert s.parts("relationship_edges") == [2]
    s.append("deltas", deltas(spark, [{"id": "a"}]))
    s.append("deltas", deltas(spark, [{"id": "b"}]))
    assert s.read("deltas").count() == 2 and s.read("dimensions").count() == 0


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")
    cache = store.embed_missing(texts, spark.createDataFrame([], "text_hash string, embedding array<float>"), lambda ts: [[float(len(t))] for t in ts])
    assert store.with_vectors(texts, cache).where("embedding is not null").count() == 3 and store.missing_texts(texts, cache).count() == 0


def test_long_memory(spark, tmp_path):
    items = [{"question_id": "q1", "haystack_sessions": [[{"role": "user", "content": "hi"}, {"role": "assistant", "content": "no"}], [{"role": "user", "content": "yo"}]], "haystack_dates": ["2023-05-09"]}]
    (tmp_path / "x.json").write_text(json.dumps(items))
    assert got(loaders.long_memory_turns(spark, str(tmp_path / "x.json"))) == [("q1", 0, 0, "hi", 1_683_590_400.0), ("q1", 1, 0, "yo", None)]
    talk = [{"sample_id": "s", "conversation": {"session_10": [{"speaker": "A", "text": "z"}], "session_2": [{"text": "y"}], "session_2_date_time": "2023-05-09"}, "qa": [{"question": "?", "answer": "!", "category": 1}, {"question": "?", "answer": "!", "category": 5}]}]
    (tmp_path / "y.json").write_text(json.dumps(talk))
    docs = loaders.conversations(spark, str(tmp_path / "y.json"))
    assert got(loaders.conversation_turns(docs)) == [("s", 10, 0, "A: z", loaders.DEFAULT_START + 60), ("s", 2, 0, "Unknown: y", 1_683_590_400.0)]
    assert [r.category for r in loaders.conversation_questions(docs).collect()] == ["multi-hop"]


def run_stream(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"E{i % 3}", "a", "xyz"[i * 7 % 3], [0.9, 0.4][i % 2], i) for i in range(40)]
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], CLAIMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CLAIMS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    log = run_stream(ingest.observe(stream), "observed").collect()
    batch = beliefs.change_log(spark.createDataFrame(rows, CLAIMS)).collect()
    key = lambda r: (r.entity, r.seq)
    for a, b in zip(sorted(log, key=key), sorted(batch, key=key), strict=True):
        assert (a.value, [x.value for x in a.posterior]) == (b.value, [x.value for x in b.posterior]) and [x.p for x in a.posterior] == pytest.approx([x.p for x in b.posterior]) and a.surprise == pytest.approx(b.surprise)


def test_windows_and_buffer(spark, tmp_path):
    rows = [(f"d{i}", 20_000, 20_000 * 86_400.0 + (i * 37) % 50, 20_000 * 86_400.0 + t) for i, t in enumerate([10, 20, 90_000, 86_400 * 4, 86_400 * 4 + 1])]
    schema = "delta_id string, day int, happened double, recorded double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "slack"))
    out = run_stream(ingest.k_slack_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "slack")), slices=1), "slack")
    assert sorted((r.delta_id, r.kind) for r in out.collect() if r.kind != "final") == [("d0", "provisional"), ("d1", "provisional"), ("d2", "corrected"), ("d3", "corrected"), ("d4", "dropped")]
    assert [r.delta_id for r in out.collect() if r.kind == "final"] == [i for i, *_ in sorted(rows[:4], key=lambda r: r[2])]
    timed = "t timestamp, k string, surprise double"
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    spark.createDataFrame([(start + timedelta(hours=h), "k", 1.0) for h in (1, 2, 30, 200)], timed).coalesce(1).write.parquet(str(tmp_path / "w"))
    read = lambda: spark.readStream.schema(timed).parquet(str(tmp_path / "w"))
    assert sorted(r.n for r in run_stream(ingest.surprise_windows(read(), "t"), "tumbling", "complete").collect()) == [1, 1, 2]
    assert run_stream(ingest.surprise_windows(read(), "t", "2 days", "1 day"), "sliding", "complete").count() >= 4
    assert sorted(r.n for r in run_stream(ingest.surprise_sessions(read(), "t", "k", "3 hours"), "sessions", "complete").collect()) == [1, 1, 2]


def test_search_keeps_few_rows_and_equals_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(5)
    words, names = ["role", "tax", "model", "paint", "market", "garden"], [f"Ann S{i}" for i in range(80)] + ["Bob"]
    rows = []
    for i in range(400):
        said = " ".join(rng.choices(words, k=rng.randint(0, 5)))
        rows.append((f"d{i}", rng.choice([None, "Ann", "Bob"]), rng.choice([said, said, f" {said} ", None]), rng.choice([None, 1.0, 2.0, float("nan")]), rng.choices(names, k=rng.randint(0, 3)) or None))
    docs = spark.createDataFrame(rows, "doc_id string, speaker string, text string, ts double, entities array<string>").where("text is not null").repartition(3)
    asked = [(i, ["role of Ann?", "tax and garden", "Paint paint market", "nothing here", "role of Ann?"][i % 5]) for i in range(60)]
    wanted = [(i, n) for i in range(60) for n in (["Bob", "ann s1"] if i % 5 == 1 else ["BOB"] if i % 5 == 3 else [])]
    shared, members = [(i, "ann") for i in range(60) if i % 5 in (0, 2)], [("ann", n) for n in names[:-1]]
    q, w = spark.createDataFrame(asked, "question_id int, text string"), spark.createDataFrame(wanted, "question_id int, entity string")
    groups = spark.createDataFrame(shared, "question_id int, key string"), spark.createDataFrame(members, "key string, entity string")
    found, _ = search._found(docs, q, w, 7, groups)
    assert found.count() <= docs.rdd.getNumPartitions() * 5 * 7  # of the distinct questions only, a task's best only
    posted = search.postings(docs, search.turn_text())
    n, mean = docs.count(), posted.agg(F.sum("tf")).first()[0] / docs.count()
    tf, idf = F.col("tf"), {r.term: r.idf for r in search.bm25_idf(posted, n).collect()}
    impact = {(r.doc_id, r.term): r.v * idf[r.term] for r in posted.select("doc_id", "term", (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * F.col("dl") / mean))).alias("v")).collect()}
    terms = {}
    for r in search.query_terms(q).collect():
        terms.setdefault(r.question_id, []).append((r.term, r.qtf))
    want = {i: {n.lower() for j, n in wanted if j == i} | ({n.lower() for n in names[:-1]} if i % 5 in (0, 2) else set()) for i in range(60)}
    turns, expect = docs.collect(), []
    for i, _ in asked:
        best = {}
        for d in turns:
            have = {x.lower() for x in [*(d.entities or []), d.speaker or ""]}
            score = round(sum(k * impact.get((d.doc_id, t), 0.0) for t, k in terms.get(i, [])) + 1.5 * len(have & want[i]), 6)
            key = (-score, (2, 0.0) if d.ts is None else (0, 0.0) if d.ts != d.ts else (1, -d.ts), d.doc_id)
            if score > 0 and d.text.strip() and key < best.get(d.text.strip(), (9.0,)):
                best[d.text.strip()] = key
        expect += [(i, r, k[2], -k[0]) for r, k in enumerate(sorted(best.values())[:7], 1)]
    for block in (65_536, 9):
        monkeypatch.setattr(search, "BLOCK_QUESTIONS", block)
        assert got(search.search_turns(docs, q, w, 7, groups)) == sorted(expect, key=repr) and expect


def test_shared_words_are_kept_once_and_mean_the_same(spark):
    names = [f"Dmitri S{i:03d}" for i in range(300)] + ["Ann Lee", "Bo", "Al Li", "dmitri s001"]
    registry = spark.createDataFrame([(n, 1) for n in names], "entity string, n_attributes long")
    q = spark.createDataFrame([(i, f"What is the role of Dmitri S{i:03d}?") for i in range(50)] + [(50, "Who is Al Li?"), (51, "xAnn Leex"), (52, None)], "question_id int, text string")
    few, (asked, members) = context.mentioned_groups(q, registry)
    rows = few.count() + asked.count() + members.count()
    assert rows < 1_000 < context.mentioned(q, registry).count()
    want = {(i, n) for i in range(50) for n in names if "mitri" in n} | {(50, "Al Li"), (51, "Ann Lee")}
    assert set(got(context.mentioned(q, registry))) == want
    first = context.first_mentioned(few, asked, members, 12)
    assert set(got(first)) == {(i, n) for i in range(53) for n in sorted(n for j, n in want if j == i)[:12]}


def test_a_context_moves_each_line_once(spark):
    rows = [(1, "Relationships", 1, "Ann --friend--> Bo (90% confidence)"), (1, "Ann", 1, "Ann's pet is a cat"), (1, "Bo", 1, "ann's pet is a CAT"), (1, "Relevant evidence", 1, "Ann: hi"), (2, "Ann", 1, None)]
    text = context.context_text(spark.createDataFrame(rows, "question_id int, section string, line_pos int, line string"))
    assert text._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert got(text) == [(1, "FACT: Ann --friend--> Bo (90% confidence)\nFACT: Ann's pet is a cat\nEVIDENCE: Ann: hi")]


def test_context_reads_the_log_of_shown_entities_only(spark, monkeypatch):
    one = lambda v: [(v, 1.0)]
    log = [{"id": f"o{i}", "dimension_id": f"Other S{i}.pet", "evidence": "no"} for i in range(50)]
    log += [{"id": "a", "dimension_id": "Ann Lee.pet", "posterior": [("cat", 0.6), ("dog", 0.4)], "evidence": "Ann has a cat"}, {"id": "b", "dimension_id": "Moved Away.pet", "evidence": "gone"}]
    log += [{"id": "b", "dimension_id": "Ann Lee.pet", "evidence": "came late"}, {"id": None, "dimension_id": "Ann Lee.pet", "evidence": "no id"}, {"id": "n", "dimension_id": None, "evidence": "no name"}]
    log = deltas(spark, log)
    kept = answering._log_of(log, spark.createDataFrame([("Ann Lee",)], "entity string"))
    assert [(r.id, r.evidence, r.seq) for r in kept.collect()] == [("a", "Ann has a cat", 51)]  # a later delivery is none, even if only it tells of someone shown
    held = dimensions(spark, [("Ann Lee.pet", one("cat"), 1.0), ("Other S1.pet", one("dog"), 1.0), ("Other S2.pet", one("dog"), 1.0)])
    edges = spark.createDataFrame([("Ann Lee", "friend", "Bo Ray", 0.9, None, 1.0)], "source_entity string, relation string, target_entity string, confidence double, evidence string, ts double")
    events = spark.createDataFrame([("e1", "Ann Lee met Bo", 1_689_120_000.0, "Cy", ["Ann Lee"])], "id string, text string, ts double, speaker string, entities array<string>")
    asked = [(i, "Would Ann Lee like tea?") for i in range(40)] + [(40, "What is the role of Ann Lee?"), (41, None)]
    tables = spark.createDataFrame(asked, "question_id int, text string"), held, log, edges, events
    related = ["FACT: Ann Lee --friend--> Bo Ray (90% confidence)", "FACT: Ann Lee --pet--> cat", "FACT: [Multi-hop path] Ann Lee → friend → Bo Ray"]
    own = ["FACT: Ann Lee's pet is cat", "FACT: Observed Ann Lee pet values include: cat, dog", "FACT: Ann has a cat [2025-06-15]", "EVIDENCE: [2023-07-12] Ann Lee met Bo"]
    text = got(answering.build_context_text(*tables))
    told = dict(text)
    assert [told[i].split("\n") for i in range(41)] == [related + own] * 40 + [own]
    assert text == got(context.context_text(answering.build_context(*tables)))
    monkeypatch.setattr("plausia.cluster.is_small", lambda *_: False)  # with more names than a broadcast takes, all is read and nothing changes
    assert text == got(answering.build_context_text(*tables))
