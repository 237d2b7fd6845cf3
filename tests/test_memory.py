"""Answers, observation of texts, seams and metrics on small cases."""

import pytest
from pyspark.sql import functions as F

from plausia.functions import answers, metrics
from plausia.operators import context, extract, hierarchy, observe, search, trust


def short(spark, reply, category, question=""):
    df = spark.createDataFrame([(reply, category, question)], "r string, c string, q string")
    return df.select(answers.answer_text(F.col("r"), F.col("c"), F.col("q")).alias("a")).first().a


@pytest.mark.parametrize(("reply", "category", "question", "answer"), [
    ("It was on 7 May 2023, I think.", "temporal", "", "7 May 2023"), ("in May 2023 or so", "temporal", "", "May 2023"), ("some 3 weeks", "temporal", "", "3 weeks"), ("no idea", "temporal", "", "no idea"),
    ('{"answer": " \'Oslo\' "}', "adversarial", "", "Oslo"), ('Sure: {"answer": "Bern"} ok', "adversarial", "", "Bern"), ("{broken", "adversarial", "", "{broken"), (None, "temporal", "", ""), ("  ", "open-domain", "", ""),
    ("The answer is the lake house because Ann said so.", "single-hop", "", "the lake house"), ("Mirela Tosk is a nurse. She works.", "multi-hop", "", "a nurse"),
    ("The race raised awareness for the old library, mostly.", "single-hop", "What did the race raise awareness for?", "old library"),
    ("Likely yes, Ann would go there since it is near.", "open-domain", "", "Likely yes; Ann would go there"), ("No.", "open-domain", "", "No"), (" ".join(["word"] * 30), "open-domain", "", " ".join(["word"] * 18)),
])
def test_answers(spark, reply, category, question, answer):
    assert short(spark, reply, category, question) == answer


def test_observed_turns(spark):
    turns = spark.createDataFrame([
        (1, "Mirela: Mirela works at Quellwerk Labs.", 1.0, 1), (2, "Mirela works at Obermann.", 2.0, 2), (3, "nothing here", 3.0, 3), (4, None, 4.0, 4), (5, "x" * 100 + ": hi", 5.0, 5), (6, "", 6.0, 6),
    ], "turn_id int, text string, ts double, seq long")
    out = observe.observe_turns(turns)
    events = {r.turn_id: r for r in out["events"].collect()}
    assert events[1].speaker == "Mirela" and events[1].entities == ["Mirela", "Quellwerk Labs"] and events[3].entities == [] and events[5].speaker is None and len(events) == 6
    (state,) = out["dimensions"].collect()
    assert state.id == "Mirela.employer" and state.last_accessed == 2.0 and {x.value for x in state.distribution} == {"Quellwerk Labs", "Obermann", "unknown"} and out["deltas"].count() == 2
    empty = observe.observe_turns(turns.limit(0))
    assert all(df.count() == 0 for df in empty.values())


def test_retries_and_seams(spark):
    turns = spark.createDataFrame([(1, "a")], "turn_id int, text string")

    def never(texts):
        raise OSError("down")

    assert extract.ask(turns, never, attempts=2, wait_seconds=0.0).collect()[0].reply is None
    replies = spark.createDataFrame([(1, '[{"entity": "ann_lee", "attribute": "Home Town"}, {"entity": "x"}]'), (2, "sorry"), (3, None)], "turn_id int, reply string")
    assert [tuple(r) for r in extract.parsed_questions(replies).collect()] == [(1, 0, "Ann Lee", "home_town")]
    long = "What does the sister of the friend of Ann do for a living in Oslo?"
    asked = spark.createDataFrame([(1, long, "multi-hop"), (2, long, "open"), (3, "Who is Ann?", "multi-hop"), (4, long, "relationship"), (5, long, "multi-hop")], "question_id int, text string, type string")
    said = spark.createDataFrame([(1, '```json["a", "b", "c", "d"]```'), (2, '["a"]'), (3, '["a"]'), (4, "no"), (5, "[]")], "question_id int, reply string")
    parts = sorted((r.question_id, r.part, r.text) for r in extract.split_questions(asked, said).collect())
    assert parts == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, long), (3, 0, "Who is Ann?"), (4, 0, long), (5, 0, long)]
    rows = [(1, 0, "Ann", 2, "x", 1), (1, 1, "Ann", 1, "y", 1), (1, 1, "Relevant evidence", 3, "e2", 1), (1, 0, "Relevant evidence", 3, "e1", 1)]
    merged = context.merged_parts(spark.createDataFrame(rows, "question_id int, part int, section string, section_pos int, line string, line_pos int"))
    assert sorted((r.section, r.section_pos, r.line, r.line_pos) for r in merged.collect()) == [("Ann", 2, "x", 1), ("Relevant evidence", 3, "e1", 1), ("Relevant evidence", 3, "e2", 2)]


def test_calibration_and_tax(spark):
    rated = spark.createDataFrame([("high", 0.9), ("high", 0.7), ("low", 0.2), ("mid", 0.5)], "level string, reliability double")
    assert {r.level: (r.n, round(r.mean, 6)) for r in metrics.calibration(rated).collect()} == {"high": (2, 0.8), "mid": (1, 0.5), "low": (1, 0.2), "separation": (3, 0.6)}
    held = spark.createDataFrame([("it is 30.0 or so", "30", True), ("thirty", "30", False), ("SQLite here", "sqlite", True), ("a cat", "at", False), ("v1.2x", "1.2", False), ("Entropy-decay", "entropy decay", True)], "a string, v string, ok boolean")
    assert all(r.got == r.ok for r in held.withColumn("got", metrics.holds_value(F.col("a"), F.col("v"))).collect())
    tax = trust.extraction_tax(spark.createDataFrame([(True, True), (True, False)], "pinned boolean, unpinned boolean")).first()
    assert (tax.n, tax.pinned, tax.unpinned, tax.tax) == (2, 100.0, 50.0, 50.0)
    claims = [("f", "true", "a", "x", "Oslo", "oslo"), ("f", "poison", "a", "y", "Bern", "bern"), ("g", "true", "a", "x", "Oslo", "oslo"), ("g", "poison", "a", "x", "Bern city", "bern"), ("h", "true", "a", "x", "Rome", "oslo")]
    out = trust.fragmented(spark.createDataFrame(claims, "fact string, kind string, entity string, attribute string, value string, target string"))
    assert sorted(map(tuple, out.collect())) == [("f", 1, 1, True), ("g", 1, 1, False), ("h", 0, 0, True)]


def test_numbers_and_incremental_idf(spark):
    rows = spark.createDataFrame([(f"k{i * 7 % 50:02}", i) for i in range(50)], "k string, i int").repartition(5)
    assert [r.k for r in sorted(hierarchy.numbered_rows(rows, ["k"]).collect(), key=lambda r: r.number)] == [f"k{i:02}" for i in range(50)]
    docs = spark.createDataFrame([(1, "apple pear"), (2, "pear"), (3, "plum"), (4, None)], "doc_id int, text string")
    idf = {r.term: r.idf for r in search.incremental_idf(docs, F.col("text"), ["doc_id"]).collect()}
    import math

    assert idf["apple"] == pytest.approx(math.log(0.5 / 1.5 + 1)) and idf["pear"] == pytest.approx(math.log(0.5 / 2.5 + 1)) and idf["plum"] == pytest.approx(math.log(2.5 / 1.5 + 1))
