"""The belief operators against golden values and brute force."""

import pytest
from pyspark.sql import functions as F

from plausia.functions import info
from plausia.operators import beliefs, graph, identity, queries, trust
from plausia.schema import CLAIMS, DIST_DDL
from tests.data import deltas, dimensions, got


def claims(spark, rows):
    return spark.createDataFrame([(e, a, v, float(r), i) for i, (e, a, v, r) in enumerate(rows)], CLAIMS)


def dist_of(df, entity="E", attribute="a"):
    (row,) = [r for r in df.collect() if (r.entity, r.attribute) == (entity, attribute)]
    return {x.value: round(x.p, 6) for x in row.dist}


GOLDEN = [
    ([("Google", 0.9)], {"unknown": 0.181818, "Google": 0.818182}, 4.321928), ([("Google", 0.9), ("OpenAI", 0.9)], {"unknown": 0.025974, "Google": 0.116883, "OpenAI": 0.857143}, 4.321928),
    ([("Stripe", 0.9)] * 2, {"unknown": 0.024096, "Stripe": 0.975904}, 0.289507), ([("Stripe", 0.9)] * 3, {"Stripe": 1.0}, 0.035189), ([("A", 0.9), ("B", 0.25)], {"unknown": 0.14876, "A": 0.669421, "B": 0.181818}, 4.321928),
    ([("A", 0.9), ("B", 0.25), ("B", 0.25)], {"unknown": 0.158358, "A": 0.71261, "B": 0.129032}, 2.459432), ([("A", 0.9), ("B", 0.25), ("B", 0.25), ("A", 0.6)], {"unknown": 0.065296, "A": 0.881499, "B": 0.053204}, 0.488815),
]


def test_golden_updates_both_ways(spark):
    rows = [(f"E{i}", "a", v, r) for i, (obs, _, _) in enumerate(GOLDEN) for v, r in obs]
    c = claims(spark, rows)
    native, scanned = beliefs.folded_beliefs(c), beliefs.beliefs(c)
    last = {r.entity: r for r in beliefs.change_log(c, last_only=True).collect()}
    for i, (_, want, surprise) in enumerate(GOLDEN):
        assert dist_of(native, f"E{i}") == want == dist_of(scanned, f"E{i}")
        assert round(last[f"E{i}"].surprise, 6) == surprise
    assert beliefs.change_log(c).count() == len(rows)


def test_both_folds_agree_on_every_bit(spark):
    import random

    rng = random.Random(8)
    c = claims(spark, [(f"E{rng.randrange(4)}", "a", rng.choice("pqrstu"), rng.choice([0.0, 0.2, 0.6, 0.9, 1.0])) for _ in range(400)])
    pair = lambda df: {r.entity: [(x.value, x.p) for x in r.dist] for r in df.collect()}
    native, scanned = pair(beliefs.folded_beliefs(c)), pair(beliefs.beliefs(c))
    assert native.keys() == scanned.keys()
    for k in native:
        assert [v for v, _ in native[k]] == [v for v, _ in scanned[k]] and [p for _, p in native[k]] == pytest.approx([p for _, p in scanned[k]], abs=1e-12)


def test_no_claims_and_odd_claims(spark):
    assert got(beliefs.beliefs(claims(spark, []))) == [] and got(beliefs.change_log(claims(spark, []))) == []
    raw = spark.createDataFrame([("E", "a", "x", None, 1), (None, "a", "x", 0.9, 2), ("E", "a", None, 0.9, 3), ("E", "a", "y", 7.0, 4)], CLAIMS)
    c = beliefs.claims_of(raw, F.col("entity"), F.col("attribute"), F.col("value"), F.col("reliability"), F.col("seq"))
    assert dist_of(beliefs.beliefs(c)) == {"y": 1.0}


def test_flat_and_frequent(spark):
    c = claims(spark, [("E", "a", v, 0.9) for v in "xxyyz"])
    assert got(beliefs.last_write_wins(c)) == [("E", "a", "z")] and got(beliefs.most_frequent(c)) == [("E", "a", "y")]


def scalar(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def dist(*pairs):
    return F.array(*(F.struct(F.lit(v).alias("value"), F.lit(float(p)).alias("p")) for v, p in pairs))


def test_information(spark):
    two, even = dist(("a", 0.9), ("b", 0.1)), dist(("a", 0.5), ("b", 0.5))
    assert scalar(spark, info.entropy(two)) == pytest.approx(0.468996, abs=1e-6)
    assert scalar(spark, info.kl_divergence(even, two)) == pytest.approx(0.736966, abs=1e-6)
    assert scalar(spark, info.bhattacharyya(even, two)) == pytest.approx(0.894427, abs=1e-6)
    assert [scalar(spark, info.surprise(F.lit(p))) for p in (0.0, 1.0, 0.5)] == [20.0, 0.0, 1.0]
    once = scalar(spark, info.decayed(two, F.lit(0.0), F.lit(info.HALF_LIFE_S)))
    assert [round(x.p, 6) for x in once] == [0.7, 0.3]
    half = info.decayed(two, F.lit(0.0), F.lit(info.HALF_LIFE_S / 2))
    again = scalar(spark, info.decayed(half, F.lit(info.HALF_LIFE_S / 2), F.lit(info.HALF_LIFE_S)))
    assert [x.p for x in again] == pytest.approx([x.p for x in once])
    scenario = scalar(spark, info.decayed(dist(("unknown", 0.181818), ("dark mode", 0.818182)), F.lit(3000.0), F.lit(3010.0), half_life_s=1.0))
    assert scenario[1].p == pytest.approx(0.500311, abs=1e-6)
    assert scalar(spark, info.believed(dist(("unknown", 0.9), ("b", 0.05), ("c", 0.05))))["value"] == "b"
    joint = spark.createDataFrame([("A", "B", x, y, p) for (x, y), p in {("0", "0"): 0.4, ("0", "1"): 0.1, ("1", "0"): 0.1, ("1", "1"): 0.4}.items()], "dim_a string, dim_b string, va string, vb string, p double")
    assert identity.mutual_information(joint).first().mi == pytest.approx(0.278072, abs=1e-6)


def test_as_of(spark):
    rows = [{"id": "a", "ts": 100.0, "posterior": [("x", 1.0)]}, {"id": "b", "ts": 900_000.0, "posterior": [("y", 1.0)]}, {"id": "c", "ts": 900_000.0, "posterior": [("z", 1.0)]}, {"id": "n", "ts": None, "posterior": [("n", 1.0)]}]
    probes = spark.createDataFrame([("A.x", t) for t in (99.0, 100.0, 800_000.0, 900_000.0, 9e9)] + [("B.x", 5.0)], "dimension_id string, at double")
    out = {(r.dimension_id, r.at): r.dist[0].value for r in queries.beliefs_at(deltas(spark, rows), probes).collect()}
    assert out == {("A.x", 99.0): "unknown", ("A.x", 100.0): "x", ("A.x", 800_000.0): "x", ("A.x", 900_000.0): "z", ("A.x", 9e9): "z", ("B.x", 5.0): "unknown"}


def test_explain_predict_and_observed(spark):
    rows = [{"id": "a", "prior": [("unknown", 1.0)], "posterior": [("unknown", 0.2), ("dark mode", 0.8)]}, {"id": "b", "prior": [("dark mode", 0.8)], "posterior": [("dark mode", 0.5), ("Light", 0.46), ("rare", 0.04)]}, {"id": "c", "posterior": [("light", 1.0)], "prior": [("Light", 1.0)]}]
    d = deltas(spark, rows)
    asked = spark.createDataFrame([("A.x", "dark_mode")], "dimension_id string, value string")
    assert [r.id for r in queries.explain(d, asked).collect()] == ["a"]
    assert [r["values"] for r in queries.observed_values(d).collect()] == [["dark mode", "Light", "rare"]]
    known = queries.current_dimensions(dimensions(spark, [("A.x", [("v", 1.0)], 1.0), ("A.y", None, 2.0), ("A.y", [("w", 1.0)], 1.0), (None, None, None)]))
    out = queries.predict(known, spark.createDataFrame([("A", "x"), ("A", "y")], "entity string, attribute string"))
    assert {r.attribute: r.dist[0].value for r in out.collect()} == {"x": "v", "y": "unknown"}


@pytest.mark.parametrize(("tier", "wins"), [(0.2, []), (0.45, []), (0.5, []), (0.55, [10, 50]), (0.6, [3, 10, 50]), (0.9, [1, 3, 10, 50])])
def test_poison_grid(spark, tier, wins):
    cells = trust.grid(spark, m=[1, 3, 10, 50]).withColumn("entity", F.col("m").cast("string"))
    c = trust.poison_claims(cells, F.col("entity"), F.lit(4), F.col("m"), F.lit(tier))
    top = queries.top_beliefs(beliefs.beliefs(c))
    assert sorted(int(r.entity) for r in top.collect() if r.value == "W") == wins


def test_trust(spark):
    assert scalar(spark, trust.effective_reliability(F.lit("web"), F.lit(0.96))) == 0.2
    assert scalar(spark, trust.effective_reliability(F.lit("repo"), F.lit(0.96), F.lit("web"))) == 0.2
    assert scalar(spark, trust.effective_reliability(F.lit("user"), F.lit(0.4))) == 0.4
    assert [scalar(spark, trust.laundered(F.lit(p))) for p in ("direct", "naive_inherit", "taint_propagate")] == [0.2, 0.9, 0.2]
    first, second = got(trust.scenarios(spark, trials=5)), got(trust.scenarios(spark, trials=5).repartition(3))
    assert first == second and len({r[0] for r in first}) == 25


def coupled(spark, a, b):
    own = spark.createDataFrame([("P", k, v) for k, v in a.items()] + [("Q", k, v) for k, v in b.items()], f"entity string, attribute string, dist {DIST_DDL}")
    return identity.coupling(spark.createDataFrame([("P", "Q")], "entity_a string, entity_b string"), own).first().coupling


def test_coupling(spark):
    two = [("x", 0.7), ("y", 0.3)]
    assert coupled(spark, {"a": two, "b": two, "c": two}, {"a": two, "b": two, "c": two}) == pytest.approx(1.0)
    assert coupled(spark, {"a": two, "b": two}, {"a": two, "b": two}) == 0.0
    assert coupled(spark, {"a": two, "b": two, "c": [("x", 1.0)]}, {"a": two, "b": two, "c": [("z", 1.0)]}) == 0.0
    sim = lambda a, b: scalar(spark, identity.name_similarity(F.lit(a), F.lit(b)))
    assert sim("Bob", "Bob Smith") == 0.8 and sim("night", "nacht") == pytest.approx(1 / 7) and sim("ANN", "ann ") == 1.0 and sim("", "x") == 0.0
    assert [scalar(spark, identity.should_merge(F.lit(s), F.lit("Ann B"), F.lit(n))) for s, n in ((0.97, "ann b"), (0.98, "Zoe"), (0.995, "Zoe"), (0.4, "Ann B"))] == [True, False, True, False]


EDGE = "source_entity string, relation string, target_entity string, confidence double, evidence string, ts double"


def brute_bfs(seeds, edges, hops, most):
    visited, queue = {s: [s] for s in seeds}, [(s, 0) for s in seeds]
    while queue and len(visited) < most:
        at, depth = queue.pop(0)
        if depth >= hops:
            continue
        for s, r, t, c, *_ in sorted(edges, key=lambda e: (e[1], e[2])):
            if s == at and t and t not in visited and c >= 0.3:
                visited[t] = [*visited[at], r, t]
                queue.append((t, depth + 1))
    return {k: v for k, v in visited.items() if k not in seeds}


@pytest.mark.parametrize("most", [4, 12, 1000])
def test_traversal(spark, most):
    import random

    rng = random.Random(most)
    edges = [(f"n{rng.randrange(25)}", rng.choice("rst"), f"n{rng.randrange(25)}", rng.choice([0.2, 0.5, 0.9]), "", 1.0) for _ in range(70)]
    df = spark.createDataFrame(edges, EDGE)
    asked = {1: ["n1", "n2"], 2: ["n7"], 3: ["nowhere"]}
    seeds = spark.createDataFrame([(q, s, i) for q, ss in asked.items() for i, s in enumerate(ss)], "question_id int, entity string, position int")
    out = {}
    for r in graph.traverse(seeds, df, 2, 0.3, most).collect():
        out.setdefault(r.question_id, {})[r.entity] = r.path
    once = {}
    for s, r, t, c, *_ in edges:
        once[(s, r, t)] = max(c, once.get((s, r, t), 0))
    for q, ss in asked.items():
        assert out.get(q, {}) == brute_bfs(ss, [(*k, c) for k, c in once.items()], 2, most)


def test_edges(spark):
    rows = [(" Ann ", "Friend", "Bob", 0.5, "a", 1.0), ("Ann", "parent", "Cy Dee", 0.4, "b", 2.0), ("Ann", "friend", "ann", 0.9, "c", 3.0), ("Ann", "pet", "something great", 0.9, "d", 4.0), ("Ann", "likes", "tea", 0.9, "e", 5.0), (None, "x", "Y", 0.1, "", 1.0), ("Ann", "pet", "dog", 0.9, "f", 6.0)]
    edges = got(graph.stored_edges(spark.createDataFrame(rows, EDGE)).select("source_entity", "relation", "target_entity"))
    assert edges == [("Ann", "friend", "Bob"), ("Ann", "parent", "Cy Dee"), ("Ann", "pet", "dog"), ("Bob", "friend", "Ann"), ("Cy Dee", "child", "Ann"), ("dog", "owner", "Ann")]
    twice = spark.createDataFrame([("A", "r", "B", 0.9, "old", 1.0), ("A", "r", "B", 0.2, "new", 2.0)], EDGE)
    assert got(graph.upserted_edges(twice, ["ts"])) == [("A", "r", "B", 0.9, "new", 2.0)] and got(graph.cached_edges(twice, ["ts"])) == [("A", "r", "B", 0.9, "old", 1.0)]
    ring = spark.createDataFrame([("A", "r", "B", 0.9, "", 1.0), ("B", "s", "C", 0.9, "", 1.0), ("A", "t", "C", 0.9, "", 1.0), ("C", "u", "A", 0.9, "", 1.0)], EDGE)
    pair = spark.createDataFrame([("A", "C")], "from_entity string, to_entity string")
    assert sorted(r.path for r in graph.paths_between(pair, ring).collect()) == [["A", "r", "B", "s", "C"], ["A", "t", "C"]]
    b = spark.createDataFrame([("A", "friend", [("Bo", 0.4), ("unknown", 0.35), ("Cy", 0.2), ("Di", 0.05)]), ("A", "city", [("X", 1.0)])], f"entity string, attribute string, dist {DIST_DDL}")
    assert [r.related for r in graph.relations_from_beliefs(b).collect()] == ["Bo"] and [r.related for r in graph.relations_from_beliefs(b, wide=True).collect()] == ["Bo", "Cy"]


def test_whole_paths_equal_depth_first_search(spark, tmp_path):
    import random

    import __spark_entry__

    rng = random.Random(5)
    rows = {(rng.choice("ABCDEFGH"), rng.choice("rs"), rng.choice("ABCDEFGH")) for _ in range(24)}
    edges = spark.createDataFrame([(*e, 0.9, "", 1.0) for e in sorted(rows)] + [("A", "r", "H", 0.1, "", 1.0), ("A", "r", "", 0.9, "", 1.0), (None, "r", "B", 0.9, "", 1.0)], EDGE)
    edges.write.parquet(str(tmp_path / "relationship_edges.parquet"))

    def search(path, to, most):
        if path[-1] == to:
            return [path]
        return [p for s, r, t in rows if s == path[-1] and t not in path[::2] and len(path) < 2 * most for p in search([*path, r, t], to, most)]

    linked = sorted({(s, t) for s, _, t in rows if s != t})
    want = sorted((a, b, ">".join(p)) for a, b in linked for p in search([a], b, 4))
    assert any(p.count(">") == 8 for _, _, p in want)
    assert sorted(map(tuple, __spark_entry__.queries()["gr8_paths_whole"](spark, str(tmp_path)).collect())) == want
    pairs = spark.createDataFrame([*linked, ("A", "A"), ("A", "none")], "from_entity string, to_entity string")
    for hops in (0, 1, 2, 4):
        out = sorted((r.from_entity, r.to_entity, r.path) for r in graph.paths_between(pairs, edges, hops).collect())
        assert out == sorted([(a, b, p) for a, b in linked for p in search([a], b, hops + 1)] + [("A", "A", ["A"])])


def test_merge_candidates_equal_the_pairwise_score(spark):
    import random

    rng = random.Random(11)

    def shares():
        names = rng.sample("pqr", rng.choice([1, 2, 3]))
        return [(n, 1 / len(names)) for n in sorted(names)]

    rows = [(i, a, shares()) for i in range(40) for a in "abcd" if rng.random() < 0.9]
    known = spark.createDataFrame(rows, f"entity long, attribute string, dist {DIST_DDL}")
    asked = known.where("entity % 4 = 0").select("entity")
    pairs = asked.distinct().withColumnRenamed("entity", "entity_a").join(known.select(F.col("entity").alias("entity_b")).distinct(), F.col("entity_a") != F.col("entity_b"))
    want = {(r.entity_a, r.entity_b): round(r.coupling, 9) for r in identity.coupling(pairs, known).collect() if r.coupling >= 0.3}
    for block in (3, 512):
        out = identity.merge_candidates(asked, known, least=0.3, block_rows=block)
        assert {(r.entity_a, r.entity_b): round(r.coupling, 9) for r in out.collect()} == want and want
    assert got(identity.merge_candidates(asked.limit(0), known)) == [] and identity.overlapping(asked, known).count() > 0


def test_merge_candidates_pass_once_and_compare_equal_profiles_once(spark):
    kinds = {0: [("p", 0.5), ("q", 0.5)], 1: [("p", 0.51), ("q", 0.49)], 2: [("r", 1.0)]}
    rows = [(i, a, kinds[i % 3] if a != "c" else [(f"s{i % 2}", 1.0)]) for i in range(1_200) for a in "abc"]
    known = spark.createDataFrame(rows, f"entity long, attribute string, dist {DIST_DDL}")
    near = identity.merge_candidates(known.select("entity"), known, least=0.9, digits=4)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") == 1 and "Union" not in plan
    per = near.groupBy("coupling", (F.col("entity_a") % 6).alias("a"), (F.col("entity_b") % 6).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_a", "entity_b").alias("d"))
    want = [(1.0, k, k, 200 * 199) for k in (0, 1, 3, 4)] + [(1.0, a, b, 200 * 200) for a, b in ((0, 4), (4, 0), (1, 3), (3, 1))]
    assert sorted((r.coupling, r.a, r.b, r.n) for r in per.collect() if r.n == r.d) == sorted(want)
