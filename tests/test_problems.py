"""The general operators against brute force, with nulls, ties, repeats, skew and empty tables."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plausia.operators import hierarchy, history, lateness, references, widen
from plausia.operators.bitmaps import Bitmap
from tests.data import deltas, dimensions, got

EXTRA = {"key": "k", "kind": "x", "month": "m", "_nth": 1, "value": "v", "day": 3, "node": 5}


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 200_000)), st.sets(st.integers(0, 200_000)))
def test_bitmaps_are_sets(a, b):
    x, y = Bitmap.of(np.array(sorted(a), np.int64)), Bitmap.of(np.array(sorted(b), np.int64))
    assert x.and_not(y).codes().tolist() == sorted(a - b)
    assert (x & y).codes().tolist() == sorted(a & b)
    assert (x | y).codes().tolist() == sorted(a | b)
    assert len(x) == len(a)


def test_dense_bitmaps_are_sets():
    a, b = np.arange(0, 140_000, 2), np.arange(0, 140_000, 3)
    x, y = Bitmap.of(a), Bitmap.of(b)
    assert x.and_not(y).codes().tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    assert (x | y).codes().tolist() == sorted(set(a.tolist()) | set(b.tolist()))
    assert x.nbytes() < a.nbytes


def test_broken_references(spark):
    rows = [
        {"id": "a", "dimension_id": "A.x"}, {"id": "b", "dimension_id": "gone.x", "cascaded_from": "a"}, {"id": "c", "dimension_id": "dead.x", "cascaded_from": "later"}, {"id": "later", "cascaded_from": "nowhere"},
        {"id": "b", "dimension_id": "A.x", "cascaded_from": "nowhere"}, {"id": "d", "dimension_id": None, "cascaded_from": " ", "ts": None}, {"id": None, "dimension_id": "gone.x"}, {"id": "e", "dimension_id": "gone.x", "ts": None},
    ]
    dims = dimensions(spark, [("A.x", [("v", 1.0)], 1.0), ("dead.x", [("v", 1.0)], 1.0), ("dead.x", None, 2.0), ("dead.x", None, 2.0), (None, None, 1.0)])
    found = got(references.broken_references(deltas(spark, rows, **EXTRA), dims))
    month = "2025-06"
    assert found == [("b", "dimension_id", "missing", month), ("c", "cascaded_from", "later", month), ("c", "dimension_id", "deleted", month), ("e", "dimension_id", "missing", None), ("later", "cascaded_from", "missing", month)]
    counts = got(references.orphan_counts(deltas(spark, rows), dims))
    assert ("dimensions", "missing", month, 1) in counts and ("deltas", "later", month, 1) in counts


def test_broken_references_of_nothing(spark):
    none = deltas(spark, []).limit(0)
    assert got(references.broken_references(none, dimensions(spark, []))) == []
    assert got(references.broken_references(deltas(spark, [{"id": "a"}]), dimensions(spark, []))) == [("a", "dimension_id", "missing", "2025-06")]


def test_broken_references_with_a_hot_parent(spark):
    rng = random.Random(5)
    rows = [{"id": f"d{i}", "dimension_id": rng.choice(["hot.x"] * 5 + [f"e{j}.x" for j in range(9)]), "cascaded_from": rng.choice([None, "d400", f"d{rng.randrange(900)}"])} for i in range(800)]
    dims = [(f"e{j}.x", [("v", 1.0)] if j % 2 else None, 1.0) for j in range(7)]
    found = set(got(references.broken_references(deltas(spark, rows), dimensions(spark, dims), keys_per_range=64, arrival_periods=7)))
    want, seq = set(), {r["id"]: i for i, r in enumerate(rows)}
    state = {k: d is not None for k, d, _ in dims}
    for i, r in enumerate(rows):
        if not state.get(r["dimension_id"]):
            want.add((r["id"], "dimension_id", "deleted" if r["dimension_id"] in state else "missing", "2025-06"))
        p = r["cascaded_from"]
        if p and (p not in seq or seq[p] > i):
            want.add((r["id"], "cascaded_from", "later" if p in seq else "missing", "2025-06"))
    assert found == want


def brute_versions(rows):
    chains, out = {}, []
    for i, r in enumerate(rows):
        chains.setdefault(r["dimension_id"], []).append((r["valid_time"] if r["valid_time"] and r["valid_time"] > 1e6 else r["ts"], i + 1, r["id"], r["posterior"][0][0].lower()))
    for d, c in chains.items():
        before = object()
        for _, _, i, v in sorted(c):
            if v != before:
                out.append((d, i))
            before = v
    return sorted(out)


def test_history_of_skewed_late_changes(spark):
    rng = random.Random(7)
    rows = [
        {"id": f"d{i:04}", "dimension_id": rng.choice(["hot.x"] * 6 + [f"e{j}.x" for j in range(6)]), "posterior": [(rng.choice("abAB"), 1.0)], "ts": 1.75e9 + rng.randrange(300), "valid_time": rng.choice([None, 0.0, 1.75e9 + rng.randrange(300)])}
        for i in range(1500)
    ]
    full = deltas(spark, rows, **EXTRA)
    changes = history.raw_changes(full)
    want = brute_versions(rows)
    chains = history.build_chains(changes)
    assert got(chains.select("dimension_id", "delta_id")) == want
    assert got(history.belief_history(full).select("dimension_id", "delta_id")) == want
    ends = {}
    for r in sorted(chains.collect(), key=lambda r: (r.dimension_id, r.valid_from)):
        ends.setdefault(r.dimension_id, []).append(r)
    for versions in ends.values():
        assert versions[-1].valid_to is None or any(v.valid_to is None for v in versions)
        assert sorted(v.valid_from for v in versions)[1:] == sorted(v.valid_to for v in versions if v.valid_to is not None)


def test_history_store_replaces_only_touched_chains(spark):
    rows = [{"id": f"d{i}", "dimension_id": f"e{i % 5}.x", "posterior": [("ab"[i % 3 % 2], 1.0)], "ts": 1.75e9 + i} for i in range(60)]
    late = [{"id": "late", "dimension_id": "e1.x", "posterior": [("zz", 1.0)], "ts": 1.75e9 + 99, "valid_time": 1.75e9 + 8}, {"id": "d3", "dimension_id": "e3.x"}]
    store = history.HistoryStore(spark)
    assert got(store.chains()) == [] and got(store.raw()) == []
    store.apply(history.raw_changes(deltas(spark, rows)))
    before = got(store.chains())
    store.apply(history.raw_changes(deltas(spark, late)))
    assert {r[0] for r in got(history.read_chains(spark, f"{store.path}/b2/chains"))} == {"e1.x", "e3.x"}
    after = got(store.chains())
    assert got(store.chains().select("dimension_id", "delta_id")) == brute_versions([{"valid_time": None} | r for r in rows + late[:1]])
    assert [r for r in before if r[0] != "e1.x"] == [r for r in after if r[0] != "e1.x"]
    store.apply(history.raw_changes(deltas(spark, late)))  # again
    assert got(store.chains()) == after and store.raw().count() == 61
    spark.createDataFrame([("x",)], "dimension_id string").write.parquet(f"{store.path}/b9/touched")  # a batch that failed
    assert got(store.chains()) == after
    store.compact()
    assert got(store.chains()) == after and store.raw().count() == 61 and len(store.batches()) == 1 and store.lists() and len(store.names()) == 2
    store.apply(history.raw_changes(deltas(spark, [{"id": "new", "dimension_id": "n.x"}])))
    assert len(got(store.chains())) == len(after) + 1
    store.drop()


def test_history_edge_cases(spark):
    rows = [
        {"id": "a", "posterior": None}, {"id": "b", "posterior": []}, {"id": "c", "posterior": [("unknown", 1.0)]}, {"id": "d", "posterior": [("unknown", 0.6), ("dark_mode", 0.2), ("x", 0.2)]}, {"id": "e", "posterior": [(" Dark   mode ", 1.0)]},
        {"id": "f", "dimension_id": None}, {"id": "g", "ts": None}, {"id": "d", "posterior": [("other", 1.0)]}, {"id": "h", "posterior": [("y" * 100_000, 1.0)], "valid_time": 1.76e12}, {"id": None},
        {"id": "null_seq", "dimension_id": "B.x", "seq": None},
    ]
    assert got(history.belief_history(deltas(spark, rows)).select("dimension_id", "delta_id")) == [("A.x", "d"), ("A.x", "h"), ("B.x", "null_seq")]
    assert got(history.belief_history(deltas(spark, []).limit(0))) == []


def brute_roots(links):
    out = {}
    for node, up in links.items():
        if not up:
            continue
        path, x = [node], node
        while links.get(x) and links[x] in links:
            x = links[x]
            if x in path:
                out[node] = (min(path[path.index(x):]), -1)
                break
            path.append(x)
        else:
            out[node] = (x, len(path) - 1)
    return sorted((k, *v) for k, v in out.items())


@pytest.mark.parametrize(("block", "most_local", "spread"), [(1 << 17, 100_000, 20), (64, 50, 20), (16, 10, 900)])
def test_hierarchies(spark, block, most_local, spread):
    rng = random.Random(spread + block)
    ids = [f"{rng.getrandbits(40):010x}" for _ in range(900)]
    links = {x: (None if rng.random() < 0.1 else ids[max(0, i - rng.randrange(1, spread))] if rng.random() < 0.97 else rng.choice([*ids, "gone", " "])) for i, x in enumerate(ids)}
    rows = [{"id": k, "cascaded_from": v} for k, v in links.items()]
    clean = {k: v if v and v.strip() else None for k, v in links.items()}
    assert got(hierarchy.cascade_roots(deltas(spark, rows, **EXTRA), block=block, most_local=most_local)) == brute_roots(clean)


def test_a_long_chain_and_loops_across_blocks(spark):
    rows = [{"id": f"n{i:04}", "cascaded_from": f"n{i + 1:04}" if i < 699 else None} for i in range(700)] + [{"id": f"r{i:03}", "cascaded_from": f"r{(i + 7) % 200:03}"} for i in range(200)] + [{"id": "self", "cascaded_from": "self"}, {"id": "tail", "cascaded_from": "r000"}]
    links = {r["id"]: r["cascaded_from"] for r in rows}
    assert got(hierarchy.cascade_roots(deltas(spark, rows), block=32, most_local=20)) == brute_roots(links)


@pytest.mark.parametrize("most_local", [8, 1000])
def test_links_that_never_stay_in_a_block(spark, most_local):
    """Numbers in random order: blocks contract hardly anything, coins do."""
    rng = random.Random(3)
    order = list(range(300))
    rng.shuffle(order)
    rows = [(order[i], order[i + 1] if i < 299 else None, 1, f"{order[i]:04}") for i in range(300)] + [(1000, 1001, 1, "a"), (1001, 1000, 1, "b"), (1002, 1000, 1, "0")]
    out = {r.node: (r.state, r.exit, r.hops, r.low) for r in hierarchy.solve(spark.createDataFrame(rows, "node long, parent long, hops long, low string"), 4, 303, most_local).collect()}
    assert len(out) == 303 and all(out[order[i]][:3] == ("root", order[299], 299 - i) for i in range(300))
    assert {out[n][0] for n in (1000, 1001, 1002)} == {"loop"} and {out[n][3] for n in (1000, 1001, 1002)} == {"a"}
    paths = hierarchy.solve_paths(spark.createDataFrame([(n, p, [i]) for n, p, _, i in rows[:300]], "node long, parent long, ids array<string>"), 4, 300, most_local)
    assert {r.node: r.ids for r in paths.collect()} == {order[i]: [f"{x:04}" for x in order[i:]] for i in range(300)}


def test_hierarchy_edge_cases(spark):
    rows = [{"id": "a", "cascaded_from": "b", "seq": 4}, {"id": "b", "cascaded_from": None, "seq": 4}, {"id": "c", "cascaded_from": "a", "seq": None}, {"id": "d", "cascaded_from": "zz"}, {"id": None, "cascaded_from": "a"}, {"id": "a", "cascaded_from": "d", "seq": 9}]
    assert got(hierarchy.cascade_roots(deltas(spark, rows))) == [("a", "b", 1), ("c", "b", 2), ("d", "d", 0)]
    assert got(hierarchy.cascade_paths(deltas(spark, rows))) == [("a", "b", 1, "b/a"), ("c", "b", 2, "b/a/c"), ("d", "d", 0, "d")]
    assert got(hierarchy.cascade_descendants(deltas(spark, rows))) == [("a", "c", 1), ("b", "a", 1), ("b", "c", 2)]
    assert got(hierarchy.cascade_roots(deltas(spark, []).limit(0))) == [] and got(hierarchy.cascade_paths(deltas(spark, []).limit(0))) == []


def test_hierarchies_without_sequence_numbers(spark):
    rows = [{"id": f"n{i:03}", "cascaded_from": f"n{i // 2:03}" if i else None, "seq": None} for i in range(200)]
    assert got(hierarchy.cascade_roots(deltas(spark, rows), block=16, most_local=10)) == brute_roots({r["id"]: r["cascaded_from"] for r in rows})


def test_paths_over_blocks(spark):
    rows = [{"id": f"n{i:03}", "cascaded_from": f"n{i - 1:03}" if i else None} for i in range(60)]
    paths = {r.delta_id: r.path for r in hierarchy.cascade_paths(deltas(spark, rows), block=8, most_local=8).collect()}
    assert paths["n059"] == "/".join(f"n{i:03}" for i in range(60))


DAY = 20_000 * 86_400.0


def test_late_events(spark):
    rows = [
        {"id": "on", "valid_time": DAY + 5, "ts": DAY + 9}, {"id": "at_end", "valid_time": DAY + 5, "ts": DAY + 86_400}, {"id": "last", "valid_time": (DAY + 6) * 1000, "ts": DAY + 86_400 + 72 * 3600}, {"id": "past", "valid_time": DAY, "ts": DAY + 86_400 + 72 * 3600 + 1},
        {"id": "no_time", "ts": DAY + 9}, {"id": "placeholder", "valid_time": 1_000_000.0, "ts": DAY * 2}, {"id": "no_ts", "valid_time": DAY, "ts": None}, {"id": "on", "valid_time": DAY + 5, "ts": DAY * 2}, {"id": "nan", "valid_time": float("nan")},
        {"id": "before", "valid_time": DAY + 99, "ts": DAY - 99, "dimension_id": None},
    ]
    df = deltas(spark, rows, **EXTRA)
    assert got(lateness.late_deltas(df)) == [("at_end", "corrected"), ("last", "corrected"), ("past", "dropped")]
    (day,) = lateness.daily_counts(df).collect()
    assert (day.n_final, day.n_first_published, day.n_corrected, day.n_dropped, day.first_dimension, day.last_dimension, day.n_switches) == (4, 2, 2, 1, "A.x", "", 1)
    assert [r.n_so_far for r in sorted(lateness.provisional_counts(df).collect(), key=lambda r: r.published_on)] == [2, 3, 3, 3]
    assert got(lateness.late_deltas(deltas(spark, []).limit(0))) == []


def test_a_hot_day_is_folded_in_order(spark):
    rng = random.Random(2)
    rows = [{"id": f"d{i}", "dimension_id": rng.choice("pqr"), "valid_time": DAY + rng.choice([0, 86_400]) * (i % 3 == 0) + rng.randrange(80_000), "ts": DAY + rng.randrange(9 * 86_400)} for i in range(1200)]
    out = {r.day: r for r in lateness.days(deltas(spark, rows)).collect()}
    for day in {int(r["valid_time"] // 86_400) for r in rows}:
        kept = sorted((r["valid_time"], i, r["dimension_id"]) for i, r in enumerate(rows) if r["valid_time"] // 86_400 == day and r["ts"] <= (day + 1) * 86_400 + 72 * 3600)
        assert out[day].n == len(kept) and out[day].first_key == kept[0][2] and out[day].last_key == kept[-1][2]
        assert out[day].switches == sum(a[2] != b[2] for a, b in zip(kept, kept[1:]))
        assert out[day].longest_gap == pytest.approx(max(b[0] - a[0] for a, b in zip(kept, kept[1:])))


TYPES = [("age", "bigint"), ("pay", "double"), ("born", "date"), ("alive", "boolean"), ("name", "string")]


def test_wide_tables(spark):
    types = spark.createDataFrame([(a, t, "") for a, t in TYPES], "attribute string, value_type string, accepted string")
    v = lambda x: [("unknown", 0.5), (x, 0.5)]
    dims = dimensions(spark, [
        ("A.age", v("1,200"), 1.0), ("A.AGE", v("x"), 2.0), ("A.Pay", v(" -3,000.50 "), 1.0), ("A.born", v("29.02.2023"), 1.0), ("A.alive", v("YES"), 1.0), ("A.name", v(""), 1.0), ("A.mood", v("?"), 1.0),
        ("B.x.born", v("3 March 2008"), None), ("B.x.alive", v("2"), 1.0), ("B.x.alive", None, 2.0), ("B.x.age", v("99999999999999999999"), 5.0), ("B.x.age", v("99999999999999999999"), 5.0), ("nodot", v("1"), 1.0), (None, v("1"), 1.0), ("C.age", [], 1.0),
        ("C.name", v("z" * 50_000), 1.0), ("C.pay", v("1,20"), 1.0),
    ])
    assert got(widen.unreadable_cells(dims, types)) == [("A", "age"), ("A", "born"), ("B.x", "age"), ("C", "pay")]
    wide = {r.entity: r for r in widen.wide_table(dims.union(dimensions(spark, [("D.mood", v("?"), 1.0)])), types).collect()}
    assert set(wide) == {"A", "B.x", "C", "D"} and wide["D"][1:] == (None,) * 5
    assert (wide["A"].age, wide["A"].pay, wide["A"].born, wide["A"].alive, wide["A"].name) == (None, -3000.5, None, True, "")
    assert str(wide["B.x"].born) == "2008-03-03" and wide["B.x"].alive is None
    assert got(widen.unreadable_cells(dims.limit(0), types)) == [] and got(widen.unreadable_cells(dims, types.limit(0))) == []


def test_cell_store_takes_batches_in_any_order(spark):
    types = spark.createDataFrame([(a, t, "") for a, t in TYPES], "attribute string, value_type string, accepted string")
    v = lambda x: [(x, 1.0)]
    batch = lambda rows: widen.cells(dimensions(spark, rows), types)
    store = widen.CellStore(spark)
    assert store.latest(["age"]).count() == 0
    new, old = batch([("A.age", v("2"), 9.0), ("B.age", None, 5.0)]), batch([("A.age", v("1"), 3.0), ("A.name", v("x"), 1.0), ("B.age", v("7"), 2.0)])
    for b in (new, old, new, batch([])):
        store.apply(b)
    want = {"A": ("2", "x"), "B": (None, None)}
    read = lambda: {r.entity: (r.age and r.age.value, r.name and r.name.value) for r in store.latest(["age", "name"]).collect()}
    assert read() == want and len(store.current()) == 4
    store.compact()
    assert read() == want and len(store.current()) == 1 and store.runs().count() == 2
    store.drop()


@pytest.mark.parametrize(("text", "kind", "ok"), [
    ("+1,234,567", "bigint", True), ("12,34", "bigint", False), ("1.0", "bigint", False), ("1e3", "double", False), ("-0.5", "double", True), (".5", "double", False), ("2024-02-29", "date", True), ("2023-02-29", "date", False),
    ("2024-7-4", "date", False), ("31.12.1999", "date", True), ("31 June 2020", "date", False), ("1 May 2015", "date", True), ("1 Maj 2015", "date", False), ("No", "boolean", True), ("y", "boolean", False), ("anything", "string", True),
])
def test_readable_forms(spark, text, kind, ok):
    value = spark.range(1).select(widen.typed(F.lit(text), kind).alias("v")).first().v
    assert (value is not None) == ok
