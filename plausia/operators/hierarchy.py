"""Parent–child links to full hierarchies.

Nodes are numbered by ingestion sequence and cut into blocks of consecutive numbers. Each block contracts its
local chains to *fragment exits*; the nodes where fragments enter other blocks form a much smaller quotient
forest, solved the same way over wider blocks until one block holds it. The fragments are then expanded with
the solution of their exits. A chain that returns to itself within a block is a local loop, one found in the
quotient a global loop. Where numbers say little about parents and a quotient hardly shrinks, links are contracted
by coins instead, a fixed share of them each time, so that the recursion ends on any forest. Full paths come from the same
recursion, with the ids of a link in place of its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import broadcast_if_small, materialize, shuffle_partitions
from .deltas import first_deliveries, nonblank

#: Columns of a forest: a link from node to parent stands for ``hops`` original links, ``low`` is the
#: smallest id on it (its own end included, its far end not).
_FOREST = "node long, parent long, hops long, low string"
_LINKS = "node long, state string, exit long, hops long, low string"
_MOST_BROADCAST = 20_000
#: A quotient of more than this share of the nodes hardly shrinks.
SHRUNK = 0.7
#: Paths leave a block so many ids at a time.
_IDS = 1_000_000


def _follow(node: np.ndarray, parent: np.ndarray, hops: np.ndarray, low: np.ndarray, has_parent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pointer jumping within one block; ``node`` is sorted. Gives state (0 root, 1 leaves the block, 2 loop),
    exit, hops to it and the smallest id on the way (for a loop, the smallest id in the loop)."""
    n = len(node)
    at = np.searchsorted(node, parent)
    at_ok = np.minimum(at, n - 1)
    local = has_parent & (node[at_ok] == parent)
    jump = np.where(local, at_ok, np.arange(n))
    rank = np.argsort(low, kind="stable")
    position = np.empty(n, np.int64)
    position[rank] = np.arange(n)
    total, least, goes = np.where(local, hops, 0), position.copy(), jump.copy()
    looping = np.zeros(n, bool)
    for _ in range(int(n).bit_length() + 1):
        if not local[goes].any():
            break
        total, least, goes = total + total[goes], np.minimum(least, least[goes]), goes[goes]
    else:  # what still moves after more than n steps runs in a loop
        looping = local[goes]
    ends = goes
    state = np.where(looping, 2, np.where(has_parent[ends], 1, 0))
    leaves = state == 1
    out = np.where(leaves, parent[ends], node[ends])
    steps = total + np.where(leaves, hops[ends], 0)
    if looping.any():  # goes[] lies on the loop by now; the least id of the whole loop is known there
        on_loop = np.unique(goes[looping])
        loop_least = position.copy()
        seen = np.zeros(n, bool)
        for start in on_loop:
            if seen[start]:
                continue
            ring, x = [], start
            while not seen[x]:
                seen[x] = True
                ring.append(x)
                x = jump[x]
            loop_least[ring] = position[ring].min()
        least = np.where(looping, loop_least[goes], least)
    return state, out, steps, low[rank[least]]


_STATES = np.array(["root", "out", "loop"])


def _contract(table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    has = ~table["parent"].is_null().to_numpy(zero_copy_only=False)
    state, out, steps, low = _follow(
        table["node"].to_numpy(), table["parent"].fill_null(-1).to_numpy(), table["hops"].to_numpy(), table["low"].to_numpy(zero_copy_only=False), has
    )
    return pa.table({"node": table["node"], "state": pa.array(_STATES[state], pa.string()), "exit": pa.array(out, pa.int64()), "hops": pa.array(steps, pa.int64()), "low": pa.array(low, pa.string())})


def solve(forest: DataFrame, block: int, size: int, most_local: int = 1_000_000) -> DataFrame:
    """``node, state, exit, hops, low`` for each node: ``root`` with the root's number and its distance, or
    ``loop`` with the smallest id in it. ``forest`` has each node once and only parents that are nodes."""
    width = block if size > most_local else None
    key = F.floor(F.col("node") / width) if width else F.lit(0)
    links = materialize(forest.groupBy(key.alias("block")).applyInArrow(_contract, _LINKS), "links")
    if not width:
        return links
    entries = links.where("state = 'out'").select(F.col("exit").alias("node")).distinct()
    quotient = materialize(links.join(entries, "node", "left_semi").select("node", F.when(F.col("state") == "out", F.col("exit")).alias("parent"), F.when(F.col("state") == "out", F.col("hops")).otherwise(0).cast("long").alias("hops"), "low", "state", F.col("exit").alias("own_exit"), F.col("hops").alias("own_hops")), "quotient")
    left = quotient.count()
    forest_q = quotient.select("node", "parent", "hops", "low")
    wider = max(block * 2, block * size // max(left, 1))
    if left <= SHRUNK * size:
        solved = solve(forest_q, wider, left, most_local)
    else:
        kept, gone = contracted(forest_q, left, lambda near, far: {"hops": near["hops"] + F.coalesce(far["hops"], F.lit(0)), "low": F.least(near["low"], far["low"])})
        ends = materialize(solve(kept, wider, kept.count(), most_local), "solved")
        near, far = gone.alias("near"), ends.alias("far")
        joined = near.join(far, F.col("near.parent") == F.col("far.node"))
        solved = ends.unionAll(joined.select("near.node", "far.state", "far.exit", (F.col("near.hops") + F.col("far.hops")).alias("hops"), "far.low"))
    # a quotient root is an entry whose own fragment ends within its block: at a root or in a loop
    ends = quotient.select(F.col("node").alias("exit"), F.col("state").alias("end_state"), "own_exit", "own_hops", F.col("low").alias("own_low"))
    known = solved.join(ends, "exit", "left").select(
        "node",
        F.when(F.col("state") == "loop", "loop").otherwise(F.col("end_state")).alias("end"),
        F.col("own_exit").alias("root"),
        (F.col("hops") + F.col("own_hops")).alias("more"),
        F.when(F.col("state") == "loop", F.col("low")).otherwise(F.col("own_low")).alias("end_low"),
    )
    known = broadcast_if_small(materialize(known, "exits"), _MOST_BROADCAST)
    out = links.where("state = 'out'").alias("l").join(known.alias("k"), F.col("l.exit") == F.col("k.node"))
    expanded = out.select("l.node", F.col("k.end").alias("state"), F.col("k.root").alias("exit"), (F.col("l.hops") + F.col("k.more")).alias("hops"), F.col("k.end_low").alias("low"))
    return links.where("state <> 'out'").unionAll(expanded)


def contracted(forest: DataFrame, salt: int, merge: Callable[[dict[str, Column], dict[str, Column]], dict[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """``forest`` without the nodes whose coin fell on tails and their parent's on heads, a quarter of all links, and
    these. Links to a node that went lead to its parent instead; ``merge`` gives their columns. A parent of a node
    that went never goes itself, so one join does."""
    coin = lambda c: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(2))
    goes = F.col("parent").isNotNull() & (coin(F.col("node")) == 0) & (coin(F.col("parent")) == 1)
    gone = materialize(forest.where(goes), "gone")
    near, far = forest.where(~goes).alias("near"), gone.alias("far")
    joined = near.join(far, F.col("near.parent") == F.col("far.node"), "left")
    sides = ({c: F.col(f"{side}.{c}") for c in forest.columns} for side in ("near", "far"))
    kept = joined.select("near.node", F.coalesce("far.parent", "near.parent").alias("parent"), *(c.alias(name) for name, c in merge(*sides).items()))
    return materialize(kept, "kept"), gone


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    range_no, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.record_batch([*batch.columns, pa.array(np.full(n, range_no), pa.int32()), pa.array(np.arange(at, at + n), pa.int64())], names=[*batch.schema.names, "range_no", "place"])
        at += n


def numbered_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``number``, their place (from 0) in the given order, which must tell them apart: places in sorted ranges,
    and where each range begins."""
    spark = rows.sparkSession
    ranges = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = materialize(ranges.mapInArrow(_places, f"{fields}, range_no int, place long"), "places")
    sizes, begins, at = sorted(map(tuple, placed.groupBy("range_no").count().collect())), [], 0  # one row a range
    for range_no, n in sizes:
        begins.append((range_no, at))
        at += n
    starts = broadcast_if_small(spark.createDataFrame(begins, "range_no int, begins long"), 1_000_000)
    return placed.join(starts, "range_no").select(*rows.columns, (F.col("begins") + F.col("place")).alias("number"))


def nodes_of(deltas: DataFrame) -> DataFrame:
    """``node, id, has_link, parent``: deltas numbered by ``seq`` (a null one counts as 0, equal ones are told
    apart by id), links resolved to numbers.

    Null and blank links are none; a link to an absent delta has ``has_link`` but no parent; a delta that names
    itself is a loop.
    """
    first = materialize(first_deliveries(deltas, nonblank(F.col("cascaded_from")).alias("link")).withColumn("seq", F.coalesce("seq", F.lit(0)).cast("long")), "nodes")
    if first.select("seq").distinct().count() < first.count():
        in_order = numbered_rows(first.select("id", "seq", "link"), ["seq", "id"])
        first = materialize(in_order.select("id", F.col("number").alias("seq"), "link"), "nodes")
    ids = first.select(F.col("id").alias("link"), F.col("seq").alias("parent"))
    linked = first.where("link is not null").join(ids, "link", "left").select(F.col("seq").alias("node"), "id", F.lit(True).alias("has_link"), "parent")
    plain = first.where("link is null").select(F.col("seq").alias("node"), "id", F.lit(False).alias("has_link"), F.lit(None).cast("long").alias("parent"))
    return materialize(linked.unionAll(plain), "numbered")


def solved_hierarchy(nodes: DataFrame, *, block: int = 1 << 17, most_local: int = 100_000) -> DataFrame:
    forest = nodes.select("node", "parent", F.lit(1).cast("long").alias("hops"), F.col("id").alias("low"))
    return solve(forest, block, nodes.count(), most_local)


def cascade_roots(deltas: DataFrame, *, block: int = 1 << 17, most_local: int = 100_000) -> DataFrame:
    """``delta_id, root_id, depth``: one row per delta with a ``cascaded_from``.

    ``depth`` counts the links to the last existing delta (0 if the first leads nowhere, the delta being its
    own root); a delta in or above a loop has the smallest id in the loop and -1.
    """
    nodes = nodes_of(deltas)
    solved = solved_hierarchy(nodes, block=block, most_local=most_local)
    linked = nodes.where("has_link").select("node", F.col("id").alias("delta_id"))
    ends = linked.join(solved, "node")
    names = nodes.select(F.col("node").alias("exit"), F.col("id").alias("root_name"))
    roots = ends.where("state = 'root'").join(names, "exit").select("delta_id", F.col("root_name").alias("root_id"), F.col("hops").alias("depth"))
    loops = ends.where("state = 'loop'").select("delta_id", F.col("low").alias("root_id"), F.lit(-1).cast("long").alias("depth"))
    return roots.unionAll(loops)


def _chains_of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node the ids from itself up to the last node in its block, and the parent beyond; a bounded number
    of ids at a time."""
    table = pa.Table.from_batches(batches).sort_by("node")
    node, parent = table["node"].to_numpy(), table["parent"].fill_null(-1).to_numpy()
    held = table["ids"].combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    values, begins, sizes = held.flatten(), held.offsets.to_numpy()[:-1] - held.offsets.to_numpy()[0], held.value_lengths().to_numpy().astype(np.int64)
    at = np.minimum(np.searchsorted(node, parent), len(node) - 1)
    local = (parent >= 0) & (node[at] == parent)
    up, top = np.where(local, at, -1), np.where(local, at, np.arange(len(node)))
    links, ids = local.astype(np.int64), np.where(local, sizes, 0)  # up to ``top``, not with it
    while local[top].any():
        links, ids, top = links + links[top], ids + ids[top], top[top]
    links, ids = links + 1, ids + sizes[top]
    first = 0
    while first < len(node):
        last = max(first + 1, int(np.searchsorted(np.cumsum(ids[first:]), _IDS, "right")) + first)
        of = np.arange(first, last)
        starts, members, now, step = np.cumsum(links[of]) - links[of], np.empty(links[of].sum(), np.int64), of.copy(), 0
        active = np.arange(len(of))
        while len(active):
            members[starts[active] + step] = now[active]
            now[active] = up[now[active]]
            active, step = active[now[active] >= 0], step + 1
        n = sizes[members]
        taken = np.repeat(begins[members] - np.cumsum(n) + n, n) + np.arange(n.sum())
        chains = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(ids[of])], pa.int32()), values.take(pa.array(taken)))
        beyond = parent[top[of]]
        yield pa.record_batch([pa.array(node[of]), chains, pa.array(beyond, pa.int64(), mask=beyond < 0)], names=["node", "ids", "beyond"])
        first = last


def solve_paths(forest: DataFrame, block: int, size: int, most_local: int) -> DataFrame:
    """``node, ids``: of each node of a forest without loops the ids from itself up to its root. A link of
    ``forest(node, parent, ids)`` stands for the ids on it, without its far end."""
    width = block if size > most_local else None
    key = F.floor(F.col("node") / width) if width else F.lit(0)
    parts = materialize(forest.select("node", "parent", "ids").groupBy(key.alias("block")).applyInArrow(_chains_of_block, "node long, ids array<string>, beyond long"), "fragments")
    if not width:
        return parts.select("node", "ids")
    entries = parts.where("beyond is not null").select(F.col("beyond").alias("node")).distinct()
    quotient = materialize(parts.join(entries, "node", "left_semi").select("node", F.col("beyond").alias("parent"), "ids"), "quotient")
    left = quotient.count()
    wider = max(block * 2, block * size // max(left, 1))
    after = lambda near, far: near.join(far, F.col("near.beyond") == F.col("far.node")).select("near.node", F.concat("near.ids", "far.ids").alias("ids"))
    if left <= SHRUNK * size:
        solved = solve_paths(quotient, wider, left, most_local)
    else:
        kept, gone = contracted(quotient, left, lambda near, far: {"ids": F.when(far["node"].isNull(), near["ids"]).otherwise(F.concat(near["ids"], far["ids"]))})
        ends = materialize(solve_paths(kept, wider, kept.count(), most_local), "solved")
        solved = ends.unionAll(after(gone.withColumnRenamed("parent", "beyond").alias("near"), ends.alias("far")))
    return parts.where("beyond is null").select("node", "ids").unionAll(after(parts.where("beyond is not null").alias("near"), solved.alias("far")))


def _chains(deltas: DataFrame, block: int, most_local: int) -> DataFrame:
    """``node, delta_id, chain``: the ids from each delta with a link up to its root, loops left out."""
    nodes = nodes_of(deltas)
    solved = solved_hierarchy(nodes, block=block, most_local=most_local)
    free = materialize(nodes.join(solved.where("state = 'root'").select("node"), "node", "left_semi"), "free")
    whole = solve_paths(free.select("node", "parent", F.array("id").alias("ids")), block, free.count(), most_local)
    linked = free.where("has_link").select("node", F.col("id").alias("delta_id"))
    return whole.join(linked, "node").select("node", "delta_id", F.col("ids").alias("chain"))


def cascade_paths(deltas: DataFrame, *, block: int = 1 << 17, most_local: int = 100_000) -> DataFrame:
    """``delta_id, root_id, depth, path``: the full path from the root down, ids set apart by ``/``, for every
    delta with a link whose way doesn't run into a loop."""
    chains = _chains(deltas, block, most_local)
    return chains.select("delta_id", F.element_at("chain", -1).alias("root_id"), (F.size("chain") - 1).cast("long").alias("depth"), F.array_join(F.reverse("chain"), "/").alias("path"))


def cascade_descendants(deltas: DataFrame, *, block: int = 1 << 17, most_local: int = 100_000) -> DataFrame:
    """``ancestor_id, descendant_id, distance``: every delta with all that descend from it; as many rows as
    the depths add up to, and no row gathers the descendants of a node."""
    chains = _chains(deltas, block, most_local)
    return chains.select(F.col("delta_id").alias("descendant_id"), F.posexplode("chain").alias("distance", "ancestor_id")).where("distance > 0").select("ancestor_id", "descendant_id", F.col("distance").cast("long").alias("distance"))
