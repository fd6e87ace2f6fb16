"""Graph operators over tables of edges (graph_id, src, dst[, weight]) and nodes (graph_id, id).

Set-at-a-time steps cut their lineage with tables in the shared folder that the session names. A graph of over LAYERS
layers is put in order as one group; so is a walk of over HOPS steps to a cycle, over one edge for each node.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.keyed import HOT_ROWS, follow, join_stats
from marlstone.operators.rows import numbered
from marlstone.plans.scratch import cut, fresh

#: Layers that are put in order set by set, in a round of jobs each.
LAYERS = 64
#: Steps of a walk to a cycle that are joins.
HOPS = 32
#: Rounds in which ends are peeled off one by one before chains of them are followed.
PEELS = 4


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.col("src").alias("id")).union(edges.select("graph_id", F.col("dst").alias("id"))).distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, id, in_degree, out_degree) over distinct edges."""
    e = edges.select("graph_id", "src", "dst").distinct()
    outs = e.groupBy("graph_id", F.col("src").alias("id")).agg(F.count("*").alias("o"))
    ins = e.groupBy("graph_id", F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    every = nodes if nodes is not None else nodes_of(edges)
    return every.join(ins, ["graph_id", "id"], "left").join(outs, ["graph_id", "id"], "left").select("graph_id", "id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def roots(edges: DataFrame) -> DataFrame:
    return degrees(edges).filter("in_degree = 0").select("graph_id", "id")


def leaves(edges: DataFrame) -> DataFrame:
    return degrees(edges).filter("out_degree = 0").select("graph_id", "id")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])


def subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges both of whose ends are in keep (graph_id, id)."""
    return edges.join(keep.select("graph_id", F.col("id").alias("src")), ["graph_id", "src"], "left_semi").join(keep.select("graph_id", F.col("id").alias("dst")), ["graph_id", "dst"], "left_semi")


def missing_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends of edges that are no nodes."""
    return nodes_of(edges).join(nodes, ["graph_id", "id"], "left_anti")


def longest_chains(ids: DataFrame, edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, position) of ids (id): the most edges (id, up) that lead from it upwards, one after another; null in or after a cycle.

    Nodes with one edge up are followed by pointer doubling, in as many rounds as the logarithm of their chain's length; only
    where several edges lead up from a node, the graph of such nodes is peeled layer by layer. Edges to nodes that aren't there
    don't count. Rows that look for one node are split if they are very many.
    """
    ids = cut(ids.select("id").distinct(), "chains")
    edges = cut(follow(edges.select("id", "up").distinct(), ids.select(F.col("id").alias("up")), "up", hot_rows), "chains")
    counted = edges.groupBy("id").agg(F.count("*").alias("n_up"), F.min("up").alias("up"))
    # each node points to its only parent, or else to itself: it is an anchor
    one = F.col("n_up") == 1
    now = ids.join(counted.hint("shuffle_hash"), "id", "left").select("id", F.when(one, F.col("up")).alias("up"), F.when(one, 1).otherwise(0).cast("long").alias("d"), F.coalesce("n_up", F.lit(0)).alias("n_up"))
    now = cut(now.withColumn("anchor", F.when(F.col("up").isNull(), F.col("id"))), "chains")
    for _ in range(max(1, ids.count()).bit_length() + 1):
        going = now.filter("anchor IS NULL")
        if not going.limit(1).count():
            break
        there = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("d").alias("more"), F.col("anchor").alias("end"))
        step = follow(going, there, "up", hot_rows).select("id", F.col("next").alias("up"), (F.col("d") + F.col("more")).alias("d"), "n_up", F.col("end").alias("anchor"))
        now = cut(step.unionByName(now.filter("anchor IS NOT NULL")), "chains")
    roots = now.filter("n_up = 0").select(F.col("id").alias("anchor"), F.lit(0).cast("long").alias("base"))
    joints = now.filter("n_up > 1").select("id")
    placed = roots
    if joints.limit(1).count():
        ends = now.select(F.col("id").alias("up"), "anchor", (F.col("d") + 1).alias("w"))
        meet = follow(edges.join(joints.hint("shuffle_hash"), "id", "left_semi"), ends, "up", hot_rows).select("id", "anchor", "w")  # of chains that end in a cycle, anchor is null
        meet = cut(meet, "chains")
        waiting = cut(meet.groupBy("id").agg(F.count("*").alias("need"), F.lit(0).cast("long").alias("best")), "chains")
        front = roots
        while True:
            given = follow(meet.filter("anchor IS NOT NULL"), front, "anchor", hot_rows).groupBy("id").agg(F.count("*").alias("came"), F.max(F.col("base") + F.col("w")).alias("at"))
            left = waiting.join(given.hint("shuffle_hash"), "id", "left").select("id", (F.col("need") - F.coalesce("came", F.lit(0))).alias("need"), F.greatest("best", F.coalesce("at", F.lit(0))).alias("best"))
            left = cut(left, "chains")
            front = left.filter("need = 0").select(F.col("id").alias("anchor"), F.col("best").alias("base"))
            if not front.limit(1).count():
                break
            placed, waiting = placed.unionByName(front), left.filter("need > 0")
    known = follow(now.filter("anchor IS NOT NULL").select("id", "d", "anchor"), placed, "anchor", hot_rows).select("id", (F.col("base") + F.col("d")).alias("position"))
    return ids.join(known.hint("shuffle_hash"), "id", "left").select("id", "position")


def topological_layers(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, id, layer): the longest distance from a root. Nodes on or after a cycle are absent."""
    node = lambda c: F.struct("graph_id", F.col(c).alias("id"))
    every = (nodes if nodes is not None else nodes_of(edges)).select(node("id").alias("id"))
    found = longest_chains(every, edges.select(node("dst").alias("id"), node("src").alias("up"))).filter("position IS NOT NULL")
    return found.select("id.graph_id", "id.id", F.col("position").cast("int").alias("layer"))


def is_dag(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, is_dag): no node is left after the layers are peeled."""
    every = nodes if nodes is not None else nodes_of(edges)
    left = every.join(topological_layers(edges, nodes), ["graph_id", "id"], "left_anti").groupBy("graph_id").count()
    return every.select("graph_id").distinct().join(left, "graph_id", "left").select("graph_id", F.col("count").isNull().alias("is_dag"))


def reachable(edges: DataFrame, start: DataFrame, most: int = 10_000) -> DataFrame:
    """(graph_id, start, id, hops): nodes reached over one edge or more from start (graph_id, start), with the fewest hops. On a cycle a start reaches itself."""
    e = cut(edges.select("graph_id", "src", "dst").distinct())
    front = cut(start.select("graph_id", "start", F.col("start").alias("src")).join(e, ["graph_id", "src"]).select("graph_id", "start", F.col("dst").alias("id")).distinct())
    seen = front.withColumn("hops", F.lit(1))
    for hops in range(2, most):
        step = front.select("graph_id", "start", F.col("id").alias("src")).join(e, ["graph_id", "src"]).select("graph_id", "start", F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen.select("graph_id", "start", "id"), ["graph_id", "start", "id"], "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front.withColumn("hops", F.lit(hops)))
    raise RuntimeError("reachability did not end")


def ancestors(edges: DataFrame, start: DataFrame) -> DataFrame:
    return reachable(reverse(edges), start)


def shortest_paths(edges: DataFrame, start: DataFrame, weight: str | None = None, most: int = 10_000) -> DataFrame:
    """(graph_id, start, id, cost, previous): least cost from each start; previous is the node before on a least path, the smallest of equal ones."""
    if weight and edges.filter(F.col(weight) < 0).limit(1).count():
        raise ValueError("negative weight")
    e = cut(edges.select("graph_id", "src", "dst", (F.col(weight) if weight else F.lit(1)).cast("double").alias("w")).groupBy("graph_id", "src", "dst").agg(F.min("w").alias("w")))
    best = cut(start.select("graph_id", "start", F.col("start").alias("id"), F.lit(0.0).alias("cost"), F.lit(None).cast(dict(start.dtypes)["start"]).alias("previous")))
    front = best
    for _ in range(most):
        step = front.alias("f").join(e.alias("e"), (F.col("f.graph_id") == F.col("e.graph_id")) & (F.col("f.id") == F.col("e.src"))).select("f.graph_id", "f.start", F.col("e.dst").alias("id"), (F.col("f.cost") + F.col("e.w")).alias("cost"), F.col("f.id").alias("previous"))
        both = best.withColumn("old", F.lit(True)).unionByName(step.withColumn("old", F.lit(False)))
        won = both.groupBy("graph_id", "start", "id").agg(F.min(F.struct("cost", F.col("previous").isNotNull().alias("p"), "previous")).alias("b"), F.min(F.when(F.col("old"), F.col("cost"))).alias("was"))
        won = cut(won.select("graph_id", "start", "id", "b.cost", "b.previous", "was"))
        front = won.filter("was IS NULL OR cost < was").drop("was")
        best = won.drop("was")
        if not front.limit(1).count():
            return best
    raise RuntimeError("paths did not settle")


def path_to(paths: DataFrame, graph_id, start, target) -> list | None:
    """One path's nodes, or None if the target isn't reached."""
    rows = {r["id"]: r["previous"] for r in paths.filter((F.col("graph_id") == graph_id) & (F.col("start") == start)).collect()}
    if target not in rows:
        return None
    out = [target]
    while rows[out[-1]] is not None:
        out.append(rows[out[-1]])
    return out[::-1]


def critical_path(edges: DataFrame, durations: DataFrame) -> DataFrame:
    """(graph_id, id, finish, previous): the latest finish of each node of a DAG, where a node takes its duration (graph_id, id, duration); the larger of equal previous nodes."""
    layers = cut(topological_layers(edges, durations.select("graph_id", "id")))
    depth = layers.agg(F.max("layer")).first()[0]
    timed = cut(layers.join(durations, ["graph_id", "id"]))
    e = cut(edges.select("graph_id", "src", "dst").distinct())
    kind = dict(durations.dtypes)["id"]
    done = timed.filter("layer = 0").select("graph_id", "id", F.col("duration").cast("double").alias("finish"), F.lit(None).cast(kind).alias("previous"))
    for k in range(1, (depth or 0) + 1):
        now = timed.filter(F.col("layer") == k)
        before = e.join(done.select("graph_id", F.col("id").alias("src"), "finish"), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("id"), F.struct("finish", F.col("src").alias("previous")).alias("b"))
        step = now.join(before, ["graph_id", "id"]).groupBy("graph_id", "id", "duration").agg(F.max("b").alias("b"))
        done = cut(done.unionByName(step.select("graph_id", "id", (F.col("b.finish") + F.col("duration")).alias("finish"), F.col("b.previous").alias("previous"))))
    return done


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges of a DAG whose target no other direct successor reaches."""
    e = cut(edges.select("graph_id", "src", "dst").distinct())
    reach = reachable(e, e.select("graph_id", F.col("dst").alias("start")).distinct())
    implied = cut(e.withColumnRenamed("dst", "start").join(cut(reach), ["graph_id", "start"]).select("graph_id", "src", F.col("id").alias("dst")).distinct())
    return e.join(implied, ["graph_id", "src", "dst"], "left_anti")


def _star(edges: DataFrame, large: bool, hot_rows: int) -> DataFrame:
    """One star step over edges (u > v). Large: every larger neighbour of a node is linked to the node's least neighbour; small: every smaller neighbour and the node itself."""
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    met = join_stats(around, least, "u", "n", "inner", hot_rows)
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str, dst: str, hot_rows: int = HOT_ROWS, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node that can be reached.

    Large-star and small-star steps in turn, until the edges no longer change; each pair is written to the shared folder.
    Rounds grow with the logarithm of the longest path. Edges with a null end or equal ends are ignored.
    """
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct()
    now = cut(now, "cc")
    digest = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")]
    seen = now.agg(*digest).first()
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        now = cut(_star(cut(_star(now, True, hot_rows), "cc"), False, hot_rows), "cc")
        after = now.agg(*digest).first()
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _grouped(edges: DataFrame, nodes: DataFrame, fn: Callable[[list, dict], pd.DataFrame], schema: str) -> DataFrame:
    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out: dict = {i: [] for i in sorted(n["id"])}
        for a, b in sorted(set(zip(e["src"], e["dst"], strict=True))):
            out[a].append(b)
        found = fn(list(out), out)
        found.insert(0, "graph_id", (n["graph_id"].iloc[0] if len(n) else e["graph_id"].iloc[0]))
        return found

    return fresh(nodes).groupBy("graph_id").cogroup(fresh(edges.select("graph_id", "src", "dst")).groupBy("graph_id")).applyInPandas(run, schema)


def topological_order(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, position, id): the smallest ready node first. Nodes on or after a cycle are absent.

    A node is taken once the last of its predecessors is; over those links the graph is a forest. A node's path from its root
    comes after another's if the largest ids that are left, looking from each to the path's end, are larger: so each node gets
    these ids, falling ones that end in its own, from the greatest list among its predecessors, layer by layer, and the lists
    are sorted by ranges. Graphs of over LAYERS layers, where lists may be long, are one group each.
    """
    every = nodes if nodes is not None else nodes_of(edges)
    layers = cut(topological_layers(edges, every), "layers")
    deep = cut(layers.groupBy("graph_id").agg(F.max("layer").alias("layer")).filter(F.col("layer") >= LAYERS).select("graph_id"), "deep")
    if not deep.limit(1).count():
        return _order_by_layers(edges, layers)
    shallow = layers.join(deep, "graph_id", "left_anti")
    one = _order_in_one(edges.join(deep, "graph_id", "left_semi"), every.join(deep, "graph_id", "left_semi"))
    return _order_by_layers(edges, shallow).unionByName(one)


def _order_by_layers(edges: DataFrame, layers: DataFrame) -> DataFrame:
    node = lambda c: F.struct("graph_id", F.col(c).alias("id"))
    ends = layers.filter("layer > 0").select(node("id").alias("id"), "layer")
    e = cut(follow(edges.select(node("dst").alias("id"), node("src").alias("up")).distinct(), ends, "id"), "ordered")
    placed = layers.filter("layer = 0").select(node("id").alias("up"), F.array("id").alias("path"))
    for k in range(1, (layers.agg(F.max("layer")).first()[0] or 0) + 1):
        last = follow(e.filter(F.col("layer") == k).select("id", "up"), placed, "up").groupBy("id").agg(F.max("path").alias("path"))
        now = last.select(F.col("id").alias("up"), F.concat(F.filter("path", lambda x: x > F.col("id.id")), F.array("id.id")).alias("path"))
        placed = placed.unionByName(cut(now, "ordered"))
    counted = cut(numbered(placed.select("up.graph_id", "path"), "graph_id", "path"), "ordered")
    first = counted.groupBy("graph_id").agg(F.min("n").alias("first"), F.count("*").alias("_rows"))
    return join_stats(counted, first, "graph_id", "_rows").select("graph_id", (F.col("n") - F.col("first")).cast("int").alias("position"), F.element_at("path", -1).alias("id"))


def _order_in_one(edges: DataFrame, every: DataFrame) -> DataFrame:
    gid, kind = dict(every.dtypes)["graph_id"], dict(every.dtypes)["id"]

    def order(ids: list, out: dict) -> pd.DataFrame:
        waiting = dict.fromkeys(ids, 0)
        for targets in out.values():
            for t in targets:
                waiting[t] += 1
        ready = [i for i in ids if not waiting[i]]
        heapq.heapify(ready)
        done = []
        while ready:
            one = heapq.heappop(ready)
            done.append(one)
            for t in out[one]:
                waiting[t] -= 1
                if not waiting[t]:
                    heapq.heappush(ready, t)
        return pd.DataFrame({"position": range(len(done)), "id": done})

    return _grouped(edges, every, order, f"graph_id {gid}, position int, id {kind}")


def find_cycle(edges: DataFrame) -> DataFrame:
    """(graph_id, cycle): the first cycle of a depth-first search in order of ids, its first node repeated at the end; null where there is none.

    Nodes from which no cycle is reached change nothing in that search and are peeled off. All others have an edge to such a
    node, so the search never turns back: it starts at the least of them and takes each time the least edge, until it meets
    its own path.
    """
    node = lambda c: F.struct("graph_id", F.col(c).alias("id"))
    e = cut(edges.select("graph_id", "src", "dst").distinct(), "cycle")
    every = cut(nodes_of(e), "cycle")
    gid, kind = dict(every.dtypes)["graph_id"], dict(every.dtypes)["id"]
    live, least = every, e
    for _ in range(PEELS):  # mostly a few rounds do
        ends = cut(live.join(least.select("graph_id", F.col("src").alias("id")).distinct(), ["graph_id", "id"], "left_anti"), "cycle")
        if not ends.limit(1).count():
            break
        live = cut(live.join(ends, ["graph_id", "id"], "left_anti"), "cycle")
        least = cut(least.join(ends.select("graph_id", F.col("id").alias("dst")), ["graph_id", "dst"], "left_anti").select("graph_id", "src", "dst"), "cycle")
    else:
        live = cut(live.join(topological_layers(reverse(least), live), ["graph_id", "id"], "left_anti"), "cycle")
        least = follow(least.select("graph_id", "src", node("dst").alias("up")), live.select(node("id").alias("up")), "up").select("graph_id", "src", F.col("up.id").alias("dst"))
    least = least.groupBy("graph_id", "src").agg(F.min("dst").alias("dst"))
    least = cut(least, "cycle")
    walk = cut(live.groupBy("graph_id").agg(F.array(F.min("id")).alias("path"), F.lit(None).cast(f"array<{kind}>").alias("cycle")), "cycle")
    for _ in range(HOPS):
        going = walk.filter("cycle IS NULL")
        if not going.limit(1).count():
            break
        met = going.select("graph_id", "path", F.element_at("path", -1).alias("src")).join(least, ["graph_id", "src"])
        at = F.array_position("path", F.col("dst"))
        step = met.select("graph_id", F.concat("path", F.array("dst")).alias("path"), F.when(at > 0, F.concat(F.expr("slice(path, cast(array_position(path, dst) as int), size(path))"), F.array("dst"))).alias("cycle"))
        walk = cut(step.unionByName(walk.filter("cycle IS NOT NULL")), "cycle")
    far = walk.filter("cycle IS NULL").select("graph_id", F.element_at("path", -1).alias("start"))
    found = walk.filter("cycle IS NOT NULL").select("graph_id", "cycle")
    if far.limit(1).count():

        def follow_on(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            to = dict(zip(rows["src"], rows["dst"], strict=True))
            now, at = rows["root"].iloc[0], {}
            while now not in at:
                at[now] = len(at)
                now = to[now]
            return pd.DataFrame({"graph_id": [key[0]], "cycle": [[*list(at)[at[now] :], now]]})

        roots = far.join(walk.select("graph_id", F.col("path")[0].alias("root")), "graph_id").select("graph_id", "root")
        found = found.unionByName(least.join(roots, "graph_id").groupBy("graph_id").applyInPandas(follow_on, f"graph_id {gid}, cycle array<{kind}>"))
    return every.select("graph_id").distinct().join(found, "graph_id", "left").select("graph_id", "cycle")


def strongly_connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, id, component): the least node of each strongly connected component: nodes that reach each other."""
    every = nodes if nodes is not None else nodes_of(edges)
    every = cut(every)
    reach = cut(reachable(edges, every.select("graph_id", F.col("id").alias("start"))))
    back = reach.select("graph_id", F.col("id").alias("start"), F.col("start").alias("id"))
    mutual = reach.join(back, ["graph_id", "start", "id"], "left_semi").select("graph_id", "start", F.col("id").alias("other")).groupBy("graph_id", F.col("start").alias("id")).agg(F.min("other").alias("c"))
    return every.join(mutual, ["graph_id", "id"], "left").select("graph_id", "id", F.least(F.coalesce("c", "id"), "id").alias("component"))


def validate_dag(edges: DataFrame, required: DataFrame | None = None) -> None:
    """Raise if a graph has a cycle, or a required node (graph_id, id) is in no edge."""
    bad = is_dag(edges).filter("NOT is_dag").first()
    if bad is not None:
        raise ValueError(f"cycle in graph {bad['graph_id']}")
    if required is not None and (lost := required.join(nodes_of(edges), ["graph_id", "id"], "left_anti").first()) is not None:
        raise ValueError(f"missing node {lost['id']}")


def longest(finishes: DataFrame) -> DataFrame:
    """The end of each graph's critical path: the latest finish, the smallest of equal ids."""
    last = Window.partitionBy("graph_id").orderBy(F.desc("finish"), "id")
    return finishes.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
