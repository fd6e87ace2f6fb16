"""Record linkage, graphs and the scheduler."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import graph, linkage
from marlstone.plans import dag
from marlstone.plans.scratch import cut
from marlstone.queries.base import Query, table


def records(s, d):
    """Customers and suppliers as one table to link."""
    c = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    return c.unionByName(table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("segment"), F.col("s_nationkey").cast("string").alias("nation")))


_R = "r AS (SELECT 'c' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier)"
_BY = [("last4", "name"), ("digits", "name"), ("first4", "name")]
_K = _R + ", k AS (SELECT DISTINCT id, predicate, key FROM (SELECT id, 'last4:name' AS predicate, right(lower(name), 4) AS key FROM r UNION ALL SELECT id, 'digits:name', regexp_replace(name, '[^0-9]', '', 'g') FROM r UNION ALL SELECT id, 'first4:name', left(lower(name), 4) FROM r)), z AS (SELECT predicate, key FROM k GROUP BY ALL HAVING count(*) BETWEEN 2 AND 200), b AS (SELECT k.* FROM k JOIN z USING (predicate, key)), p AS (SELECT a.id AS l, b2.id AS r, a.predicate FROM b a JOIN b b2 ON a.predicate = b2.predicate AND a.key = b2.key AND a.id < b2.id)"


def _keys(s, d):
    return linkage.block_keys(records(s, d), _BY)


_COMPARE = [linkage.Comparison("name"), linkage.Comparison("nation")]


def _compared(s, d):
    return linkage.compared_pairs(_keys(s, d), records(s, d), _COMPARE)


def _scored(s, d):
    c = cut(_compared(s, d), "compared")
    return linkage.score(c, _COMPARE, linkage.fit(c, _COMPARE))


def _predicate_keys(s, d):
    p = table(s, d, "part").select(F.col("p_name").alias("name")).distinct()
    return p.select("name", *[F.array_join(linkage.predicate_keys(F.col("name"), x), ",").alias(x) for x in linkage.PREDICATES])


_GRAMS = "array_to_string(list_sort(list_distinct(list_transform(generate_series(1, length(name) - {0}), lambda i: substr(name, i::BIGINT, {1})))), ',')"
_WORDS = "list_sort(list_distinct(string_split(name, ' ')))"


def edges(s, d):
    """Regions, nations, customers and orders as a layered graph, with a direct edge from each region to its customers beside the path over the nation."""
    n, c, o = table(s, d, "nation"), table(s, d, "customer"), table(s, d, "orders")
    name = lambda k, col: F.concat(F.lit(k), F.col(col).cast("string"))
    e = n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")).unionByName(c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"))).unionByName(o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")))
    e = e.unionByName(c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(name("r", "n_regionkey").alias("src"), name("c", "c_custkey").alias("dst")))
    return e.select(F.lit(1).alias("graph_id"), "src", "dst")


_E = "e AS (SELECT DISTINCT * FROM (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
_HOPS = _E + ", r AS (WITH RECURSIVE w(start, id, hops) AS (SELECT src, dst, 1 FROM e WHERE src LIKE 'r%' UNION SELECT start, dst, hops + 1 FROM w JOIN e ON e.src = w.id) SELECT start, id, min(hops) AS hops FROM w GROUP BY ALL)"


def _regions(s, d):
    return table(s, d, "region").select(F.lit(1).alias("graph_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start"))


def _durations(s, d):
    return graph.nodes_of(edges(s, d)).withColumn("duration", F.length("id").cast("double"))


_FINISH = _E + ", f0 AS (SELECT id, length(id)::DOUBLE AS finish FROM v WHERE id LIKE 'r%'), f1 AS (SELECT dst AS id, length(dst) + max(finish) AS finish FROM e JOIN f0 ON src = f0.id WHERE dst LIKE 'n%' GROUP BY 1), f2 AS (SELECT dst AS id, length(dst) + max(finish) AS finish FROM e JOIN (SELECT * FROM f0 UNION ALL SELECT * FROM f1) f ON src = f.id WHERE dst LIKE 'c%' GROUP BY 1), f3 AS (SELECT dst AS id, length(dst) + max(finish) AS finish FROM e JOIN f2 ON src = f2.id WHERE dst LIKE 'o%' GROUP BY 1)"


def _weighted(s, d):
    """The same edges, each as long as the number of digits of its end."""
    return edges(s, d).withColumn("w", F.length("dst").cast("double"))


def _dag(s, d):
    """A run whose steps count tables: one step is impossible, and what needs it is skipped."""
    count = lambda name: (lambda _: table(s, d, name).count())

    def bad(_):
        raise ValueError("broken")

    nodes = [dag.Node("nation", count("nation")), dag.Node("region", count("region")), dag.Node("both", lambda r: r["nation"] + r["region"], ("nation", "region")), dag.Node("broken", bad, ("region",)), dag.Node("after", lambda r: 1, ("broken", "both")), dag.Node("never", lambda r: 1, ("both",), when=lambda r: r["both"] < 0)]
    return s.createDataFrame([(o.name, o.status, o.reason, str(o.result)) for o in dag.execute(nodes).outcomes.values()], "name string, status string, reason string, result string")


QUERIES: dict[str, Query] = {
    "predicate_keys": Query(
        _predicate_keys,
        f"""SELECT name, left(name, 4) AS first4, left(name, 6) AS first6, right(name, 4) AS last4, array_to_string({_WORDS}, ',') AS token, {_GRAMS.format(2, 3)} AS gram3, {_GRAMS.format(3, 4)} AS gram4,
        array_to_string(list_sort(list_transform({_WORDS}, lambda w: left(w, 1))), '') AS acronym, '' AS digits, replace(name, ' ', '') AS alpha FROM (SELECT DISTINCT p_name AS name FROM part)""",
    ),
    "candidate_pairs": Query(lambda s, d: linkage.candidate_pairs(_keys(s, d)), f'WITH {_K} SELECT l AS "left", r AS "right", count(DISTINCT predicate) AS shared_keys FROM p GROUP BY ALL'),
    "predicate_cost": Query(lambda s, d: linkage.predicate_costs(_keys(s, d)), f"WITH {_K} SELECT predicate, count(DISTINCT (l, r)) AS pairs FROM p GROUP BY 1"),
    "pairs_avoided": Query(
        lambda s, d: records(s, d).agg(F.count("*").alias("n")).join(linkage.candidate_pairs(_keys(s, d)).agg(F.count("*").alias("compared"))).select("compared", linkage.pairs_avoided(F.col("n"), F.col("compared")).alias("avoided")),
        f"WITH {_K}, c AS (SELECT count(DISTINCT (l, r)) AS compared FROM p) SELECT compared, (SELECT count(*) * (count(*) - 1) // 2 FROM r) - compared AS avoided FROM c",
    ),
    "pair_components": Query(
        lambda s, d: graph.connected_components(linkage.candidate_pairs(linkage.block_keys(records(s, d), [("digits", "name")])), "left", "right"),
        f"WITH {_R}, c AS (SELECT regexp_replace(name, '[^0-9]', '', 'g') AS k, min(id) AS component FROM r GROUP BY 1 HAVING count(*) > 1) SELECT id AS node, component FROM r JOIN c ON regexp_replace(name, '[^0-9]', '', 'g') = k",
    ),
    "comparison_levels": Query(lambda s, d: _compared(s, d).groupBy("level_name", "level_nation").agg(F.count("*").alias("pairs"))),
    "em_scores": Query(lambda s, d: _scored(s, d).select("left", "right", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"))),
    "avg_linkage": Query(lambda s, d: linkage.clusters(records(s, d), _scored(s, d), 0.5).select("cluster_id", "size", F.array_join("record_ids", ",").alias("records"), F.round("cohesion", 6).alias("cohesion"))),
    "affine_gap": Query(lambda s, d: table(s, d, "part").select(F.col("p_name").alias("a"), F.col("p_brand").alias("b")).distinct().select("a", "b", F.round(linkage.affine_gap_similarity(F.col("a"), F.col("b")), 6).alias("likeness"))),
    "graph_degrees": Query(lambda s, d: graph.degrees(edges(s, d)).drop("graph_id"), f"WITH {_E} SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS in_degree, (SELECT count(*) FROM e WHERE src = id) AS out_degree FROM v"),
    "graph_roots": Query(lambda s, d: graph.roots(edges(s, d)).select("id"), f"WITH {_E} SELECT id FROM v WHERE id NOT IN (SELECT dst FROM e)"),
    "graph_leaves": Query(lambda s, d: graph.leaves(edges(s, d)).select("id"), f"WITH {_E} SELECT id FROM v WHERE id NOT IN (SELECT src FROM e)"),
    "topo_layers": Query(lambda s, d: graph.topological_layers(edges(s, d)).drop("graph_id"), f"WITH {_E}, d AS (SELECT id FROM v WHERE id NOT IN (SELECT dst FROM e)) SELECT id, CASE WHEN id IN (SELECT id FROM d) THEN 0 WHEN id LIKE 'n%' THEN 1 WHEN id LIKE 'c%' THEN 2 ELSE 3 END AS layer FROM v"),
    "topological_order": Query(lambda s, d: graph.topological_order(edges(s, d)).drop("graph_id")),
    "has_cycle": Query(
        lambda s, d: graph.is_dag(edges(s, d).unionByName(edges(s, d).select(F.lit(2).alias("graph_id"), "src", "dst")).unionByName(edges(s, d).filter("dst LIKE 'o%'").select(F.lit(2).alias("graph_id"), F.col("dst").alias("src"), F.col("src").alias("dst")))),
        "SELECT * FROM (VALUES (1, TRUE), (2, FALSE)) v(graph_id, is_dag)",
    ),
    "find_cycle": Query(lambda s, d: graph.find_cycle(edges(s, d).unionByName(edges(s, d).filter("dst LIKE 'o%'").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))))),
    "strong_components": Query(
        lambda s, d: graph.strongly_connected(table(s, d, "nation").select(F.lit(1).alias("graph_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.pmod(F.col("n_nationkey") + 5, F.lit(25)).cast("string")).alias("dst"))).drop("graph_id"),
        "SELECT 'n' || n_nationkey AS id, (SELECT min('n' || m.n_nationkey) FROM nation m WHERE m.n_nationkey % 5 = nation.n_nationkey % 5) AS component FROM nation",
    ),
    "reachability": Query(lambda s, d: graph.reachable(edges(s, d), _regions(s, d)).select("start", "id", "hops"), f"WITH {_HOPS} SELECT start, id, hops FROM r"),
    "ancestors": Query(
        lambda s, d: graph.ancestors(edges(s, d), table(s, d, "customer").select(F.lit(1).alias("graph_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("start"))).select("start", "id"),
        f"WITH {_E} SELECT dst AS start, src AS id FROM e WHERE dst LIKE 'c%' UNION SELECT a.dst, b.src FROM e a JOIN e b ON a.src = b.dst WHERE a.dst LIKE 'c%'",
    ),
    "shortest_paths": Query(lambda s, d: graph.shortest_paths(_weighted(s, d), _regions(s, d), "w").select("start", "id", "cost"), f"WITH {_E}, w AS (WITH RECURSIVE p(start, id, cost) AS (SELECT DISTINCT 'r' || r_regionkey, 'r' || r_regionkey, 0.0::DOUBLE FROM region UNION SELECT start, dst, cost + length(dst) FROM p JOIN e ON e.src = p.id) SELECT start, id, min(cost) AS cost FROM p GROUP BY ALL) SELECT start, id, cost FROM w"),
    "critical_path": Query(lambda s, d: graph.critical_path(edges(s, d), _durations(s, d)).select("id", "finish"), f"WITH {_FINISH} SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3"),
    "transitive_reduction": Query(lambda s, d: graph.transitive_reduction(edges(s, d)).select("src", "dst"), f"WITH {_E} SELECT src, dst FROM e WHERE NOT (src LIKE 'r%' AND dst LIKE 'c%')"),
    "subgraph": Query(lambda s, d: graph.subgraph(edges(s, d), graph.leaves(edges(s, d)).unionByName(table(s, d, "customer").select(F.lit(1).alias("graph_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))).distinct()).groupBy("src").agg(F.count("*").alias("edges")), f"WITH {_E} SELECT src, count(*) AS edges FROM e WHERE src LIKE 'c%' GROUP BY 1"),
    "dag_outcomes": Query(_dag, "SELECT * FROM (VALUES ('broken', 'failed', 'ValueError: broken', 'None'), ('nation', 'completed', '', '25'), ('region', 'completed', '', '5'), ('after', 'skipped', 'broken failed', 'None'), ('both', 'completed', '', '30'), ('never', 'skipped', 'condition is false', 'None')) v(name, status, reason, result)"),
}
