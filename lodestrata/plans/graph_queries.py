"""Queries over graphs of facts and orders, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import graph as G
from lodestrata.session import rounded, small, table


def _facts(spark, sf_dir):
    """Events as facts: a user, what the event is, and the key of its properties."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("rel"), F.concat(F.lit("k"), k).alias("dst"), "event_id").where("dst is not null")


_FACTS = "f AS (SELECT 'u' || user_id AS src, event_type AS rel, 'k' || json_extract_string(props, '$.k') AS dst, event_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)"


def _web(spark, sf_dir):
    """Customers linked to the customer whose key follows from the order's."""
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 31 % 1009).alias("dst")).distinct()


_WEB = "e AS (SELECT DISTINCT o_custkey AS src, o_orderkey * 31 % 1009 AS dst FROM orders WHERE o_orderpriority = '5-LOW')"


def connected_components(spark, sf_dir):
    """Components of customers linked by dear orders only, so that there are many."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 140000")
    return G.components(o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 31 % 1009).alias("dst")))


COMPONENTS = """
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_orderkey * 31 % 1009 AS b FROM orders WHERE o_totalprice > 140000 AND o_custkey <> o_orderkey * 31 % 1009),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS root FROM b UNION SELECT b.b, r.root FROM r JOIN b ON b.a = r.node WHERE b.b > r.root)
SELECT node, min(root) AS component FROM r GROUP BY node"""


def component_sizes(spark, sf_dir):
    sizes = connected_components(spark, sf_dir).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_components"))


SIZES = f"SELECT size, count(*) AS n_components FROM (SELECT component, count(*) AS size FROM ({COMPONENTS}) GROUP BY component) GROUP BY size"


def recursive_path(spark, sf_dir):
    """Paths of at most four steps from each of ten customers to the one with ten times its key."""
    pairs = spark.range(1, 11).select(F.col("id").alias("start"), (F.col("id") * 10).alias("goal"))
    found = G.paths(_web(spark, sf_dir), pairs, 4)
    return found.select("start", "goal", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


PATH = f"""
WITH RECURSIVE {_WEB}, g AS (SELECT i AS start, i * 10 AS goal FROM range(1, 11) AS t(i)),
r AS (SELECT start, start AS node, [start] AS path FROM g UNION ALL
  SELECT r.start, e.dst, list_append(r.path, e.dst) FROM r JOIN e ON e.src = r.node WHERE len(r.path) <= 4 AND NOT list_contains(r.path, e.dst))
SELECT g.start, g.goal, coalesce(array_to_string((SELECT min(path) FROM r WHERE r.start = g.start AND r.node = g.goal AND len(path) = (SELECT min(len(path)) FROM r AS x WHERE x.start = g.start AND x.node = g.goal)), ','), '') AS path FROM g"""


def recursive_subgraph(spark, sf_dir):
    """Customers within two links of customer 1, either way, and how far they are."""
    return G.hops(_web(spark, sf_dir), spark.range(1, 2).select(F.col("id").alias("node")), 2)


SUBGRAPH = f"""
WITH RECURSIVE {_WEB}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r AS (SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS hop UNION SELECT b.dst, r.hop + 1 FROM r JOIN b ON b.src = r.node WHERE r.hop < 2) SELECT node, min(hop) AS hop FROM r GROUP BY node"""


def shortest_distances(spark, sf_dir):
    """Steps between regions, nations and the nations' suppliers, from each region."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"))
    return G.distances(n.union(s), table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node")), 6)


DISTANCES = """
WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node, CAST(0 AS BIGINT) AS steps FROM region UNION SELECT r.start, b.dst, r.steps + 1 FROM r JOIN b ON b.src = r.node WHERE r.steps < 6)
SELECT start, node, min(steps) AS steps FROM r GROUP BY start, node"""


def local_clustering(spark, sf_dir):
    return G.clustering(_web(spark, sf_dir))


CLUSTERING = f"""
WITH {_WEB}, s AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), b AS (SELECT a AS x, b AS y FROM s UNION ALL SELECT b, a FROM s),
d AS (SELECT x AS node, count(*) AS degree FROM b GROUP BY x),
t AS (SELECT p.x AS node, count(*) AS triangles FROM b AS p JOIN b AS q ON p.x = q.x AND p.y < q.y JOIN s ON s.a = p.y AND s.b = q.y GROUP BY p.x)
SELECT node, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 6)::DOUBLE AS coefficient FROM d LEFT JOIN t USING (node)"""


def neighbours_in_out(spark, sf_dir):
    """Which keys five users are linked to, and which users five keys, as one table."""
    ids = spark.createDataFrame([(f"{c}{i}",) for c in "uk" for i in range(1, 6)], "node string")
    return G.neighbours(_facts(spark, sf_dir), ids)


NEIGHBOURS = f"""WITH {_FACTS} SELECT src AS node, rel, dst AS other FROM f WHERE src IN ('u1', 'u2', 'u3', 'u4', 'u5') UNION SELECT dst, rel, src FROM f WHERE dst IN ('k1', 'k2', 'k3', 'k4', 'k5')"""


def id_filtered_subgraph(spark, sf_dir):
    """Facts that touch any of the users with an error above 150, by relation."""
    ids = table(spark, sf_dir, "events").where("event_type = 'error' and value > 150").select(F.concat(F.lit("u"), "user_id").alias("node")).distinct()
    return G.incident(_facts(spark, sf_dir).select("src", "rel", "dst"), ids)


INCIDENT = f"""WITH {_FACTS} SELECT DISTINCT src, rel, dst FROM f WHERE src IN (SELECT 'u' || user_id FROM events WHERE event_type = 'error' AND value > 150)"""


def nodeset_subgraph(spark, sf_dir):
    """Facts between users that signed up and bought (AND) and the keys below 10."""
    e = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("u"), "user_id").alias("node")).agg(F.collect_set("event_type").alias("kinds"))
    users = e.where(F.array_contains("kinds", "signup") & F.array_contains("kinds", "purchase")).select("node")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(10)], "node string")
    return G.incident(_facts(spark, sf_dir).select("src", "rel", "dst"), users.union(keys), True).distinct()


NODESET = f"""WITH {_FACTS}, u AS (SELECT 'u' || user_id AS node FROM events GROUP BY user_id HAVING bool_or(event_type = 'signup') AND bool_or(event_type = 'purchase'))
SELECT DISTINCT src, rel, dst FROM f WHERE src IN (SELECT node FROM u) AND dst IN ('k0', 'k1', 'k2', 'k3', 'k4', 'k5', 'k6', 'k7', 'k8', 'k9')"""


def triplet_join(spark, sf_dir):
    """Links between customers as triplets with both segments, counted."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("segment"))
    found = G.triplets(_web(spark, sf_dir).withColumn("rel", F.lit("low")), c)
    return found.groupBy("src_segment", "rel", "dst_segment").agg(F.count("*").alias("n"))


TRIPLETS = f"""WITH {_WEB} SELECT a.c_mktsegment AS src_segment, 'low' AS rel, b.c_mktsegment AS dst_segment, count(*) AS n
FROM e JOIN customer AS a ON a.c_custkey = src JOIN customer AS b ON b.c_custkey = dst GROUP BY ALL"""


def _distances(spark, sf_dir):
    """Facts with a distance of their own and for every third node, which follow from the ids."""
    f = _facts(spark, sf_dir).groupBy("src", "rel", "dst").agg(F.min("event_id").alias("event_id"))
    edges = f.select("src", "rel", "dst", F.when(F.col("event_id") % 4 > 0, F.col("event_id") * 37 % 200 / 100).alias("distance"))
    nodes = f.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    n = F.substring("node", 2, 10).cast("long")
    return edges, nodes.where(n % 3 == 0).select("node", (n * 53 % 200 / 100).alias("distance"))


_DIST = f"""{_FACTS}, fe AS (SELECT src, rel, dst, min(event_id) AS event_id FROM f GROUP BY ALL),
ed AS (SELECT src, rel, dst, CASE WHEN event_id % 4 > 0 THEN event_id * 37 % 200 / 100 END AS distance FROM fe),
nd AS (SELECT node, CAST(substr(node, 2) AS BIGINT) * 53 % 200 / 100 AS distance FROM (SELECT src AS node FROM f UNION SELECT dst FROM f) WHERE CAST(substr(node, 2) AS BIGINT) % 3 = 0)"""


def triplet_topk(spark, sf_dir):
    return G.ranked_triplets(*_distances(spark, sf_dir), 25)


TRIPLET_TOPK = f"""WITH {_DIST} SELECT src, rel, dst, round(coalesce(a.distance, 6.5) + coalesce(b.distance, 6.5) + coalesce(ed.distance, 6.5), 6)::DOUBLE AS total
FROM ed LEFT JOIN nd AS a ON a.node = src LEFT JOIN nd AS b ON b.node = dst ORDER BY total, src, rel, dst LIMIT 25"""


def feedback_blended_distance(spark, sf_dir):
    edges, _ = _distances(spark, sf_dir)
    weight = F.when(F.col("dst") > "k5", F.substring("dst", 2, 10).cast("long") / 100)
    return edges.select("src", "rel", "dst", rounded(G.blended(F.col("distance"), weight, 0.3)).alias("blended"))


BLENDED = f"""WITH {_DIST} SELECT src, rel, dst, round(CASE WHEN dst > 'k5' AND distance BETWEEN 0 AND 2 THEN 2 * (0.7 * distance / 2 + 0.3 * (1 - CAST(substr(dst, 2) AS BIGINT) / 100)) ELSE distance END, 6)::DOUBLE AS blended FROM ed"""


def entity_document_frequency(spark, sf_dir):
    return _facts(spark, sf_dir).select("dst", "src").distinct().groupBy(F.col("dst").alias("entity")).agg(F.count("*").alias("n_chunks"))


ENTITY = f"WITH {_FACTS} SELECT dst AS entity, count(DISTINCT src) AS n_chunks FROM f GROUP BY dst"


def cooccurrence_weights(spark, sf_dir):
    """How many users two kinds of events share."""
    return G.cooccurrence(_facts(spark, sf_dir), "src", "rel")


COOCCURRENCE = f"WITH {_FACTS}, m AS (SELECT DISTINCT src, rel FROM f) SELECT x.rel AS a, y.rel AS b, count(*) AS weight FROM m AS x JOIN m AS y ON x.src = y.src AND x.rel < y.rel GROUP BY ALL"


def graph_info_counters(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return f.agg(F.countDistinct("src").alias("n_passages"), F.countDistinct("dst").alias("n_phrases"), F.countDistinct("src", "rel", "dst").alias("n_facts"), F.count("*").alias("n_mentions"))


COUNTERS = f"WITH {_FACTS} SELECT count(DISTINCT src) AS n_passages, count(DISTINCT dst) AS n_phrases, count(DISTINCT (src, rel, dst)) AS n_facts, count(*) AS n_mentions FROM f"


def degree_one_nodes(spark, sf_dir):
    return G.degrees(_web(spark, sf_dir)).where("degree = 1").select("node")


DEGREE_ONE = f"WITH {_WEB} SELECT node FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node HAVING count(*) = 1"


def fact_entity_weights(spark, sf_dir):
    """Scores of facts summed on their keys and divided by how many users have the key."""
    edges, _ = _distances(spark, sf_dir)
    freq = entity_document_frequency(spark, sf_dir).withColumnRenamed("entity", "dst")
    sums = edges.where("distance is not null").groupBy("dst").agg(F.sum("distance").alias("total"))
    return sums.join(freq, "dst").select(F.col("dst").alias("node"), rounded(F.col("total") / F.col("n_chunks")).alias("weight"))


FACT_WEIGHTS = f"""WITH {_DIST} SELECT dst AS node, round(sum(distance) / (SELECT count(DISTINCT src) FROM f WHERE f.dst = ed.dst), 6)::DOUBLE AS weight FROM ed WHERE distance IS NOT NULL GROUP BY dst"""


def link_topk_pruning(spark, sf_dir):
    """The ten keys with the highest mean score keep it, the others get 0."""
    edges, _ = _distances(spark, sf_dir)
    means = edges.where("distance is not null").groupBy("dst").agg(rounded(F.avg("distance")).alias("mean"))
    best = means.orderBy(F.desc("mean"), "dst").limit(10).select("dst", F.lit(True).alias("kept"))
    return means.join(F.broadcast(best), "dst", "left").select(F.col("dst").alias("node"), F.when(F.col("kept"), F.col("mean")).otherwise(0.0).alias("score"))


PRUNING = f"""WITH {_DIST}, m AS (SELECT dst, round(avg(distance), 6)::DOUBLE AS mean FROM ed WHERE distance IS NOT NULL GROUP BY dst)
SELECT dst AS node, CASE WHEN row_number() OVER (ORDER BY mean DESC, dst) <= 10 THEN mean ELSE 0.0 END AS score FROM m"""


def edge_inheritance(spark, sf_dir):
    """Customers whose key ends in 3 are merged into the one three before: what edges are then there."""
    e = _web(spark, sf_dir).select("src", F.when(F.col("dst") % 50 == 0, "merged_to").otherwise("low").alias("rel"), "dst")
    merged = table(spark, sf_dir, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") - 3).alias("new"))
    return G.inherited(e, merged)


INHERITED = f"""WITH {_WEB}, k AS (SELECT src, CASE WHEN dst % 50 = 0 THEN 'merged_to' ELSE 'low' END AS rel, dst FROM e), m AS (SELECT c_custkey AS old, c_custkey - 3 AS new FROM customer WHERE c_custkey % 10 = 3),
j AS (SELECT k.*, a.new AS na, b.new AS nb FROM k LEFT JOIN m AS a ON a.old = src LEFT JOIN m AS b ON b.old = dst)
SELECT DISTINCT CASE WHEN rel = 'merged_to' THEN src ELSE coalesce(na, src) END AS src, rel, CASE WHEN rel = 'merged_to' THEN dst ELSE coalesce(nb, dst) END AS dst FROM j
WHERE rel = 'merged_to' OR (na IS NULL AND nb IS NULL) OR coalesce(na, src) <> coalesce(nb, dst)"""


def without_parent(spark, sf_dir):
    """Customers that no edge to a key below 200 touches."""
    parents = _web(spark, sf_dir).where("dst < 200")
    touched = parents.select(F.explode(F.array("src", "dst")).alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(touched, "c_custkey", "left_anti").select("c_custkey")


NO_PARENT = f"WITH {_WEB} SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT src FROM e WHERE dst < 200 UNION SELECT dst FROM e WHERE dst < 200)"


def tag_overlap_neighbours(spark, sf_dir):
    tags = _facts(spark, sf_dir).select(F.col("src").alias("node"), F.concat_ws(":", "rel", "dst").alias("tag"))
    return G.tag_overlap(tags, spark.createDataFrame([(f"u{i}",) for i in range(10)], "node string"), 5)


TAG_OVERLAP = f"""WITH {_FACTS}, t AS (SELECT DISTINCT src AS node, rel || ':' || dst AS tag FROM f), s AS (SELECT a.node, b.node AS other, count(*) AS shared FROM t AS a JOIN t AS b USING (tag)
WHERE a.node <> b.node AND a.node IN ('u0', 'u1', 'u2', 'u3', 'u4', 'u5', 'u6', 'u7', 'u8', 'u9') GROUP BY ALL)
SELECT node, other, shared, row_number() OVER (PARTITION BY node ORDER BY shared DESC, other) AS place FROM s QUALIFY place <= 5"""


def context_chain(spark, sf_dir):
    """Out-neighbours of the first users by purchases only."""
    ids = spark.createDataFrame([(f"u{i}",) for i in range(20)], "node string")
    return G.neighbours(_facts(spark, sf_dir).where("rel = 'purchase'"), ids, "out").select("node", "other")


CHAIN = f"WITH {_FACTS} SELECT DISTINCT src AS node, dst AS other FROM f WHERE rel = 'purchase' AND substr(src, 2)::BIGINT < 20"


def event_hop_collection(spark, sf_dir):
    """Keys (event nodes) within two undirected steps of user 1."""
    found = G.hops(_facts(spark, sf_dir), spark.createDataFrame([("u1",)], "node string"), 2)
    return found.where("node like 'k%'").select("node")


EVENT_HOPS = f"WITH {_FACTS} SELECT DISTINCT dst AS node FROM f WHERE src = 'u1'"


def foreign_key_edges(spark, sf_dir):
    """Edges from the foreign keys of orders to the rows they name, with the keys that name none."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy(F.col("c_custkey").isNotNull().alias("resolved")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_keys"))


FOREIGN = "SELECT c_custkey IS NOT NULL AS resolved, count(*) AS n, count(DISTINCT o_custkey) AS n_keys FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY 1"


def linked_note_expansion(spark, sf_dir):
    """The five nearest keys of each root user and at most three users linked to each of them."""
    f = _facts(spark, sf_dir).select("src", "dst").distinct()
    roots = f.where("src in ('u1', 'u2', 'u3')")
    w = lambda by, order: F.row_number().over(Window.partitionBy(by).orderBy(order))
    near = roots.withColumn("n", w("src", "dst")).where("n <= 5").select(F.col("src").alias("root"), F.col("dst").alias("note"))
    linked = f.join(small(near.select(F.col("note").alias("dst")).distinct()), "dst").withColumn("n", w("dst", "src")).where("n <= 3")
    return near.join(linked.select(F.col("dst").alias("note"), F.col("src").alias("linked")), "note").select("root", "note", "linked")


EXPANSION = f"""WITH {_FACTS}, p AS (SELECT DISTINCT src, dst FROM f), n AS (SELECT src AS root, dst AS note FROM p WHERE src IN ('u1', 'u2', 'u3') QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 5),
l AS (SELECT dst AS note, src AS linked FROM p QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= 3) SELECT root, note, linked FROM n JOIN l USING (note)"""

def best_first_traversal(spark, sf_dir):
    """Forty customers for each of five queries, nearest first over links of four strengths; only those with a new pair of nation and balance class are expanded."""
    web = _web(spark, sf_dir).withColumn("weight", 1 / (1 + (F.col("src") + F.col("dst")) % 4))
    c = table(spark, sf_dir, "customer")
    concepts = c.select(F.col("c_custkey").alias("node"), F.concat_ws("-", "c_nationkey", F.floor(F.col("c_acctbal") / 500)).alias("concept"))
    starts = c.where("c_custkey % 40 = 1 and c_custkey < 200").select(F.floor(F.col("c_custkey") / 40).cast("long").alias("query_id"), F.col("c_custkey").alias("node"), F.lit(0.5).alias("similarity"))
    return G.best_first(web, concepts, starts, 40)


QUERIES = {
    "best_first_traversal": (best_first_traversal, None),
    "connected_components": (connected_components, COMPONENTS), "component_sizes": (component_sizes, SIZES), "recursive_path": (recursive_path, PATH),
    "recursive_subgraph": (recursive_subgraph, SUBGRAPH), "shortest_distances": (shortest_distances, DISTANCES), "local_clustering": (local_clustering, CLUSTERING),
    "neighbours_in_out": (neighbours_in_out, NEIGHBOURS), "id_filtered_subgraph": (id_filtered_subgraph, INCIDENT), "nodeset_subgraph": (nodeset_subgraph, NODESET),
    "triplet_join": (triplet_join, TRIPLETS), "triplet_topk": (triplet_topk, TRIPLET_TOPK), "feedback_blended_distance": (feedback_blended_distance, BLENDED),
    "entity_document_frequency": (entity_document_frequency, ENTITY), "cooccurrence_weights": (cooccurrence_weights, COOCCURRENCE),
    "graph_info_counters": (graph_info_counters, COUNTERS), "degree_one_nodes": (degree_one_nodes, DEGREE_ONE), "fact_entity_weights": (fact_entity_weights, FACT_WEIGHTS),
    "link_topk_pruning": (link_topk_pruning, PRUNING), "edge_inheritance": (edge_inheritance, INHERITED), "without_parent": (without_parent, NO_PARENT),
    "tag_overlap_neighbours": (tag_overlap_neighbours, TAG_OVERLAP), "context_chain": (context_chain, CHAIN), "event_hop_collection": (event_hop_collection, EVENT_HOPS),
    "foreign_key_edges": (foreign_key_edges, FOREIGN), "linked_note_expansion": (linked_note_expansion, EXPANSION),
}
