"""Graph operators over edge tables (src, dst): degrees, hops, ranks, isolated nodes; lineage is cut by checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import rounded, written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in, degree (a loop counts twice)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count("*").alias("degree"))


def hops(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, hop: the nodes within `depth` undirected steps of the start nodes, with the fewest steps; start nodes have 0.

    Each step joins the new nodes only, and is written to the shared folder.
    """
    links = both_ways(edges).distinct()
    seen = start.select(F.col("node"), F.lit(0).cast("long").alias("hop")).distinct()
    front = seen
    for step in range(1, depth + 1):
        reached = front.join(links, front.node == links.src).select(F.col("dst").alias("node")).distinct()
        front = written(reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(step).cast("long")), "hops")
        seen = seen.union(front)
    return seen


def personal_rank(edges: DataFrame, reset: DataFrame, damping: float = 0.5, rounds: int = 20) -> DataFrame:
    """node, score after a fixed number of rounds of x = (1 - damping) * r + damping * W x over undirected weighted edges.

    edges: src, dst, weight; reset: node, r (scaled to sum 1 here); negative, null and NaN weights count as 0. What nodes without
    edges would pass on goes to r, so scores sum to 1. They are not rounded, as they grow smaller with the graph.
    """
    positive = lambda c: F.when((F.col(c) > 0) & ~F.isnan(c), F.col(c)).otherwise(0.0)
    w = edges.select("src", "dst", positive("weight").alias("weight")).where("weight > 0")
    w = w.union(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = w.groupBy("src").agg(F.sum("weight").alias("total"))
    links = written(w.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "links")
    total = reset.agg(F.sum(positive("r"))).first()[0] or 1.0
    r = written(reset.select("node", (positive("r") / F.lit(float(total))).alias("r")).where("r > 0"), "reset")
    # only nodes of the reset can lack edges: all others are reached by one. What they hold is r times a number that each round scales
    alone = r.join(links.select(F.col("src").alias("node")).distinct(), "node", "left_anti").agg(F.sum("r")).first()[0] or 0.0
    x, given = r.select("node", F.col("r").alias("score")), 1.0
    for n in range(rounds):
        moved = links.join(x, links.src == x.node).groupBy("dst").agg(F.sum(F.col("share") * F.col("score")).alias("in"))
        x = r.join(moved, r.node == moved.dst, "full").select(
            F.coalesce("node", "dst").alias("node"),
            (F.coalesce("r", F.lit(0.0)) * (1 - damping + damping * alone * given) + F.coalesce("in", F.lit(0.0)) * damping).alias("score"),
        )
        given = 1 - damping + damping * alone * given
        if n % 4 == 3:
            x = written(x, "ranks")
    return x.select("node", "score")


def metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, mean_degree (2m/n), density (m / n(n-1)), n_loops, n_isolated."""
    counts = edges.agg(F.count("*").alias("n_edges"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("n_loops"))
    joined = nodes.join(degrees(edges), "node", "left")
    of_nodes = joined.agg(F.count("*").alias("n_nodes"), F.sum(F.col("degree").isNull().cast("long")).alias("n_isolated"))
    n, m = F.col("n_nodes"), F.col("n_edges")
    return of_nodes.join(F.broadcast(counts.withColumn("one", F.lit(1))), F.lit(1) == F.col("one")).select(
        "n_nodes", "n_edges", rounded(2 * m / n).alias("mean_degree"), rounded(m / (n * (n - 1))).alias("density"), "n_loops", "n_isolated"
    )


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(src, dst) links to (node, component): the smallest node that is linked, directly or not, by alternating star steps.

    Loops and repeated links change nothing; a null on either side is no link, and nodes without links do not appear.
    Each round is written to the shared folder; nothing is gathered on the driver.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        near = (both_ways(links) if large else links).withColumnRenamed("src", "at").withColumnRenamed("dst", "other")
        near = near if large else near.where("other < at")
        least = near.groupBy("at").agg(F.min("other").alias("m")).withColumn("m", F.least("at", "m"))
        moved = near.where("other > at") if large else near
        out = moved.join(least, "at").select(F.col("other").alias("src"), F.col("m").alias("dst"))
        out = out if large else out.union(least.select(F.col("at").alias("src"), F.col("m").alias("dst")))
        return out.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()

    links = edges.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    links, before = written(links, "links"), None
    for _ in range(max_rounds):
        links = written(star(star(links, True), False), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == before:
            ends = links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
            return ends.union(links.select(F.col("dst").alias("node"), F.col("dst").alias("component"))).distinct()
        before = now
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def paths(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(start, goal) with the shortest directed path of at most `depth` steps as an array; of equal ones the smallest; [] where there is none.

    Each node that a start reaches keeps one path, that of its first step; a frontier holds nodes, not all paths.
    """
    links = edges.select("src", "dst").distinct()
    front = pairs.select("start").distinct().select("start", F.col("start").alias("node"), F.array("start").alias("path"))
    seen = front
    for _ in range(depth):
        reached = front.join(links, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        reached = reached.select("start", "node", F.array_append("path", F.col("node")).alias("path"))
        front = written(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "paths")
        seen = seen.union(front)
    found = seen.withColumnRenamed("node", "goal")
    return pairs.distinct().join(found, ["start", "goal"], "left").select("start", "goal", F.coalesce("path", F.array().cast("array<string>")).alias("path"))


def distances(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node, steps: undirected distances from each start (column node) to what it reaches within depth steps."""
    links = both_ways(edges).distinct()
    front = starts.select(F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("steps")).distinct()
    seen = front
    for n in range(1, depth + 1):
        reached = front.join(links, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = written(reached.join(seen, ["start", "node"], "left_anti").withColumn("steps", F.lit(n).cast("long")), "distances")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def clustering(edges: DataFrame) -> DataFrame:
    """node, degree, triangles, coefficient of the simple undirected graph; nodes of degree 1 have 0.

    Each edge points to the end with the larger (degree, node), so a hub's many edges are not paired with each other.
    """
    simple = edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    simple = written(simple, "simple")
    degree = simple.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    ranked = simple.join(degree.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = written(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("high")), "out")
    wedge = out.select("low", F.col("high").alias("x")).join(out.select("low", F.col("high").alias("y")), "low").where("x < y")
    closed = wedge.join(simple, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")))
    triangles = closed.select(F.explode(F.array("low", "x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    n, t = F.col("degree"), F.coalesce("triangles", F.lit(0))
    coefficient = F.when(n > 1, 2 * t / (n * (n - 1))).otherwise(0.0)
    return degree.join(triangles, "node", "left").select("node", "degree", t.alias("triangles"), rounded(coefficient).alias("coefficient"))


def neighbours(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """node, rel, other, of the edges (src, rel, dst) that leave ("out") or enter ("in") the given nodes, or both, each once."""
    out = edges.select(F.col("src").alias("node"), "rel", F.col("dst").alias("other"))
    into = edges.select(F.col("dst").alias("node"), "rel", F.col("src").alias("other"))
    found = {"out": out, "in": into, "both": out.union(into)}[direction]
    return found.join(ids.select("node").distinct(), "node", "left_semi").distinct()


def incident(edges: DataFrame, ids: DataFrame, both_ends: bool = False) -> DataFrame:
    """The edges (src, rel, dst) with either end, or both, among the ids."""
    wanted = ids.select("node").distinct()
    at = lambda c: edges.join(wanted.withColumnRenamed("node", c), c, "left_semi").select(edges.columns)
    if both_ends:
        return at("src").join(wanted.withColumnRenamed("node", "dst"), "dst", "left_semi").select(edges.columns)
    return at("src").union(at("dst")).distinct()


def triplets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, rel, dst) with the columns of both end nodes (node, ...), named src_... and dst_...; an end that is no node leaves its edge out."""
    rest = [c for c in nodes.columns if c != "node"]
    side = lambda end: nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in rest))
    return edges.join(side("src"), "src").join(side("dst"), "dst")


def inherited(edges: DataFrame, merged: DataFrame, never: str = "merged_to") -> DataFrame:
    """Edges (src, rel, dst) after nodes are merged (old, new): each edge but those of the relation `never` moves to the survivor, loops go, repeats once."""
    a, b = merged.select(F.col("old").alias("src"), F.col("new").alias("src_new")), merged.select(F.col("old").alias("dst"), F.col("new").alias("dst_new"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left")
    stays = F.col("rel") == never
    src, dst = (F.when(stays, F.col(c)).otherwise(F.coalesce(f"{c}_new", c)) for c in ("src", "dst"))
    touched = ~stays & (F.col("src_new").isNotNull() | F.col("dst_new").isNotNull())
    return moved.select(src.alias("src"), "rel", dst.alias("dst"), touched.alias("touched")).where("not touched or src != dst").select("src", "rel", "dst").distinct()


def ranked_triplets(edges: DataFrame, nodes: DataFrame, k: int, missing: float = 6.5) -> DataFrame:
    """The k triplets with the smallest summed distance of both nodes and the edge; what has no distance counts as `missing`, ties to smaller ends.

    edges: src, rel, dst, distance; nodes: node, distance. The limit is taken in each task before rows are gathered.
    """
    d = lambda end: nodes.select(F.col("node").alias(end), F.col("distance").alias(f"{end}_distance"))
    far = lambda c: F.coalesce(F.col(c), F.lit(missing))
    scored = edges.join(d("src"), "src", "left").join(d("dst"), "dst", "left")
    total = rounded(far("src_distance") + far("dst_distance") + far("distance"))
    return scored.select("src", "rel", "dst", total.alias("total")).orderBy("total", "src", "rel", "dst").limit(k)


def blended(distance: Column, weight: Column, factor: float) -> Column:
    """A distance from 0 to 2 blended with a feedback weight: 2 * ((1 - f) * d / 2 + f * (1 - w)); other distances stay."""
    factor = min(1.0, max(0.0, factor))
    moved = 2 * ((1 - factor) * distance / 2 + factor * (1 - weight))
    return F.when(weight.isNotNull() & distance.between(0, 2), moved).otherwise(distance)


def cooccurrence(memberships: DataFrame, group: str, item: str, most: int = 1000) -> DataFrame:
    """a < b, weight: in how many groups two items are together. A group of over `most` items raises an error: its pairs would grow with its square."""
    items = memberships.select(group, item).distinct().groupBy(group).agg(F.sort_array(F.collect_set(item)).alias("items"))
    checked = items.select(F.when(F.size("items") <= most, F.col("items")).otherwise(F.raise_error(F.lit("a group has too many items")).cast(items.schema["items"].dataType)).alias("items"))
    pairs = checked.select("items", F.posexplode("items").alias("at", "a")).select("a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight"))


def tag_overlap(tags: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """node, other, shared: for each asked node the k others that share most tags (node, tag), ties to the smaller one."""
    mine = tags.join(asked.select("node").distinct(), "node", "left_semi").distinct()
    shared = mine.join(tags.distinct().withColumnRenamed("node", "other"), "tag").where("node != other").groupBy("node", "other").agg(F.count("*").alias("shared"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "other"))
    return shared.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def best_first(
    edges: DataFrame, concepts: DataFrame, starts: DataFrame, most: int | None = None, goals: DataFrame | None = None, max_rounds: int = 500
) -> DataFrame:
    """query_id, node, distance, place, expanded: the nodes that each query settles, nearest first, from its starts on, all queries in one job a round.

    edges: src, dst, weight (undirected, above 0; of several between two nodes the strongest counts), a step's length is 1 / weight; concepts: node, concept; starts: query_id, node, similarity
    (above 0), at the distance 1 / similarity. Nodes settle in the order of distance, then node; a settled node is expanded to its neighbours only if it has a
    concept that no node settled before it has. A query ends after `most` nodes, or with the first settled one of its goals (query_id, node), or where nothing is left.

    A round settles a bucket: of each query all open nodes less than one shortest step beyond its nearest open one, which no other open node can bring closer. So rounds
    follow the longest path in shortest steps, not the number of nodes; each is written to the shared folder.
    """
    links = both_ways_weighted(edges)
    shortest = links.agg(F.min("length")).first()[0] or 1.0
    concepts = written(concepts.where("concept is not null").select("node", "concept").distinct(), "concepts")
    open_nodes = starts.where("similarity > 0").groupBy("query_id", "node").agg(F.min(1 / F.col("similarity")).alias("distance"))
    ended = [c for c in (most, goals) if c is not None]
    settled, seen = None, None
    for _ in range(max_rounds):
        open_nodes = written(open_nodes, "open")
        if open_nodes.isEmpty():
            break
        nearest = F.min("distance").over(Window.partitionBy("query_id"))
        marked = open_nodes.withColumn("in_bucket", F.col("distance") < nearest + shortest)
        bucket = marked.where("in_bucket").select("query_id", "node", "distance")
        fresh = bucket.join(concepts, "node")
        fresh = fresh if seen is None else fresh.join(seen, ["query_id", "concept"], "left_anti")
        holders = written(fresh.groupBy("query_id", "concept").agg(F.min(F.struct("distance", "node")).alias("first")), "holders")
        expand = holders.select("query_id", F.col("first.node").alias("node"), F.lit(True).alias("expanded")).distinct()
        part = written(bucket.join(expand, ["query_id", "node"], "left").withColumn("expanded", F.coalesce("expanded", F.lit(False))), "settled")
        settled = part if settled is None else settled.union(part)
        seen = holders.select("query_id", "concept") if seen is None else seen.union(holders.select("query_id", "concept"))
        reached = part.where("expanded").join(links, F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node"), (F.col("distance") + F.col("length")).alias("distance"))
        reached = reached.join(settled.select("query_id", "node"), ["query_id", "node"], "left_anti")
        ahead = marked.where("not in_bucket").select("query_id", "node", "distance").union(reached)
        open_nodes = ahead.groupBy("query_id", "node").agg(F.min("distance").alias("distance"))
        if ended:
            done = settled.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= (most or 1 << 62)).select("query_id")
            if goals is not None:
                done = done.union(settled.join(goals.select("query_id", "node"), ["query_id", "node"], "left_semi").select("query_id")).distinct()
            open_nodes = open_nodes.join(done, "query_id", "left_anti")
    else:
        raise RuntimeError(f"nodes are still open after {max_rounds} rounds")
    if settled is None:
        return open_nodes.select("query_id", "node", "distance", F.lit(0).cast("long").alias("place"), F.lit(False).alias("expanded"))
    order = Window.partitionBy("query_id").orderBy("distance", "node")
    out = settled.withColumn("place", F.row_number().over(order).cast("long"))
    if most is not None:
        out = out.where(F.col("place") <= most)
    if goals is not None:
        hit = out.join(goals.select("query_id", "node").distinct().withColumn("hit", F.lit(True)), ["query_id", "node"], "left")
        before = F.coalesce(F.max("hit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        out = hit.withColumn("over", before).where("not over")
    return out.select("query_id", "node", "distance", "place", "expanded")


def both_ways_weighted(edges: DataFrame) -> DataFrame:
    """src, dst, length: undirected edges (src, dst, weight) in both directions, without loops; the length is 1 / weight of the strongest."""
    w = edges.where((F.col("weight") > 0) & (F.col("src") != F.col("dst"))).select("src", "dst", "weight")
    w = w.union(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return written(w.groupBy("src", "dst").agg((1 / F.max("weight")).alias("length")), "links")
