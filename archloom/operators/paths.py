"""Simple paths between two nodes, in the order a queue would find them.

Hits come by depth, then by the array of (list, edge key) of their hops, where list 0 holds a node's outgoing edges and
list 1 what is appended: all incoming edges in connected mode, else the consumers of a topic. Levels stop once enough
hits are there. Paths that can't end at the target any more are pruned: a level only keeps paths whose last node reaches
the target within the hops left, which walks from the start and back from the target, half the way each, tell beforehand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archloom.functions.scores import path_cost, path_score
from archloom.operators.traverse import SMALL_FRONTIER, Some, Steps
from archloom.session import cut, cut_counted
from archloom.sources.registry import Registry

TOPIC = "contract:topic:"


def hops(edges: DataFrame, registry: Registry, connected: bool, structural: bool, derivations: tuple[str, ...], backwards: DataFrame | None = None) -> DataFrame:
    """a, b, list, edge_key, edge_type, confidence of every hop that a path may take, and whether it is active. Hops against
    an edge's direction are those of `backwards` if it is given."""

    def allowed(frame: DataFrame) -> DataFrame:
        if not structural:
            frame = frame.where(~F.col("edge_type").isin(*registry.structural))
        return frame.where(F.col("derivation_kind").isin(*derivations)) if derivations else frame

    open_, against = allowed(edges), allowed(edges if backwards is None else backwards)
    pick = lambda f, a, b, n: f.select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(n).alias("list"), "edge_key", "edge_type", "confidence", "active")
    back = against if connected else against.where((F.col("edge_type") == "CONSUMES_TOPIC") & F.col("to_node_key").startswith(TOPIC))
    return pick(open_, "from_node_key", "to_node_key", 0).unionAll(pick(back, "to_node_key", "from_node_key", 1))


def _useful(all_hops: DataFrame, start: str, end: str, depth: int, some: Some | None) -> DataFrame:
    """The hops that a path of `depth` hops may take, with `left`: how many hops it is from b to the target, at least. A hop
    in the first half of a path leaves a node near the start, any other leads to a node near the target, so that only the
    hops at those nodes are computed."""
    spark, half, steps = all_hops.sparkSession, depth - depth // 2, Steps(all_hops, some)
    at = lambda frame: frame.select(F.col("node").alias("_at"))
    near = spark.range(1).select(F.lit(end).alias("node"), F.lit(0).alias("left"))
    ring, n, back = near, 1, []
    for i in range(1, depth - half + 1):
        back.append(steps.at("b", at(ring), n))
        fresh = back[-1].select(F.col("a").alias("node"), F.lit(i).alias("left")).distinct()
        ring, (n,) = cut_counted(fresh.join(near.select("node"), "node", "left_anti"), F.count("*"))
        near = near.unionAll(ring)
        if not n:
            break
    left_from = spark.range(1).select(F.lit(start).alias("node"))
    front, m, ahead = left_from, 1, []
    for i in range(1, half + 1):
        ahead.append(steps.at("a", at(front), m))
        if i == half:
            break
        front, (m,) = cut_counted(ahead[-1].select(F.col("b").alias("node")).distinct().join(left_from, "node", "left_anti"), F.count("*"))
        if not m:
            break
        left_from = left_from.unionAll(front)
    some = reduce(DataFrame.unionAll, ahead)
    for rows in back:  # a node's hops come whole, so those of nodes near the start are there
        some = some.unionAll(rows.join(left_from, F.col("a") == F.col("node"), "left_anti"))
    for i in range(depth - half + 1, depth):
        if not n:
            break
        close = F.broadcast(ring) if n <= SMALL_FRONTIER else ring
        ring = some.select("a", "b").join(close, F.col("node") == F.col("b")).select(F.col("a").alias("node"), F.lit(i).alias("left")).distinct()
        ring, (n,) = cut_counted(ring.join(near.select("node"), "node", "left_anti"), F.count("*"))
        near = near.unionAll(ring)
    return cut(some.join(near, F.col("b") == F.col("node")).drop("node"))


def paths(edges: DataFrame, registry: Registry, start: str, end: str, depth: int = 10, top_k: int = 5, connected: bool = False, structural: bool = False, derivations: tuple[str, ...] = (), some: Some | None = None) -> DataFrame:
    """rank, depth, cost, score, nodes, edges, types, total_found of the top_k paths by cost. `some` looks edges up."""
    depth, top_k = (depth if depth > 0 else 10), (top_k if top_k > 0 else 5)
    spark = edges.sparkSession
    ends = {"a": ("from_node_key", "to_node_key"), "b": ("to_node_key", "from_node_key")}  # of a hop along an edge, and against it

    def found_at(column: str, nodes: DataFrame) -> DataFrame:
        return hops(some(ends[column][0], nodes), registry, connected, structural, derivations, some(ends[column][1], nodes))

    useful = _useful(hops(edges, registry, connected, structural, derivations), start, end, depth, some and found_at)
    way = "array<struct<list:int,edge_key:string>>"
    level = spark.range(1 if start != end else 0).select(F.lit(start).alias("at"), F.array(F.lit(start)).alias("nodes"), F.expr(f"cast(array() as {way})").alias("ord"), F.expr("cast(array() as array<string>)").alias("types"), F.expr("cast(array() as array<double>)").alias("confidences"))
    hits, found, n = None, 0, 1
    for d in range(1, depth + 1):
        grown = useful.join(F.broadcast(level) if n <= SMALL_FRONTIER else level, (F.col("at") == F.col("a")) & (F.col("left") <= depth - d) & ~F.array_contains("nodes", F.col("b")))
        grown = grown.select(F.col("b").alias("at"), F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("ord", F.struct("list", "edge_key")).alias("ord"), F.array_append("types", F.col("edge_type")).alias("types"), F.array_append("confidences", F.col("confidence")).alias("confidences"))
        level, counts = cut_counted(grown, F.count_if(F.col("at") == end), F.count("*"))
        here = level.where(F.col("at") == end)
        found, n = found + counts[0], counts[1] - counts[0]
        hits = here if hits is None else hits.unionAll(here)
        level = level.where(F.col("at") != end)
        if found >= top_k * 10 or not n:
            break
    scored = hits.select(F.size("ord").alias("depth"), path_cost(F.col("confidences")).alias("cost"), path_score(F.col("confidences")).alias("score"), F.array_join("nodes", ",").alias("nodes"), F.array_join(F.transform("ord", lambda x: x["edge_key"]), ",").alias("edges"), F.array_join("types", ",").alias("types"), "ord")
    first = scored.orderBy("depth", "ord").limit(top_k * 10)
    return first.orderBy("cost", "depth", "nodes", "ord").limit(top_k).withColumn("total_found", F.lit(min(found, top_k * 10))).drop("ord")
