"""Breadth-first walks, level by level.

The first discovery of a node in a queue that visits edges in key order is the walk whose edge keys, as an array, are the
least among its shortest ones. So each level is a join, an anti-join against what was seen, and min_by over that array,
and all of them run in parallel. The driver keeps the depth and learns how many nodes a level found.

A frontier is broadcast while its counted rows are SMALL_FRONTIER or fewer, and only the edges at its nodes are computed
then: Spark takes the broadcast keys down to the tables that edges come from, or the caller finds them sooner (`Some`). Beyond, all steps are computed and written
once, narrow, and joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archloom.functions.scores import impact_score, round_at
from archloom.session import cut, cut_counted
from archloom.sources.registry import Registry

#: Rows of a frontier up to which it is broadcast; a row holds the way from the start, so its size is bounded by the depth.
SMALL_FRONTIER = 20_000


def narrow(edges: DataFrame, derivations: tuple[str, ...] = ()) -> DataFrame:
    """What walks need of the edges with one of the derivations (all if none is given), and whether they are active."""
    open_ = edges.where(F.col("derivation_kind").isin(*derivations)) if derivations else edges
    return open_.select("edge_key", "from_node_key", "to_node_key", "edge_type", "trust_score", "active")


def current(frame: DataFrame, key: str, number: str) -> DataFrame:
    """The open version of each key with the greatest number."""
    opened = frame.where(F.coalesce("valid_to", F.lit(0)) == 0)
    return opened.groupBy(key).agg(F.max_by(F.struct(*frame.columns), number).alias("_row")).select("_row.*")


def known(nodes: DataFrame, key: str) -> None:
    """An unknown node is an error. One job reads the keys of all partitions side by side."""
    if not nodes.where(F.col("node_key") == key).count():
        raise LookupError(f"node not found: {key}")


#: Of a column and few nodes (a column named _at): rows that have all whose column is among the nodes, and others perhaps.
Some = Callable[[str, DataFrame], DataFrame]


class Steps:
    """Active steps, looked up by the node at one of their ends. Nothing is computed before it is looked up. Steps at few
    nodes come from `some` if it is given, and are written before inactive ones are left out, as Spark takes no join down past
    a filter on what is aggregated."""

    def __init__(self, frame: DataFrame, some: Some | None = None):
        self._frame, self._some, self._whole = frame, some or (lambda column, nodes: frame), None

    def at(self, column: str, nodes: DataFrame, n: int) -> DataFrame:
        """The steps whose `column` is among the n different rows of nodes (a column named _at)."""
        if n > SMALL_FRONTIER and self._whole is None:
            self._whole = cut(self._frame.where("active").drop("active"))
        few = F.broadcast(nodes) if n <= SMALL_FRONTIER else nodes
        if self._whole is None:
            return cut(self._some(column, nodes).join(few, F.col(column) == F.col("_at"), "left_semi")).where("active").drop("active")
        return self._whole.join(few, F.col(column) == F.col("_at"), "left_semi")


def walk(edges: DataFrame, start: str, depth: int, reverse: bool = False, some: Some | None = None) -> tuple[DataFrame, int]:
    """Nodes reached from start over active edges (edge_key, from_node_key, to_node_key, edge_type, trust_score, active): node_key, depth,
    ord (edge keys), keys (nodes from the start on), types, product (of trust). The start isn't among them. The rows are a
    union of written tables, one for each level. Also the greatest depth. `some` looks edges up."""
    found, reached, _ = _walk(edges, start, depth, reverse, some)
    return found, reached


def _walk(edges: DataFrame, start: str, depth: int, reverse: bool, some: Some | None = None) -> tuple[DataFrame, int, int]:
    """`walk`, and how many nodes there are."""
    a, b = ("to_node_key", "from_node_key") if reverse else ("from_node_key", "to_node_key")
    steps_of = lambda e: e.select(F.col(a).alias("node_key"), F.col(b).alias("next"), "edge_key", "edge_type", "trust_score", "active")
    steps = Steps(steps_of(edges), some and (lambda column, at: steps_of(some(a, at))))
    none = "cast(array() as array<string>)"
    seen = edges.sparkSession.range(1).select(F.lit(start).alias("node_key"), F.lit(0).alias("depth"), F.expr(none).alias("ord"), F.array(F.lit(start)).alias("keys"), F.expr(none).alias("types"), F.lit(1.0).alias("product"))
    frontier, found, reached, total = seen, 1, 0, 0
    for level in range(1, depth + 1):
        near = F.broadcast(frontier) if found <= SMALL_FRONTIER else frontier
        ways = F.struct(F.array_append("ord", F.col("edge_key")).alias("ord"), F.array_append("keys", F.col("next")).alias("keys"), F.array_append("types", F.col("edge_type")).alias("types"), (F.col("product") * F.col("trust_score")).alias("product"))
        best = steps.at("node_key", frontier.select(F.col("node_key").alias("_at")), found).join(near, "node_key").select("next", ways.alias("way")).groupBy("next").agg(F.min_by("way", "way.ord").alias("way"))
        fresh = best.join(seen.select(F.col("node_key").alias("next")), "next", "left_anti")
        frontier, (found,) = cut_counted(fresh.select(F.col("next").alias("node_key"), F.lit(level).alias("depth"), "way.ord", "way.keys", "way.types", "way.product"), F.count("*"))
        if not found:
            break
        seen, reached, total = seen.unionAll(frontier), level, total + found
    return seen.where("depth > 0"), reached, total


def deps(nodes: DataFrame, edges: DataFrame, start: str, depth: int, reverse: bool = False, derivations: tuple[str, ...] = (), some: Some | None = None) -> DataFrame:
    """Dependencies (or dependents) of a node with attributes and the rank of discovery. An unknown start is an error."""
    known(nodes, start)
    found, _, n = _walk(narrow(edges, derivations), start, depth, reverse, some and (lambda column, at: narrow(some(column, at), derivations)))
    shown = (F.broadcast(found) if n <= SMALL_FRONTIER else found).join(nodes.select("node_key", "name", "layer", "node_type", "trust_score", "freshness", "status"), "node_key")
    return shown.select("node_key", "name", "layer", "node_type", "depth", "trust_score", "freshness", "status", F.array_join("ord", "|").alias("via"))


#: Edges from a node to what it offers to others.
SURFACE = ("EXPOSES_ENDPOINT", "PUBLISHES_TOPIC")


@dataclass(frozen=True)
class Impact:
    nodes: DataFrame
    surface: DataFrame
    max_depth_reached: int


def impact(nodes: DataFrame, edges: DataFrame, registry: Registry, start: str, depth: int = 10, top_k: int = 50, min_score: float = 0.0, derivations: tuple[str, ...] = (), include_structural: bool = False, some: Some | None = None) -> Impact:
    """What breaks if start changes. include_structural changes nothing: a structural edge isn't walked backwards at all."""
    depth, top_k = (depth if depth > 0 else 10), (top_k if top_k > 0 else 50)
    known(nodes, start)
    shown = F.col("edge_type").isin(*SURFACE)
    walked = ~F.col("edge_type").isin(*(registry.structural | registry.no_reverse))
    chosen = F.col("derivation_kind").isin(*derivations) if derivations else F.lit(True)
    taken = lambda e: narrow(e.where(walked & chosen & ~shown))
    found, reached = walk(taken(edges), start, depth, reverse=True, some=some and (lambda column, at: taken(some(column, at))))
    scored = found.select("node_key", "depth", impact_score(F.col("product"), F.col("depth")).alias("score"), round_at(F.col("product"), 3).alias("trust_chain"), F.array_join("keys", ">").alias("path"), F.array_join("types", ">").alias("edge_types"), "ord")
    top = cut(scored.where(F.col("score") >= min_score).orderBy(F.desc("score"), "depth", "ord").limit(top_k))
    named = (F.broadcast(top) if top_k <= SMALL_FRONTIER else top).join(nodes.select("node_key", "name", "layer", "node_type"), "node_key")
    # the start comes first among those that expose a target, then the order of impact
    own = nodes.sparkSession.range(1).select(F.lit(start).alias("from_node_key"), F.lit("(changed)").alias("label"), F.lit(-1e9).alias("minus"), F.lit(0).alias("depth"), F.expr("array('')").alias("ord"))
    exposers = own.unionByName(top.select(F.col("node_key").alias("from_node_key"), F.col("node_key").alias("label"), (-F.col("score")).alias("minus"), "depth", "ord"))
    offered = some("from_node_key", exposers.select(F.col("from_node_key").alias("_at"))) if some and top_k <= SMALL_FRONTIER else edges
    surface = narrow(offered.where(shown & F.col("active"))).join(F.broadcast(exposers) if top_k <= SMALL_FRONTIER else exposers, "from_node_key").groupBy(F.col("to_node_key").alias("target_key"), "edge_type").agg(F.min_by("label", F.struct("minus", "depth", "ord", "from_node_key")).alias("exposed_by"))
    surface = surface.withColumn("kind", F.when(F.col("edge_type") == "EXPOSES_ENDPOINT", "endpoint").otherwise("topic")).drop("edge_type")
    return Impact(named.drop("ord"), surface, reached)
