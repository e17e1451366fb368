"""Set-wise validation: a column with the first rule that a row breaks, null for valid rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.functions.keys import build_edge_key, edge_key, node_key
from archloom.sources.registry import Registry


def blank(name: str) -> Column:
    return F.coalesce(F.trim(name), F.lit("")) == ""


def _first(*rules: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(what)) for broken, what in rules))


def nodes(rows: DataFrame, registry: Registry) -> DataFrame:
    """With normalised key, defaults and error."""
    confidence = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("confidence"))
    filled = rows.withColumns({"node_key": F.coalesce(node_key(F.col("node_key")), "node_key"), "_ok": node_key(F.col("node_key")).isNotNull(), "confidence": confidence, "status": F.when(blank("status"), "active").otherwise(F.col("status")), "metadata": F.when(blank("metadata"), "{}").otherwise(F.col("metadata"))})
    pairs = [f"{k}/{t}" for k, v in registry.node_types.items() for t in v]
    error = _first((blank("name"), "name is required"), (blank("domain_key"), "domain is required"), (~F.col("_ok"), "malformed key"), (~F.col("layer").isin(*registry.layers), "unknown layer"), (~F.concat_ws("/", "layer", "node_type").isin(*pairs), "unknown node type"), (~F.col("confidence").between(0, 1), "confidence out of range"), (~F.col("status").isin(*registry.node_statuses), "unknown status"))
    return filled.withColumn("error", error).drop("_ok")


def edges(rows: DataFrame, registry: Registry) -> DataFrame:
    """With derivation, key and error; layers must be a pair that the type allows."""
    kinds = F.when(blank("derivation_kind"), "hard").otherwise(F.col("derivation_kind"))
    built = build_edge_key(F.col("from_node_key"), F.col("to_node_key"), F.col("edge_type"))
    key = F.when(blank("edge_key"), built).otherwise(edge_key(F.col("edge_key")))
    confidence = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("confidence"))
    filled = rows.withColumns({"derivation_kind": kinds, "edge_key": key, "confidence": confidence, "metadata": F.when(blank("metadata"), "{}").otherwise(F.col("metadata"))})
    allowed = F.broadcast(registry.allowed_pairs(rows.sparkSession).withColumn("_ok", F.lit(True)))
    joined = filled.join(allowed, ["edge_type", "from_layer", "to_layer"], "left")
    error = _first((blank("from_node_key"), "from is required"), (blank("to_node_key"), "to is required"), (blank("edge_type"), "type is required"), (~F.col("edge_type").isin(*registry.edge_types), "unknown edge type"), (~F.col("derivation_kind").isin(*registry.derivation_kinds), "unknown derivation"), (F.col("_ok").isNull(), "layers not allowed"), (~F.col("confidence").between(0, 1), "confidence out of range"), (F.col("edge_key").isNull(), "malformed key"))
    return joined.withColumn("error", error).select(*filled.columns, "error")


def evidence(rows: DataFrame, registry: Registry) -> DataFrame:
    error = _first((~F.col("target_kind").isin("node", "edge"), "unknown target kind"), (~F.col("source_kind").isin(*registry.source_kinds), "unknown source kind"), (blank("extractor_id"), "extractor is required"), (blank("extractor_version"), "extractor version is required"), (~F.coalesce("confidence", F.lit(0.0)).between(0, 1), "confidence out of range"))
    return rows.withColumn("error", error)


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Issues in stored rows: key shape and confidence range."""
    wrong = ~F.coalesce("confidence", F.lit(0.0)).between(0, 1)
    n = nodes.select(F.lit("node").alias("kind"), F.col("node_key").alias("key"), F.when(F.size(F.split("node_key", ":")) < 4, "malformed key").when(wrong, "confidence out of range").alias("issue"))
    e = edges.select(F.lit("edge").alias("kind"), F.col("edge_key").alias("key"), F.when(~F.col("edge_key").contains("->"), "malformed key").when(wrong, "confidence out of range").alias("issue"))
    return n.unionAll(e).where("issue is not null")


def integrity_strict(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Issues by full normalisation of both kinds of key, and node confidence."""
    n = nodes.select(F.lit("node").alias("kind"), F.col("node_key").alias("key"), F.when(node_key(F.col("node_key")).isNull(), "malformed key").when(~F.col("confidence").between(0, 1), "confidence out of range").alias("issue"))
    e = edges.select(F.lit("edge").alias("kind"), F.col("edge_key").alias("key"), F.when(edge_key(F.col("edge_key")).isNull(), "malformed key").alias("issue"))
    return n.unionAll(e).where("issue is not null")
