"""Trust from evidence: one grouped pass, then projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ceilings of confidence by the best kind of source.
CEILINGS = ((0.95, ("user_feedback",)), (0.92, ("runtime", "prisma")), (0.85, ("file", "openapi", "graphql", "asyncapi", "avro", "proto", "schema_registry", "terraform", "k8s", "git", "ci")))
CEILING_OTHER, CONTRADICTED, STALE_CAP = 0.65, 0.8, 0.6


def _live() -> Column:
    return F.col("status").isin("valid", "revalidated")


def combined(polarity: str) -> Column:
    """1 - product of (1 - confidence) over the live rows of a polarity; 0 without any."""
    return F.lit(1.0) - F.coalesce(F.product(F.when((F.col("polarity") == polarity) & _live(), F.lit(1.0) - F.col("confidence"))), F.lit(1.0))


def evidence_summary(evidence: DataFrame, keys: list[str], include_closed: bool = False) -> DataFrame:
    """Per target: n, positive, negative, freshness, ceiling, and which statuses its positive rows have.

    include_closed also counts rows whose version is closed, which are out by default."""
    rows = evidence if include_closed or "valid_to" not in evidence.columns else evidence.where("coalesce(valid_to, 0) = 0")
    positive, stale = F.col("polarity") == "positive", F.col("status") == "stale"
    weight = F.when(positive, F.col("confidence"))
    fresh = F.when(_live(), F.lit(1.0)).when(stale, F.lit(0.5)).otherwise(F.lit(0.0))
    tier = F.when(F.lit(False), F.lit(0.0))
    for ceiling, kinds in CEILINGS:
        tier = tier.when(F.col("source_kind").isin(*kinds), F.lit(ceiling))
    grouped = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        combined("positive").alias("positive"),
        combined("negative").alias("negative"),
        F.sum(weight * fresh).alias("_fresh"),
        F.sum(weight).alias("_weight"),
        F.max((positive & stale).cast("int")).alias("any_stale"),
        F.max((positive & _live()).cast("int")).alias("any_live"),
        F.max(F.when(positive & _live(), tier.otherwise(F.lit(CEILING_OTHER)))).alias("_tier"),
    )
    mean = F.when(F.col("_weight") > 0, F.col("_fresh") / F.col("_weight")).otherwise(F.lit(0.0))
    mean = F.when(F.col("any_stale") == 1, F.least(mean, F.lit(STALE_CAP))).otherwise(mean)
    return grouped.withColumn("freshness", mean).withColumn("ceiling", F.coalesce("_tier", F.lit(CEILING_OTHER))).drop("_fresh", "_weight", "_tier")


def trust(evidence: DataFrame, keys: list[str], include_closed: bool = False) -> DataFrame:
    """Per target: n, positive, negative, confidence, freshness, trust_score, status."""
    s = evidence_summary(evidence, keys, include_closed)
    against = F.col("negative") >= CONTRADICTED
    s = s.withColumn("freshness", F.when(against, F.lit(0.0)).otherwise(F.col("freshness")))
    s = s.withColumn("confidence", F.least(F.col("positive") * (F.lit(1.0) - F.col("negative")), F.col("ceiling")))
    status = F.when(against, "contradicted").when(F.col("any_live") == 1, "active").when(F.col("any_stale") == 1, "stale").otherwise("removed")
    return s.select(*keys, "n", "positive", "negative", "confidence", "freshness", "ceiling", (F.col("confidence") * F.col("freshness")).alias("trust_score"), status.alias("status"))


def _joined(rows: DataFrame, trusted: DataFrame, key: str) -> tuple[DataFrame, dict[str, Column]]:
    """rows with the trust of their key beside them, closed versions without, and the numbers afterwards."""
    facts = ("confidence", "freshness", "trust_score")
    t = trusted.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in (*facts, "status")))
    same = F.col(key) == F.col("_key")
    if "valid_to" in rows.columns:
        same = same & (F.coalesce("valid_to", F.lit(0)) == 0)
    return rows.join(t, same, "left"), {c: F.coalesce(f"_{c}", c) for c in facts}


def apply_to_edges(edges: DataFrame, trusted: DataFrame) -> DataFrame:
    """Write trust back to open rows: an edge is active unless removed or contradicted. Edges without evidence and closed
    versions stay as they are."""
    joined, new = _joined(edges, trusted, "edge_key")
    new["active"] = F.when(F.col("_status").isNull(), F.col("active")).otherwise(~F.col("_status").isin("removed", "contradicted"))
    return joined.withColumns(new).select(edges.columns)


def apply_to_nodes(nodes: DataFrame, trusted: DataFrame) -> DataFrame:
    """Write trust back to open rows: contradicted and removed nodes are deleted, others take the status."""
    joined, new = _joined(nodes, trusted, "node_key")
    new["status"] = F.when(F.col("_status").isin("removed", "contradicted"), "deleted").otherwise(F.coalesce("_status", "status"))
    return joined.withColumns(new).select(nodes.columns)


def status_of(targets: DataFrame, trusted: DataFrame, key: str) -> DataFrame:
    """targets with the status of each: unknown for those that no evidence tells of."""
    known = trusted.select(key, F.col("status").alias("trust_status"))
    return targets.join(known, key, "left").withColumn("trust_status", F.coalesce("trust_status", F.lit("unknown")))
