"""Revisions, branch contexts and views of the past."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible_revisions(revisions: DataFrame, contexts: DataFrame, context_id: int, as_of: int = 0) -> DataFrame:
    """revision_id of what a context sees: its own (up to as_of), and of its base those up to the branch point; the base's
    base isn't seen, and as_of doesn't cut the base."""
    own = revisions.where(F.col("context_id") == context_id)
    own = own.where(F.col("revision_id") <= as_of) if as_of > 0 else own
    base = contexts.where(F.col("context_id") == context_id).where("coalesce(base_context_id, 0) > 0").select(F.col("base_context_id").alias("_base"), F.col("base_revision_id").alias("_upto"))
    seen = revisions.join(F.broadcast(base), (F.col("context_id") == F.col("_base")) & (F.col("revision_id") <= F.col("_upto")))
    return own.select("revision_id").unionAll(seen.select("revision_id")).distinct()


def as_of_view(versions: DataFrame, visible: DataFrame) -> DataFrame:
    """Versions that began in a visible revision and weren't closed in one."""
    began = versions.join(visible.select(F.col("revision_id").alias("valid_from")), "valid_from", "left_semi")
    return began.join(visible.select(F.col("revision_id").alias("valid_to")), "valid_to", "left_anti").select(versions.columns)


def changelog(versions: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """A row for each change between neighbouring versions of a key: revision, key, created, updated or removed."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("valid_from")
    same = F.lit(True)
    for c in facts:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(order))
    begun = versions.withColumn("change_type", F.when(F.lag("valid_from").over(order).isNull(), "created").when(~same, "updated"))
    ended = versions.withColumn("_next", F.lead("valid_from").over(order)).where("coalesce(valid_to, 0) > 0 and (_next is null or _next > valid_to)")
    new = begun.where("change_type is not null").select(F.col("valid_from").alias("revision_id"), key, "change_type")
    return new.unionAll(ended.select(F.col("valid_to").alias("revision_id"), key, F.lit("removed").alias("change_type")))


def snapshots_with_context(snapshots: DataFrame, revisions: DataFrame, contexts: DataFrame) -> DataFrame:
    joined = snapshots.join(revisions.select("revision_id", "context_id"), "revision_id", "left")
    return joined.join(contexts.select("context_id", F.col("name").alias("context_name")), "context_id", "left")


def latest(frame: DataFrame, by: str, *order: str) -> DataFrame:
    """The greatest row of each group by the order columns."""
    return frame.groupBy(by).agg(F.max_by(F.struct(*frame.columns), F.struct(*order)).alias("_row")).select("_row.*")


def without_snapshot(revisions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Revisions whose domain has no snapshot of them."""
    return revisions.join(snapshots.select("revision_id", "domain_key"), ["revision_id", "domain_key"], "left_anti")
