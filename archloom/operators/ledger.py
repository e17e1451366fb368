"""Rows that are added to, replaced in and removed from the small tables beside the graph, and the backfill of contexts.

Each function takes tables and returns the table afterwards. Numbers are unique and grow; those of one batch have gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archloom.operators.mutate import _like


class Taken(ValueError):
    """A row with these values is there already."""


def append(table: DataFrame, rows: DataFrame, number: str = "", unique: tuple[str, ...] = ()) -> DataFrame:
    """Add rows, numbered from the greatest number on. Values of unique columns that are there, or twice in rows, are an error."""
    if unique:
        given = rows.groupBy(*unique).agg(F.count("*").alias("_n"))
        there = table.select(*unique).join(given.select(*unique), list(unique), "left_semi")
        if again := given.where("_n > 1").select(*unique).unionAll(there).head():
            raise Taken(", ".join(f"{k} {v}" for k, v in again.asDict().items()))
    if number:
        top = table.agg(F.coalesce(F.max(number), F.lit(0))).scalar()
        rows = rows.withColumn(number, (top + 1 + F.monotonically_increasing_id()).cast("long"))
    return table.unionByName(_like(rows, table))


def put(table: DataFrame, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Replace the rows of equal keys, add the others. Of rows with equal keys the greatest counts."""
    one = rows.groupBy(*keys).agg(F.max(F.struct(*rows.columns)).alias("_r")).select("_r.*")
    return table.join(one.select(*keys), list(keys), "left_anti").select(table.columns).unionByName(_like(one, table))


def without(table: DataFrame, **values: object) -> DataFrame:
    """The rows that differ in one of the values at least."""
    same = F.lit(True)
    for column, value in values.items():
        same = same & F.col(column).eqNullSafe(F.lit(value))
    return table.where(~same)


def changed(table: DataFrame, key: str, value: object, **new: object) -> DataFrame:
    """Set columns of the rows with a key; LookupError if there are none."""
    if table.where(F.col(key) == value).isEmpty():
        raise LookupError(f"{key} {value} not found")
    kinds = dict(table.dtypes)
    return table.withColumns({c: F.when(F.col(key) == value, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in new.items()})


def aliases_added(aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: node_key, alias, alias_kind, confidence. Aliases are compared without case and outer blanks; a confidence of 0 or
    less stands for 0.8. A blank alias or kind and one that is there already are errors."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    if not rows.where(blank("alias") | blank("alias_kind")).isEmpty():
        raise ValueError("alias and alias_kind are required")
    sure = F.when(F.coalesce("confidence", F.lit(0.0)) <= 0, F.lit(0.8)).otherwise(F.col("confidence"))
    named = rows.select("node_key", "alias", F.lower(F.trim("alias")).alias("normalized_alias"), "alias_kind", sure.alias("confidence"))
    return append(aliases, named, unique=("node_key", "normalized_alias", "alias_kind"))


def terms_put(glossary: DataFrame, rows: DataFrame) -> DataFrame:
    return put(glossary, rows, ("domain_key", "term"))


def anti_pattern_dropped(glossary: DataFrame, domain: str, term: str, anti_pattern: str) -> DataFrame:
    """The term without the anti-pattern, in any case of letters; LookupError for an unknown term."""
    own = (F.col("domain_key") == domain) & (F.col("term") == term)
    if glossary.where(own).isEmpty():
        raise LookupError(f"term {term} not found")
    left = F.filter("anti_patterns", lambda a: F.lower(a) != anti_pattern.lower())
    return glossary.withColumn("anti_patterns", F.when(own, left).otherwise(F.col("anti_patterns")))


def discoveries_added(found: DataFrame, rows: DataFrame, clock: str | None = None) -> DataFrame:
    """rows: domain_key, category, severity, title, description, confidence, and action if there is one. The severity (insight
    where none is given) and the action are written into the description as well."""
    severity = F.when(F.coalesce("severity", F.lit("")) == "", "insight").otherwise(F.col("severity"))
    action = F.coalesce("action", F.lit("")) if "action" in rows.columns else F.lit("")
    told = F.concat(F.when(severity != "insight", F.concat(F.lit("["), severity, F.lit("] "))).otherwise(""), F.coalesce("description", F.lit("")), F.when(action != "", F.concat(F.lit(" → Action: "), action)).otherwise(""))
    now = F.lit(clock).cast("timestamp") if clock else F.current_timestamp()
    return append(found, rows.withColumns({"description": told, "severity": severity, "applied": F.lit(False), "created_at": now}), "discovery_id")


def backfilled(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A main context for each domain that has revisions but no context, and its number on revisions, nodes, edges and evidence
    that have none; nodes and edges are valid from when they were first seen, and edges get the keys of their ends if they
    lack them. Given its own result it changes nothing."""
    t = dict(tables)
    latest = t["revisions"].groupBy("domain_key").agg(F.max_by(F.struct("revision_id", "git_after_sha"), "revision_id").alias("_head"))
    lacking = latest.join(t["contexts"].select("domain_key"), "domain_key", "left_anti")
    new = lacking.select("domain_key", F.lit("main").alias("name"), F.lit("main").alias("git_ref"), F.lit("active").alias("status"), F.col("_head.revision_id").alias("head_revision_id"), F.col("_head.git_after_sha").alias("head_commit_sha"))
    top = t["contexts"].agg(F.coalesce(F.max("context_id"), F.lit(0))).scalar()
    order = F.row_number().over(Window.orderBy("domain_key"))  # domains are few
    new = new.withColumn("context_id", (order + top).cast("long"))
    own = new.select("domain_key", F.col("context_id").alias("_new"))
    lacks = F.col("context_id").isNull() & F.col("_new").isNotNull()
    given = F.when(lacks, F.col("_new")).otherwise(F.col("context_id"))
    begun = F.when(lacks, F.col("first_seen")).otherwise(F.col("valid_from"))

    def filled(frame: DataFrame, homes: DataFrame, on: list[str], columns: dict) -> DataFrame:
        return frame.join(homes, on, "left").withColumns(columns).select(frame.columns)

    names = t["nodes"].select("node_id", "node_key").dropDuplicates(["node_id"])
    for side in ("from", "to"):
        if f"{side}_node_id" in t["edges"].columns:
            named = names.select(F.col("node_id").alias(f"{side}_node_id"), F.col("node_key").alias("_name"))
            t["edges"] = filled(t["edges"], named, [f"{side}_node_id"], {f"{side}_node_key": F.coalesce(f"{side}_node_key", "_name")})
    of_node = t["nodes"].select("node_key", "domain_key").distinct().join(own, "domain_key").groupBy("node_key").agg(F.min("_new").alias("_new"))
    of_edge = t["edges"].select("edge_key", F.col("from_node_key").alias("node_key")).distinct().join(of_node, "node_key").groupBy("edge_key").agg(F.min("_new").alias("_new"))
    of_target = of_node.select(F.lit("node").alias("target_kind"), F.col("node_key").alias("target_key"), "_new").unionAll(of_edge.select(F.lit("edge"), "edge_key", "_new"))
    t["evidence"] = filled(t["evidence"], of_target, ["target_kind", "target_key"], {"context_id": given})
    t["edges"] = filled(t["edges"], of_edge, ["edge_key"], {"valid_from": begun, "context_id": given})
    t["nodes"] = filled(t["nodes"], own, ["domain_key"], {"valid_from": begun, "context_id": given})
    t["revisions"] = filled(t["revisions"], own, ["domain_key"], {"context_id": given})
    t["contexts"] = t["contexts"].unionByName(_like(new, t["contexts"]))
    return t
