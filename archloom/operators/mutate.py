"""Changes to versioned tables: each function takes tables and returns the tables afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What makes two evidence rows the same.
IDENTITY = ("target_kind", "target_key", "source_kind", "repo_name", "file_path", "line_start", "extractor_id", "polarity")


def is_open() -> Column:
    return F.coalesce("valid_to", F.lit(0)) == 0


def _like(frame: DataFrame, table: DataFrame) -> DataFrame:
    """frame with the columns of table; null where it has none."""
    have = set(frame.columns)
    return frame.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields))


def _meets(key: str) -> Column:
    """Whether a row's key is the batch's `_key`. Rows meet by a number and keys are compared then (as a range, or they would
    be a key of the join too): a broadcast batch holds each key once, and keys, alike in most letters, aren't sorted."""
    return (F.xxhash64(key) == F.xxhash64("_key")) & F.col(key).between(F.col("_key"), F.col("_key"))


def upsert(table: DataFrame, incoming: DataFrame, key: str, number: str, revision: int = 0, fixed: tuple[str, ...] = (), kept: tuple[str, ...] = ("first_seen",), filled: tuple[str, ...] = ()) -> DataFrame:
    """Insert or change rows by key. revision 0 changes the open row in place, but for the columns in `kept`, and those in
    `filled` only where incoming isn't null; otherwise the open row is closed and a new version inserted. A fixed column that
    differs, from the open row or among equal keys of incoming, is an error. Of equal keys the last by column `position`
    counts, or the greatest row where there is none."""
    names = [c for c in incoming.columns if c != "position"]
    last = F.max_by(F.struct(*names), "position") if "position" in incoming.columns else F.max(F.struct(*names))
    differing = [(F.min(c) != F.max(c)).alias(f"_d_{c}") for c in fixed]
    rows = incoming.groupBy(key).agg(last.alias("_r"), *differing)
    opened = table.where(is_open())
    if fixed:
        within = rows.where(F.greatest(*(F.col(f"_d_{c}").cast("int") for c in fixed), F.lit(0)) == 1).select(key)
        other = rows.select(key, *(F.col(f"_r.{c}").alias(f"_{c}") for c in fixed))
        differs = [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in fixed]
        against = opened.join(other, key).where(F.greatest(*(d.cast("int") for d in differs), F.lit(0)) == 1).select(key)
        if wrong := within.unionAll(against).orderBy(key).head():
            raise ValueError(f"{', '.join(fixed)} of {wrong[0]} cannot change")
    rows = rows.select("_r.*")
    top = table.agg(F.coalesce(F.max(number), F.lit(0))).scalar()
    fresh = rows if revision else rows.join(opened.select(key), key, "left_anti")
    fresh = fresh.withColumn("valid_from", F.lit(revision or None).cast("long")).withColumn("valid_to", F.lit(None).cast("long"))
    fresh = fresh.withColumn(number, top + 1 + F.monotonically_increasing_id())
    if revision:
        touched = rows.select(F.col(key).alias("_key")).withColumn("_hit", F.lit(True))
        closed = table.join(touched, _meets(key), "left")
        after = closed.withColumn("valid_to", F.when(F.col("_hit") & is_open(), F.lit(revision).cast("long")).otherwise(F.col("valid_to"))).select(table.columns)
    else:
        mutable = [c for c in rows.columns if c in table.columns and c not in (key, number, "valid_from", "valid_to", *kept, *fixed)]
        new = rows.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in mutable), F.lit(True).alias("_hit"))
        joined = table.join(new, _meets(key) & is_open(), "left")
        value = lambda c: F.coalesce(f"_{c}", c) if c in filled else F.col(f"_{c}")
        after = joined.withColumns({c: F.when(F.col("_hit"), value(c)).otherwise(F.col(c)) for c in mutable}).select(table.columns)
    return after.unionByName(_like(fresh, table))


def soft_delete(table: DataFrame, key: str, value: str, changed: dict[str, Column]) -> DataFrame:
    """Change all versions of a key; a key without rows is an error."""
    if table.where(F.col(key) == value).isEmpty():
        raise LookupError(f"not found: {value}")
    return table.withColumns({c: F.when(F.col(key) == value, v).otherwise(F.col(c)) for c, v in changed.items()})


def mark_stale_nodes(nodes: DataFrame, domain: str, revision: int) -> DataFrame:
    old = (F.col("status") == "active") & (F.col("last_seen") < revision) & (F.col("domain_key") == domain)
    return nodes.withColumn("status", F.when(old, "stale").otherwise(F.col("status")))


def changed_rows(before: DataFrame, after: DataFrame, key: str, column: str) -> int:
    """In how many rows of `after` the column isn't what the row of that key had before."""
    old = before.select(F.col(key).alias("_key"), F.col(column).alias("_old"))
    return after.join(old, F.col(key) == F.col("_key")).where(~F.col(column).eqNullSafe(F.col("_old"))).count()


def mark_stale_edges(edges: DataFrame, nodes: DataFrame, domain: str, revision: int) -> DataFrame:
    inside = nodes.where(F.col("domain_key") == domain).select(F.col("node_key").alias("from_node_key")).distinct().withColumn("_in", F.lit(True))
    old = F.col("active") & (F.col("last_seen") < revision) & F.coalesce("_in", F.lit(False))
    return edges.join(inside, "from_node_key", "left").withColumn("active", F.when(old, F.lit(False)).otherwise(F.col("active"))).select(edges.columns)


def upsert_evidence(evidence: DataFrame, incoming: DataFrame, revision: int = 0) -> DataFrame:
    """Seen again, stale evidence is revalidated (valid if it comes twice in the batch) and any other valid; new evidence
    is inserted as valid. The last of equal rows (column `position`) gives confidence, commit and extractor version."""
    given = incoming.withColumn("polarity", F.coalesce("polarity", F.lit("positive")))
    facts = ("confidence", "commit_sha", "extractor_version")
    # rows are sorted by a number first, as identities are alike in most of their letters
    last = given.groupBy(F.xxhash64(*IDENTITY).alias("_hash"), *IDENTITY).agg(F.count("*").alias("_n"), F.max_by(F.struct(*given.drop(*IDENTITY).columns), "position").alias("_last"))
    new = last.select("_hash", F.struct(*IDENTITY).alias("_same"), "_n", "_last")
    # closed rows are nobody's: their number is null
    there = evidence.withColumns({"_there": F.lit(True), "_of": F.when(is_open(), F.xxhash64(*IDENTITY))})
    both = there.join(new, (F.col("_of") == F.col("_hash")) & (F.struct(*IDENTITY) == F.col("_same")), "full")
    hit, revised, top = F.col("_n").isNotNull(), F.lit(revision).cast("long"), evidence.agg(F.coalesce(F.max("evidence_id"), F.lit(0))).scalar()
    status = F.when(hit & (F.col("status") == "stale") & (F.col("_n") == 1), "revalidated").when(hit, "valid").otherwise(F.col("status"))
    changed = {c: F.when(hit, F.col(f"_last.{c}")).otherwise(F.col(c)) for c in facts} | {"status": status, "last_verified": F.when(hit, revised).otherwise(F.col("last_verified"))}
    fresh = {c: F.col(f"_same.{c}") for c in IDENTITY} | {"valid_from": revised, "evidence_id": top + 1 + F.monotonically_increasing_id()}
    fresh |= {c: F.col(f"_last.{c}") for c in given.columns if c in evidence.columns and c not in (*IDENTITY, *facts, "status", "last_verified", "evidence_id", "valid_from", "valid_to")}
    row = lambda f: changed.get(f.name, F.when(F.col("_there"), F.col(f.name)).otherwise(fresh[f.name]) if f.name in fresh else F.col(f.name))
    return both.select(*(row(f).cast(f.dataType).alias(f.name) for f in evidence.schema.fields))


def invalidate(evidence: DataFrame, files: DataFrame, revision: int = 0, repo: str | None = None) -> DataFrame:
    """Evidence in the changed files (file_path) goes stale. With a revision, the open rows are closed and stale copies
    inserted; else they change in place. All repositories are hit unless one is given."""
    changed = files.select("file_path").where("file_path is not null").distinct().withColumn("_hit", F.lit(True))
    joined = evidence.join(changed, "file_path", "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("status").isin("valid", "revalidated")
    if repo is not None:
        hit = hit & (F.col("repo_name") == repo)
    if not revision:
        return joined.withColumn("status", F.when(hit, "stale").otherwise(F.col("status"))).select(evidence.columns)
    hit = hit & is_open()
    closed = joined.withColumn("valid_to", F.when(hit, F.lit(revision).cast("long")).otherwise(F.col("valid_to"))).select(evidence.columns)
    copies = joined.where(hit).withColumns({"status": F.lit("stale"), "valid_from": F.lit(revision).cast("long"), "valid_to": F.lit(None).cast("long")})
    top = evidence.agg(F.coalesce(F.max("evidence_id"), F.lit(0))).scalar()
    copies = copies.withColumn("evidence_id", top + 1 + F.col("evidence_id"))
    return closed.unionByName(copies.select(evidence.columns))


def invalidated_targets(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Targets that have a stale row in the files, whenever it went stale."""
    return evidence.where("status = 'stale'").join(files.select("file_path").distinct(), "file_path", "left_semi").select("target_kind", "target_key").distinct()


def stale_files(evidence: DataFrame) -> DataFrame:
    return evidence.where("status = 'stale' and file_path <> ''").select("file_path").distinct()


def status_counts(evidence: DataFrame) -> DataFrame:
    """How many rows are revalidated, stale, and invalidated (told as contradicted)."""
    named = F.when(F.col("status") == "invalidated", "contradicted").otherwise(F.col("status"))
    return evidence.groupBy(named.alias("status")).agg(F.count("*").alias("n")).where("status in ('revalidated', 'stale', 'contradicted')")
