"""A graph in Parquet: a folder for each state, and a pointer file that names the current one.

A commit writes the changed tables to a new folder and then replaces the pointer, so that readers see all of it or none. A
change holds a lock file from its first reading to its commit; a second writer is refused meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from archloom.functions.scores import base_confidence
from archloom.operators import insight, ledger, lookup, mutate, temporal, trust, validate
from archloom.schema import TABLES
from archloom.session import cut
from archloom.sources.registry import Registry


class Busy(RuntimeError):
    """Another writer changes the graph."""


class ImportFailed(ValueError):
    """A payload that breaks a rule; nothing was written."""


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, registry: Registry | None = None):
        self.spark, self.path, self.registry = spark, path.rstrip("/"), registry or Registry.load()
        jvm = spark.sparkContext._jvm
        self._pointer = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        self._fs = self._pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _state(self) -> dict[str, str]:
        if not self._fs.exists(self._pointer):
            return {}
        return json.loads(self.spark.read.text(str(self._pointer)).first()[0])

    def table(self, name: str) -> DataFrame:
        where = self._state().get(name)
        return self.spark.read.schema(TABLES[name]).parquet(where) if where else self.spark.createDataFrame([], TABLES[name])

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Write the tables and make them current together."""
        folder, state = f"{self.path}/{uuid.uuid4().hex}", self._state()
        for name, frame in tables.items():
            frame.write.parquet(f"{folder}/{name}")
            state[name] = f"{folder}/{name}"
        new = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/pointer")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._pointer.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, self._pointer, options)

    @contextmanager
    def _change(self) -> Iterator[None]:
        """Keeps other writers out until the end. A lock that a lost writer left is removed by hand (LOCK in the folder)."""
        lock = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/LOCK")
        try:
            self._fs.create(lock, False).close()
        except Py4JJavaError as e:
            raise Busy(f"{self.path} is locked") from e
        try:
            yield
        finally:
            self._fs.delete(lock, False)

    def reset(self) -> None:
        """Drop everything but the diagram sessions."""
        with self._change():
            state = {k: v for k, v in self._state().items() if k == "diagram_sessions"}
            self.commit({n: self.spark.createDataFrame([], TABLES[n]) for n in TABLES if n not in state})

    def backfill(self) -> None:
        """Give domains without a context their main one (see ledger.backfilled)."""
        names = ("revisions", "contexts", "nodes", "edges", "evidence")
        with self._change():
            self.commit(ledger.backfilled({n: self.table(n) for n in names}))

    # --- rows of the graph -------------------------------------------------------------------------------------------
    def _refuse(self, rows: DataFrame, what: str) -> None:
        if bad := rows.where("error is not null").orderBy("position").select("position", "error").head():
            raise ImportFailed(f"{what}[{bad[0]}]: {bad[1]}")

    def _checked(self, rows: DataFrame, what: str) -> DataFrame:
        """Validated rows, written once, as several steps read them; the first bad one is an error."""
        void = [f.name for f in rows.schema.fields if f.dataType == NullType()]  # Parquet has no such type
        checked = cut(rows.withColumns({c: F.col(c).cast("string") for c in void}))
        self._refuse(checked, what)
        return checked

    def _nodes_after(self, rows: DataFrame, revision: int, version: int, context: int | None) -> DataFrame:
        checked = self._checked(validate.nodes(rows, self.registry), "nodes")
        seen = F.lit(revision).cast("long")
        new = checked.drop("error").withColumns({"freshness": F.lit(0.0), "trust_score": F.lit(0.0), "first_seen": seen, "last_seen": seen, "context_id": F.lit(context).cast("long")})
        return cut(mutate.upsert(self.table("nodes"), new, "node_key", "node_id", version, fixed=("layer", "node_type", "domain_key"), kept=("first_seen", "context_id")))

    def _edges_after(self, nodes: DataFrame, rows: DataFrame, revision: int, version: int, context: int | None) -> DataFrame:
        checked = self._checked(validate.edges(rows, self.registry), "edges")
        known = nodes.where(mutate.is_open()).select("node_key").distinct()
        for side in ("from", "to"):
            lost = checked.join(known.withColumnRenamed("node_key", f"{side}_node_key"), f"{side}_node_key", "left_anti")
            self._refuse(lost.withColumn("error", F.concat(F.lit(f"{side} node not found: "), f"{side}_node_key")), "edges")
        base, seen = base_confidence(F.col("derivation_kind")), F.lit(revision).cast("long")
        new = checked.drop("error", "from_layer", "to_layer").withColumns({"confidence": base, "trust_score": base, "freshness": F.lit(1.0), "active": F.lit(True), "first_seen": seen, "last_seen": seen, "context_id": F.lit(context).cast("long")})
        return cut(mutate.upsert(self.table("edges"), new, "edge_key", "edge_id", version, kept=("first_seen", "context_id"), filled=("from_node_key", "to_node_key")))

    def _evidence_after(self, nodes: DataFrame, edges: DataFrame, rows: DataFrame, revision: int, strict: bool) -> tuple[dict[str, DataFrame], int]:
        """The tables with the evidence and the trust of its targets, and how many rows were taken."""
        target = F.when(F.col("target_kind") == "node", F.col("node_key")).otherwise(F.col("edge_key"))
        sure = F.when(F.coalesce("confidence", F.lit(0.0)) <= 0, F.lit(0.95)).otherwise(F.col("confidence"))
        checked = validate.evidence(rows, self.registry).withColumns({"target_key": target, "confidence": sure})
        open_keys = lambda t, kind: t.where(mutate.is_open()).select(F.lit(kind).alias("target_kind"), F.col(f"{kind}_key").alias("target_key"))
        there = open_keys(nodes, "node").unionAll(open_keys(edges, "edge"))
        if strict:
            self._refuse(checked, "evidence")
            lost = checked.join(there, ["target_kind", "target_key"], "left_anti")
            self._refuse(lost.withColumn("error", F.concat(F.lit("target not found: "), "target_key")), "evidence")
        taken = cut(checked.where("error is null").drop("error").join(there, ["target_kind", "target_key"], "left_semi"))
        evidence = mutate.upsert_evidence(self.table("evidence"), taken.select("position", "target_kind", "target_key", "source_kind", "repo_name", "file_path", "line_start", "line_end", "extractor_id", "extractor_version", "commit_sha", "confidence", "polarity"), revision)
        evidence = cut(evidence)
        touched = taken.select("target_kind", "target_key").distinct()
        judged = cut(trust.trust(evidence.join(touched, ["target_kind", "target_key"], "left_semi"), ["target_kind", "target_key"]))
        nodes = trust.apply_to_nodes(nodes, judged.where("target_kind = 'node'").withColumnRenamed("target_key", "node_key"))
        edges = trust.apply_to_edges(edges, judged.where("target_kind = 'edge'").withColumnRenamed("target_key", "edge_key"))
        return {"nodes": nodes, "edges": edges, "evidence": evidence}, taken.count()

    def upsert_nodes(self, rows: DataFrame, revision: int = 0, version: int = 0, context: int | None = None) -> None:
        """Validated nodes, rows as in a payload with `position`. version: close open rows and insert new ones as of it."""
        with self._change():
            self.commit({"nodes": self._nodes_after(rows, revision, version, context)})

    def upsert_edges(self, rows: DataFrame, revision: int = 0, version: int = 0, context: int | None = None) -> None:
        """Validated edges between nodes that are there. Their trust is that of their derivation, whatever confidence is given."""
        with self._change():
            self.commit({"edges": self._edges_after(self.table("nodes"), rows, revision, version, context)})

    def add_evidence(self, rows: DataFrame, revision: int = 0) -> None:
        """Validated evidence for targets that are there; their trust is computed again."""
        with self._change():
            self.commit(self._evidence_after(self.table("nodes"), self.table("edges"), rows, revision, True)[0])

    def delete_node(self, key: str) -> None:
        with self._change():
            self.commit({"nodes": mutate.soft_delete(self.table("nodes"), "node_key", key, {"status": F.lit("deleted")})})

    def delete_edge(self, key: str) -> None:
        with self._change():
            self.commit({"edges": mutate.soft_delete(self.table("edges"), "edge_key", key, {"active": F.lit(False)})})

    def mark_stale(self, domain: str, revision: int) -> tuple[int, int]:
        """How many nodes and edges of a domain went stale, as they were last seen before the revision."""
        with self._change():
            nodes, edges = self.table("nodes"), self.table("edges")
            after = {"nodes": cut(mutate.mark_stale_nodes(nodes, domain, revision)), "edges": cut(mutate.mark_stale_edges(edges, nodes, domain, revision))}
            counts = mutate.changed_rows(nodes, after["nodes"], "node_id", "status"), mutate.changed_rows(edges, after["edges"], "edge_id", "active")
            self.commit(after)
        return counts

    def import_payload(self, payload: dict[str, DataFrame], revision: int = 0) -> dict[str, int]:
        """All of a payload or nothing: the first bad node or edge aborts, bad evidence and aliases are skipped. Trust of the
        targets with new evidence is computed once, at the end. Returns how many rows of each kind were taken."""
        with self._change():
            nodes = self._nodes_after(payload["nodes"], revision, 0, None)
            edges = self._edges_after(nodes, payload["edges"], revision, 0, None)
            known = nodes.where(mutate.is_open()).select("node_key").distinct()
            tables, taken = self._evidence_after(nodes, edges, payload["evidence"], revision, False)
            named = payload["aliases"].join(known, "node_key", "left_semi").where(~validate.blank("alias") & ~validate.blank("alias_kind"))
            named = named.select("node_key", "alias", F.lower(F.trim("alias")).alias("normalized_alias"), "alias_kind", F.when(F.coalesce("confidence", F.lit(0.0)) <= 0, F.lit(0.8)).otherwise(F.col("confidence")).alias("confidence"))
            aliases = self.table("aliases").unionByName(named).dropDuplicates(["node_key", "normalized_alias", "alias_kind"])
            counts = {"nodes": payload["nodes"].count(), "edges": payload["edges"].count(), "evidence": taken, "aliases": named.count()}
            self.commit(tables | {"aliases": aliases})
        return counts

    def discover(self, clock: str | None = None) -> DataFrame:
        """Add what the rules find in the graph (see insight.discoveries) to the discoveries, and return it."""
        with self._change():
            nodes, edges = (self.table(n).where(mutate.is_open()) for n in ("nodes", "edges"))
            found = cut(insight.discoveries(nodes, edges, self.table("evidence")).crossJoin(nodes.orderBy("node_key").select("domain_key").limit(1)))  # one row
            told = found.select("domain_key", "category", "severity", F.concat(F.lit("rule "), F.col("rule").cast("string"), F.lit(": "), F.col("n").cast("string")).alias("title"), F.lit("").alias("description"), "confidence")
            self.commit({"discoveries": ledger.discoveries_added(self.table("discoveries"), told, clock)})
        return found

    # --- small tables ------------------------------------------------------------------------------------------------
    def _row(self, name: str, /, **values: object) -> DataFrame:
        """One row with the types of a table."""
        kinds = dict(self.table(name).dtypes)
        return self.spark.range(1).coalesce(1).select(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in values.items()))

    def _append(self, name: str, number: str, unique: tuple[str, ...], /, **values: object) -> int:
        with self._change():
            after = cut(ledger.append(self.table(name), self._row(name, **values), number, unique))
            self.commit({name: after})
            return after.agg(F.max(number)).first()[0]

    def create_revision(self, domain: str, after_sha: str, before_sha: str = "", trigger: str = "manual", mode: str = "full", context: int | None = None) -> int:
        """One for each domain and commit."""
        if trigger not in self.registry.trigger_kinds or mode not in ("full", "incremental"):
            raise ValueError(f"unknown trigger or mode: {trigger}, {mode}")
        return self._append("revisions", "revision_id", ("domain_key", "git_after_sha"), domain_key=domain, git_before_sha=before_sha, git_after_sha=after_sha, trigger_kind=trigger, mode=mode, context_id=context)

    def create_snapshot(self, revision: int, domain: str, kind: str = "full", summary: str = "", clock: str | None = None) -> int:
        """One for each revision and domain."""
        return self._append("snapshots", "snapshot_id", ("revision_id", "domain_key"), revision_id=revision, domain_key=domain, kind=kind, summary=summary or "{}", created_at=clock or F.current_timestamp())

    def create_context(self, domain: str, name: str, ref: str = "", base_context: int | None = None, base_revision: int | None = None) -> int:
        """One for each domain and name."""
        return self._append("contexts", "context_id", ("domain_key", "name"), domain_key=domain, name=name, git_ref=ref or None, base_context_id=base_context, base_revision_id=base_revision, status="active")

    def archive_context(self, number: int) -> None:
        with self._change():
            self.commit({"contexts": ledger.changed(self.table("contexts"), "context_id", number, status="archived")})

    def move_context(self, number: int, revision: int, sha: str) -> None:
        with self._change():
            self.commit({"contexts": ledger.changed(self.table("contexts"), "context_id", number, head_revision_id=revision, head_commit_sha=sha)})

    def log_changes(self, rows: DataFrame) -> None:
        """rows: context_id, revision_id, entity_type, entity_key, change_type."""
        with self._change():
            self.commit({"changelog": ledger.append(self.table("changelog"), rows, "change_id")})

    def log_requests(self, rows: DataFrame) -> None:
        """rows: ts, tool_name, params_json, result_json, error_message, duration_ms."""
        with self._change():
            self.commit({"requests": ledger.append(self.table("requests"), rows, "request_id")})

    def add_aliases(self, rows: DataFrame) -> None:
        with self._change():
            self.commit({"aliases": ledger.aliases_added(self.table("aliases"), rows)})

    def remove_alias(self, node_key: str, alias: str, kind: str) -> None:
        with self._change():
            self.commit({"aliases": ledger.without(self.table("aliases"), node_key=node_key, normalized_alias=alias.strip().lower(), alias_kind=kind)})

    def put_terms(self, rows: DataFrame) -> None:
        with self._change():
            self.commit({"glossary": ledger.terms_put(self.table("glossary"), rows)})

    def delete_term(self, domain: str, term: str) -> None:
        with self._change():
            self.commit({"glossary": ledger.without(self.table("glossary"), domain_key=domain, term=term)})

    def drop_anti_pattern(self, domain: str, term: str, anti_pattern: str) -> None:
        with self._change():
            self.commit({"glossary": ledger.anti_pattern_dropped(self.table("glossary"), domain, term, anti_pattern)})

    def add_discoveries(self, rows: DataFrame, clock: str | None = None) -> None:
        with self._change():
            self.commit({"discoveries": ledger.discoveries_added(self.table("discoveries"), rows, clock)})

    def mark_applied(self, number: int) -> None:
        with self._change():
            self.commit({"discoveries": ledger.changed(self.table("discoveries"), "discovery_id", number, applied=True)})

    def put_setting(self, key: str, value: str) -> None:
        with self._change():
            self.commit({"settings": ledger.put(self.table("settings"), self._row("settings", key=key, value=value), ("key",))})

    def put_diagram(self, number: str, body: str) -> None:
        with self._change():
            self.commit({"diagram_sessions": ledger.put(self.table("diagram_sessions"), self._row("diagram_sessions", session_id=number, body=body), ("session_id",))})

    def scan_status(self, domain: str) -> dict[str, int | str | None]:
        """Counts of a domain's open nodes and edges, its latest revision and snapshot, and the commit of that revision."""
        nodes, edges = (self.table(n).where(mutate.is_open()) for n in ("nodes", "edges"))
        counts = insight.stats(nodes, edges, domain).groupBy("kind").agg(F.sum("n").alias("n")).collect()
        n = {r.kind: r.n for r in counts}
        revision = lookup.latest_revision(self.table("revisions"), domain).head()
        snapshot = temporal.latest(self.table("snapshots").where(F.col("domain_key") == domain), "domain_key", "created_at", "snapshot_id").head()
        return {"nodes": n.get("layer", 0), "edges": n.get("edge_type", 0), "revision_id": revision and revision.revision_id, "commit": revision and revision.git_after_sha, "snapshot_id": snapshot and snapshot.snapshot_id}
