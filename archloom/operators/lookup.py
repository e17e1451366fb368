"""Point lookups and filtered lists over the graph's tables. Filters are plain predicates, so they reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.operators.mutate import is_open


def _where(frame: DataFrame, **wanted: object) -> DataFrame:
    """Rows with all the given values; None and '' ask for nothing."""
    for column, value in wanted.items():
        if value is not None and value != "":
            frame = frame.where(F.col(column) == value)
    return frame


def _newest(frame: DataFrame, *numbers: str) -> DataFrame:
    return frame.orderBy(*(F.desc(n) for n in numbers)).limit(1)


# --- nodes, edges, evidence ------------------------------------------------------------------------------------------
def node_by_key(nodes: DataFrame, key: str) -> DataFrame:
    """The open version of a node, the newest if there are several; no row for an unknown key."""
    return _newest(nodes.where((F.col("node_key") == key) & is_open()), "node_id")


def node_by_id(nodes: DataFrame, number: int) -> DataFrame:
    """A version of a node, open or closed."""
    return nodes.where(F.col("node_id") == number)


def node_id_by_key(nodes: DataFrame, key: str) -> int:
    """The number of the open version; LookupError if there is none."""
    if row := node_by_key(nodes, key).select("node_id").head():
        return row[0]
    raise LookupError(f"node not found: {key}")


def edge_by_key(edges: DataFrame, key: str) -> DataFrame:
    return _newest(edges.where((F.col("edge_key") == key) & is_open()), "edge_id")


def nodes_where(nodes: DataFrame, layer: str = "", node_type: str = "", domain: str = "", repo: str = "", status: str = "") -> DataFrame:
    """Open nodes with all the given values, by key."""
    return _where(nodes.where(is_open()), layer=layer, node_type=node_type, domain_key=domain, repo_name=repo, status=status).orderBy("node_key")


def edges_where(edges: DataFrame, source: str = "", target: str = "", edge_type: str = "", derivation: str = "", active: bool | None = None) -> DataFrame:
    """Open edges with all the given values, by key."""
    return _where(edges.where(is_open()), from_node_key=source, to_node_key=target, edge_type=edge_type, derivation_kind=derivation, active=active).orderBy("edge_key")


def evidence_of(evidence: DataFrame, kind: str, key: str) -> DataFrame:
    """All versions of the evidence of a node or an edge, in the order of their numbers."""
    return _where(evidence, target_kind=kind, target_key=key).orderBy("evidence_id")


# --- revisions, snapshots, contexts ----------------------------------------------------------------------------------
def revision_by_id(revisions: DataFrame, number: int) -> DataFrame:
    return revisions.where(F.col("revision_id") == number)


def latest_revision(revisions: DataFrame, domain: str) -> DataFrame:
    return _newest(_where(revisions, domain_key=domain), "revision_id")


def snapshot_by_id(snapshots: DataFrame, number: int) -> DataFrame:
    return snapshots.where(F.col("snapshot_id") == number)


def latest_snapshot(snapshots: DataFrame, domain: str) -> DataFrame:
    return _newest(_where(snapshots, domain_key=domain), "created_at", "snapshot_id")


def context_by_id(contexts: DataFrame, number: int) -> DataFrame:
    return contexts.where(F.col("context_id") == number)


def context_by_ref(contexts: DataFrame, domain: str, ref: str) -> DataFrame:
    """The active context of a domain and a git ref."""
    return contexts.where((F.col("domain_key") == domain) & (F.col("git_ref") == ref) & (F.col("status") == "active"))


def contexts_of(contexts: DataFrame, domain: str) -> DataFrame:
    return _where(contexts, domain_key=domain).orderBy("context_id")


def changes(changelog: DataFrame, context: int, entity_key: str = "", first: int = 0, last: int = 0) -> DataFrame:
    """Changes of a context, of one entity if given, from revision first to last (0: no bound), in the order of their numbers."""
    rows = _where(changelog.where(F.col("context_id") == context), entity_key=entity_key)
    rows = rows.where(F.col("revision_id") >= first) if first > 0 else rows
    rows = rows.where(F.col("revision_id") <= last) if last > 0 else rows
    return rows.orderBy("change_id")


# --- names, terms, findings ------------------------------------------------------------------------------------------
def aliases_of(aliases: DataFrame, node_key: str) -> DataFrame:
    return aliases.where(F.col("node_key") == node_key).orderBy("alias_kind", "normalized_alias")


def aliases_named(aliases: DataFrame, alias: str, kind: str) -> DataFrame:
    """Aliases that are equal but for case and outer blanks."""
    return aliases.where((F.col("normalized_alias") == alias.strip().lower()) & (F.col("alias_kind") == kind))


def terms(glossary: DataFrame, domain: str = "") -> DataFrame:
    return _where(glossary, domain_key=domain).orderBy("context", "term")


def discoveries(found: DataFrame, domain: str = "", category: str = "") -> DataFrame:
    """Newest first."""
    return _where(found, domain_key=domain, category=category).orderBy(F.desc("created_at"), F.desc("discovery_id"))


# --- requests, settings ----------------------------------------------------------------------------------------------
def request_page(requests: DataFrame, size: int = 100, offset: int = 0) -> DataFrame:
    """Newest first; a size of 0 or less stands for 100."""
    return requests.orderBy(F.desc("request_id")).offset(max(offset, 0)).limit(size if size > 0 else 100)


def requests_since(requests: DataFrame, number: int) -> DataFrame:
    return requests.where(F.col("request_id") > number).orderBy("request_id")


def setting(settings: DataFrame, key: str) -> str:
    """The value of a key, '' where there is none."""
    row = settings.where(F.col("key") == key).select("value").head()
    return row[0] or "" if row else ""


def diagram(sessions: DataFrame, number: str) -> DataFrame:
    return sessions.where(F.col("session_id") == number)


def diagrams(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy("session_id")


def git_state(scanned: Column, head: Column, commits_behind: Column) -> Column:
    """unknown without a scanned commit, fresh at the head, else stale (also where the commit isn't in the history); null
    without a head, as there is no repository then. commits_behind: null if the commit isn't in the history."""
    lost = F.when(commits_behind.isNull(), "stale, commit not found").otherwise("stale")
    return F.when(F.coalesce(scanned, F.lit("")) == "", "unknown").when(F.coalesce(head, F.lit("")) == "", F.lit(None)).when(scanned == head, "fresh").otherwise(lost)


def listed(text: Column) -> Column:
    """The parts of a comma list without outer blanks, empty ones left out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def cut_short(text: Column, most: int = 80) -> Column:
    """The text, or its first characters and an ellipsis where it is longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def stamp(clock: Column | None = None, millis: bool = False) -> Column:
    """A moment as ISO 8601 in UTC, to the second or the millisecond; now unless a clock is given."""
    return F.date_format(F.coalesce(clock, F.current_timestamp()) if clock is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss" + (".SSS" if millis else "") + "'Z'")
