"""Statistics, discovery rules, naming checks and request metrics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Anti-patterns up to which nodes are looked through for all of them at once.
FEW_PATTERNS = 500
#: Errors that a session remembers, and how many numbers later a success still counts as a retry.
REMEMBERED_ERRORS, RETRY_WITHIN = 10, 3


def stats(nodes: DataFrame, edges: DataFrame, domain: str = "") -> DataFrame:
    """kind, name, n: nodes by layer and status, edges (whose source is in the domain, active or not) by type and derivation."""
    inside = nodes.where(F.col("domain_key") == domain) if domain else nodes
    own = edges.join(inside.select(F.col("node_key").alias("from_node_key")), "from_node_key", "left_semi") if domain else edges
    nodes_by = _counts(inside, "layer", "status").where("kind = 'layer' or name in ('active', 'stale')")
    return nodes_by.unionAll(_counts(own, "edge_type", "derivation_kind"))


def _counts(frame: DataFrame, a: str, b: str) -> DataFrame:
    """kind, name, n: rows by one column and by another, in one pass."""
    sets = frame.groupingSets([[F.col(a)], [F.col(b)]], F.col(a), F.col(b)).agg(F.grouping_id().alias("_set"), F.count("*").alias("n"))
    first = F.col("_set") == 1  # b is left out
    return sets.select(F.when(first, F.lit(a)).otherwise(F.lit(b.removesuffix("_kind"))).alias("kind"), F.when(first, F.col(a)).otherwise(F.col(b)).alias("name"), "n")


def name_search(nodes: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Active nodes whose name has the text (any ASCII case; % and _ are wildcards), exact names first, then by key."""
    rank = F.when(F.lower("name") == text.lower(), 0).otherwise(1)
    return nodes.where(F.col("name").ilike(f"%{text}%") & (F.col("status") == "active")).orderBy(rank, "node_key").limit(limit)


def resolve(nodes: DataFrame, text: str) -> str:
    """The key that a key or a name stands for; LookupError if none or several do."""
    if not nodes.where(F.col("node_key") == text).isEmpty():
        return text
    hits = name_search(nodes, text).select("node_key", "name").collect()
    if not hits:
        raise LookupError(f"no node named {text}")
    exact = [h.node_key for h in hits if (h.name or "").lower() == text.lower()]
    if len(hits) == 1 or exact:
        return exact[0] if exact else hits[0].node_key
    raise LookupError(f"ambiguous: {', '.join(h.node_key for h in hits[:5])}")


def low_confidence(edges: DataFrame, nodes: DataFrame, threshold: float = 0.8) -> DataFrame:
    named = lambda p: nodes.select(F.col("node_key").alias(f"{p}_node_key"), F.col("name").alias(f"{p}_name"))
    low = edges.where("active").where(F.col("confidence") < threshold)
    return low.join(named("from"), "from_node_key").join(named("to"), "to_node_key").select("edge_key", "edge_type", "from_name", "to_name", "confidence")


def evidence_by_domain(evidence: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """domain_key, status, n. Evidence of an edge counts for the domain of the node that it starts from; evidence without a
    known target has a null domain."""
    of_edges = evidence.where("target_kind = 'edge'").select(F.col("target_key").alias("edge_key"), "status")
    by_start = told_by_start(of_edges, edges, ["edge_key"], "from_node_key").withColumnRenamed("_start", "node_key")
    return told_by_domain(by_start.unionAll(told_of_nodes(evidence)), nodes)


def told_by_start(evidence: DataFrame, edges: DataFrame, on: list[str], start: str) -> DataFrame:
    """_start, status, n: evidence of edges by the node (column `start` of edges) that its edge starts from, null where there
    is no such edge. `on` tells edges apart, by key or by numbers that stand for it, so that rows may be narrow."""
    counted = evidence.groupBy(*on, "status").agg(F.count("*").alias("n"))
    if dict(edges.dtypes)[start] == "string":  # the least of strings is found by sorting: once only, behind the shuffle
        edges = edges.repartition(*on)
    starts = edges.groupBy(*on).agg(F.min(start).alias("_start"))
    return counted.join(starts, on, "left").groupBy("_start", "status").agg(F.sum("n").alias("n"))


def told_of_nodes(evidence: DataFrame) -> DataFrame:
    """node_key, status, n: evidence that isn't of edges, by the node it tells of."""
    other = evidence.where(~F.col("target_kind").eqNullSafe(F.lit("edge")))
    return other.groupBy(F.when(F.col("target_kind") == "node", F.col("target_key")).alias("node_key"), "status").agg(F.count("*").alias("n"))


def told_by_domain(told: DataFrame, nodes: DataFrame) -> DataFrame:
    """domain_key, status, n of told (node_key, status, n). Nodes are only looked up: none is sorted or grouped that isn't
    told of, and of several with one key the least domain counts."""
    once = told.groupBy("node_key", "status").agg(F.sum("n").alias("n"))
    found = once.join(nodes.select("node_key", "domain_key"), "node_key", "left")
    homes = found.groupBy("node_key", "status").agg(F.min("domain_key").alias("domain_key"), F.max("n").alias("n"))
    return homes.groupBy("domain_key", "status").agg(F.sum("n").alias("n"))


def finalized(counts: DataFrame, domain: str) -> DataFrame:
    """How many rows of a domain's evidence are revalidated, stale, and invalidated (told as contradicted)."""
    named = F.when(F.col("status") == "invalidated", "contradicted").otherwise(F.col("status"))
    return counts.where(F.col("domain_key") == domain).select(named.alias("status"), "n").where("status in ('revalidated', 'stale', 'contradicted')")


def without_evidence(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    told = evidence.where("target_kind = 'node'").select(F.col("target_key").alias("node_key")).distinct()  # few nodes have most rows
    return nodes.where("status = 'active'").join(told, "node_key", "left_anti")


def modules_without_contains(nodes: DataFrame, edges: DataFrame, module: str = "module") -> DataFrame:
    holds = edges.where("active and edge_type = 'CONTAINS'").select(F.col("from_node_key").alias("node_key")).distinct()
    return nodes.where((F.col("node_type") == module) & (F.col("status") == "active")).join(holds, "node_key", "left_anti")


def discoveries(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """The rules that fire: rule, category, severity, confidence, n. Counts come from one pass over each table."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    active = F.col("status") == "active"
    by_node = nodes.agg(n(active & (F.col("node_type") == "controller"), "controllers"), n(active & (F.col("node_type") == "service"), "services"), n(active & (F.col("layer") == "data"), "data"), n(active & (F.col("layer") == "contract"), "contracts"))
    typed = lambda *t: F.col("active") & F.col("edge_type").isin(*t)
    by_edge = edges.agg(n(F.col("active") & (F.col("confidence") > 0) & (F.col("confidence") < 0.7), "low"), n(typed("EXPOSES_ENDPOINT"), "exposes"), n(typed("CALLS_SERVICE", "CALLS_ENDPOINT"), "calls"), n(typed("REFERENCES_MODEL"), "refs"), n(typed("USES_MODEL"), "uses"))
    bare = without_evidence(nodes, evidence).agg(F.count("*").alias("bare"))
    empty = modules_without_contains(nodes, edges).agg(F.count("*").alias("empty"))
    rows = by_node  # one row each; their maxima make one row
    for more in (by_edge, bare, empty):
        rows = rows.unionByName(more, allowMissingColumns=True)
    facts = rows.agg(*(F.max(c).alias(c) for c in rows.columns))
    gap = (F.col("data") == 0) | (F.col("contracts") == 0) | ((F.col("data") > 0) & ((F.col("refs") == 0) | (F.col("uses") == 0)))
    rules: list[tuple[int, Column, str, str, float, Column]] = [
        (1, F.col("low") > 0, "missing_edge", "", 0.3, F.col("low")),
        (2, F.col("bare") > 0, "missing_edge", "", 0.5, F.col("bare")),
        (3, F.col("empty") > 0, "unknown_pattern", "", 0.6, F.col("empty")),
        (4, (F.col("controllers") > 0) & (F.col("exposes") == 0), "missing_edge", "critical", 0.8, F.col("controllers")),
        (5, (F.col("services") > 1) & (F.col("calls") == 0), "missing_edge", "warning", 0.7, F.col("services")),
        (6, gap, "pattern", "", 0.9, F.lit(1).cast("long")),
    ]
    fired = F.array(*(F.when(cond, F.struct(F.lit(i).alias("rule"), F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(p).alias("confidence"), k.alias("n"))) for i, cond, c, s, p, k in rules))
    return facts.select(F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("_r")).select("_r.*")


def language_violations(nodes: DataFrame, glossary: DataFrame) -> DataFrame:
    """Nodes whose name or key has an anti-pattern of a term, in any case (glossary: term, anti_patterns). Names and keys are
    cut into the pieces that are as long as some anti-pattern, and pieces are joined with anti-patterns by equality. Up to
    FEW_PATTERNS different anti-patterns also go into one expression that leaves out nodes without any; the rows are the same
    either way. Only those patterns or the different lengths come to the driver."""
    terms = glossary.select("term", F.explode("anti_patterns").alias("anti_pattern")).where("anti_pattern is not null")
    lowered = terms.select(F.lower("anti_pattern").alias("p")).distinct()
    few = [r.p for r in lowered.limit(FEW_PATTERNS + 1).collect()]
    if len(few) <= FEW_PATTERNS:
        lengths = {len(p) for p in few}
        nodes = nodes.where(F.lower(F.concat_ws("\n", "name", "node_key")).rlike("|".join(map(re.escape, few)))) if few else nodes.where("false")
    else:
        lengths = {r[0] for r in lowered.select(F.length("p")).distinct().collect()}
    ends = lambda c, n: F.sequence(F.lit(1), F.length(c) - n + 1)
    cut = lambda c, n: F.when(F.length(c) >= n, F.transform(ends(c, n), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    of = [cut(F.lower(F.coalesce(c, F.lit(""))), n) for c in ("name", "node_key") for n in sorted(lengths)]
    pieces = F.array_distinct(F.concat(*of)) if of else F.array().cast("array<string>")
    each = nodes.select("node_key", "name", F.explode(pieces).alias("_piece"))
    return each.join(terms, F.col("_piece") == F.lower("anti_pattern")).select("node_key", "name", "term", "anti_pattern")


def request_metrics(requests: DataFrame, by: list[str]) -> DataFrame:
    """Calls, payload characters, duration and errors, over all requests or by tool, those with the most characters first."""
    size = F.length(F.coalesce("params_json", F.lit(""))) + F.length(F.coalesce("result_json", F.lit("")))
    grouped = requests.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(size).alias("total_chars"), F.avg(size).alias("avg_chars"), F.max(size).alias("max_chars"), F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("avg_ms"), F.count_if(failed()).alias("errors"))
    return grouped.orderBy(F.desc("total_chars"), *by) if by else grouped


def metrics_of(requests: DataFrame, tool: str) -> DataFrame:
    """Calls of one tool, and the mean and greatest length of their parameters."""
    size = F.length(F.coalesce("params_json", F.lit("")))
    own = requests.where(F.col("tool_name") == tool)
    return own.agg(F.count("*").alias("calls"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_chars"), F.coalesce(F.max(size), F.lit(0)).alias("max_chars"))


def summaries(requests: DataFrame, of: str = "result_json") -> DataFrame:
    """request_id and a short form of its result: the number of items of an array, the number of keys of an object, else ''."""
    text = F.trim(of)
    items = F.json_array_length(F.when(text.startswith("["), text))
    keys = F.size(F.json_object_keys(F.when(text.startswith("{"), text)))
    shown = F.when(items.isNotNull(), F.concat(items.cast("string"), F.lit(" items"))).when(keys >= 0, F.concat(keys.cast("string"), F.lit(" keys")))
    return requests.select("request_id", F.coalesce(shown, F.lit("")).alias("summary"))


@dataclass
class RetryMemory:
    """One session's log: the next number, and its last ten errors as (number, tool)."""

    seq: int = 0
    errors: list[tuple[int, str]] = field(default_factory=list)

    def step(self, tool: str, failed: bool) -> tuple[int, int | None]:
        """The number of a call and of the oldest remembered error that it repeats, within three numbers. The marker that is
        written for a retry takes a number of its own."""
        now, again = self.seq, None
        self.seq += 1
        if failed:
            self.errors = [*self.errors, (now, tool)][-REMEMBERED_ERRORS:]
        else:
            again = next((n for n, t in self.errors if t == tool and now - n <= RETRY_WITHIN), None)
            self.seq += again is not None
        return now, again


def failed(message: str = "error_message") -> Column:
    return F.coalesce(message, F.lit("")) != ""


def retries(requests: DataFrame, session: str) -> DataFrame:
    """Successes of a tool that failed just before in the session: the call, its number, and that of the oldest such failure.
    Every session is read in order, with a bounded memory, as numbers depend on the retries before."""
    rows = requests.select(F.col(session).cast("long").alias(session), "request_id", "tool_name", failed().alias("failed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, memory = object(), RetryMemory()
        for batch in batches:
            out = []
            for who, call, tool, bad in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if who != now:
                    now, memory = who, RetryMemory()
                seq, again = memory.step(tool, bad)
                if again is not None:
                    out.append((who, call, tool, seq, again))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[session, "request_id", "tool_name", "seq", "failed_seq"])

    ordered = rows.repartition(session).sortWithinPartitions(session, "request_id")
    return ordered.mapInArrow(run, f"{session} bigint, request_id bigint, tool_name string, seq int, failed_seq int")


def touching(edges: DataFrame, nodes: DataFrame, domain: str) -> DataFrame:
    """Edges with either end in the domain."""
    inside = nodes.where(F.col("domain_key") == domain).select("node_key").distinct()
    a = edges.join(inside.withColumnRenamed("node_key", "from_node_key"), "from_node_key", "left_semi").select(edges.columns)
    b = edges.join(inside.withColumnRenamed("node_key", "to_node_key"), "to_node_key", "left_semi").select(edges.columns)
    return a.unionAll(b).dropDuplicates(["edge_key"])
