"""The named queries over the projected graph, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archloom.functions import keys
from archloom.operators import insight, ledger, lookup, mutate, paths, temporal, traverse, trust, validate
from archloom.plans import records  # noqa: F401  (registers queries of its own)
from archloom.plans.base import ORACLES, QUERIES, query
from archloom.schema import PAYLOAD
from archloom.session import cut, own_folder, remove
from archloom.store import GraphStore
from archloom.sources.projection import BRAND, CTES, CUSTOMER, NATION, ORDER, PART, SUPPLIER, World
from archloom.sources.registry import Registry
from archloom.streaming import requests as streams

R6 = lambda c, name=None: (F.round(F.col(c) * 1e6) / 1e6).alias(name or c)


# --- scans -----------------------------------------------------------------------------------------------------------
@query("SELECT node_key, node_type, name FROM nodes WHERE layer = 'ownership'")
def node_list_by_layer(w):
    return lookup.nodes_where(w.open_nodes, layer="ownership").select("node_key", "node_type", "name")


@query("SELECT node_key, name FROM nodes WHERE layer = 'code' AND node_type = 'provider' AND last_seen >= 5")
def node_list_filtered(w):
    return lookup.nodes_where(w.open_nodes, "code", "provider", "shop", status="active").where("last_seen >= 5").select("node_key", "name")


@query("SELECT edge_key, derivation_kind FROM drawn_keys WHERE edge_type = 'IMPORTS'".replace("drawn_keys", "(SELECT *, a || '->' || b || ':' || edge_type AS edge_key FROM drawn)"))
def edge_list_by_type(w):
    return lookup.edges_where(w.open(w.drawn), edge_type="IMPORTS", active=True).select("edge_key", "derivation_kind")


@query(f"SELECT edge_key, edge_type FROM edges WHERE from_node_key = '{PART}7' AND active")
def edge_list_from_node(w):
    return lookup.edges_where(w.open(w.edges), source=f"{PART}7", active=True).select("edge_key", "edge_type")


@query(f"SELECT edge_key, source_kind, status, polarity, round(confidence * 1e6) / 1e6 AS confidence FROM evidence WHERE edge_key LIKE '{PART}7->%'")
def evidence_by_edge(w):
    return w.evidence.where(F.col("edge_key").startswith(f"{PART}7->")).select("edge_key", "source_kind", "status", "polarity", R6("confidence"))


@query("SELECT DISTINCT file_path FROM evidence WHERE status = 'stale' AND file_path <> ''")
def stale_file_paths(w):
    return mutate.stale_files(w.evidence)


@query("SELECT event_id AS request_id, event_type AS tool_name FROM events ORDER BY event_id DESC LIMIT 100 OFFSET 50", graph=False)
def request_page(w):
    return lookup.request_page(w.requests, 0, 50).select("request_id", "tool_name")


@query("SELECT event_id AS request_id, event_type AS tool_name FROM events WHERE event_id > 900", graph=False)
def requests_since(w):
    return lookup.requests_since(w.requests, 900).select("request_id", "tool_name")


@query("SELECT node_key, name FROM nodes WHERE name ILIKE '%ring%' ORDER BY (lower(name) <> 'ring'), node_key LIMIT 10")
def name_search_top10(w):
    return insight.name_search(w.nodes, "RING").select("node_key", "name")


@query("SELECT node_key FROM nodes WHERE name = 'Supplier#000000007' OR name = (SELECT s_name FROM supplier WHERE s_suppkey = 7)")
def name_resolve(w):
    name = w.table("supplier").where("s_suppkey = 7").first().s_name
    return w.nodes.where(F.col("node_key") == insight.resolve(w.nodes, name)).select("node_key")


# --- keys and validation ---------------------------------------------------------------------------------------------
MESSY = "concat(' CODE : Provider:shop:/', p_name, ':', cast(p_partkey as string), '/ ')"


@query("SELECT p_partkey, 'code:provider:shop:' || lower(p_name) || ':' || p_partkey AS node_key FROM part", graph=False)
def key_normalize(w):
    return w.table("part").select("p_partkey", keys.node_key(F.expr(MESSY)).alias("node_key"))


@query("""SELECT a || '->' || b || ':' || edge_type AS edge_key, a AS from_key, b AS to_key, edge_type FROM drawn""")
def edge_key_parse(w):
    messy = F.concat(F.lit(" "), F.upper(F.substring_index("edge_key", "->", 1)), F.lit("->"), F.substring_index("edge_key", "->", -1), F.lit(" "))
    a, b, t = keys.edge_parts(F.col("messy"))
    return w.drawn.select("edge_key", messy.alias("messy")).select(keys.edge_key(F.col("edge_key")).alias("edge_key"), F.lower(a).alias("from_key"), b.alias("to_key"), t.alias("edge_type"))


def _suspect_nodes(w):
    """Parts with faults by key: blank names, broken keys, unknown layers and types, confidences out of range."""
    p = F.col("p_partkey")
    case = lambda n, bad, good: F.when(p % 7 == n, F.lit(bad)).otherwise(good)
    return w.table("part").select(case(1, "code:provider", F.concat(F.lit("code:provider:shop:"), p)).alias("node_key"), case(2, "cloud", F.lit("code")).alias("layer"), case(3, "gadget", F.lit("provider")).alias("node_type"), F.lit("shop").alias("domain_key"), case(4, " ", F.col("p_name")).alias("name"), case(5, 1.5, F.lit(0.0)).alias("confidence"), F.lit("").alias("status"), F.lit("").alias("metadata"), p.alias("p_partkey"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 4 THEN 'name is required' WHEN 1 THEN 'malformed key' WHEN 2 THEN 'unknown layer' WHEN 3 THEN 'unknown node type' WHEN 5 THEN 'confidence out of range' END AS error
FROM part WHERE p_partkey % 7 BETWEEN 1 AND 5""", graph=False)
def node_validation_errors(w):
    return validate.nodes(_suspect_nodes(w), Registry.load()).where("error is not null").select("p_partkey", "error")


@query("SELECT DISTINCT p_partkey, 'layers not allowed' AS error FROM part WHERE p_partkey % 3 = 0", graph=False)
def edge_layer_violations(w):
    p = F.col("p_partkey")
    rows = w.table("part").select("p_partkey", F.concat(F.lit("code:provider:shop:"), p).alias("from_node_key"), F.lit("service:service:shop:x").alias("to_node_key"), F.lit("").alias("edge_key"), F.lit("CALLS_SERVICE").alias("edge_type"), F.lit("").alias("derivation_kind"), F.when(p % 3 == 0, "data").otherwise("code").alias("from_layer"), F.lit("service").alias("to_layer"), F.lit(0.5).alias("confidence"), F.lit("").alias("metadata"))
    return validate.edges(rows, Registry.load()).where("error is not null").select("p_partkey", "error")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber % 7 = 3 AND l_quantity > 25 GROUP BY ALL", graph=False)
def evidence_validation_errors(w):
    rows = w.table("lineitem").select("l_orderkey", "l_linenumber", F.lit("edge").alias("target_kind"), F.when((F.col("l_linenumber") % 7 == 3) & (F.col("l_quantity") > 25), "user_feedback").otherwise("file").alias("source_kind"), F.lit("x").alias("extractor_id"), F.lit("1").alias("extractor_version"), F.lit(0.5).alias("confidence"))
    return validate.evidence(rows, Registry.load()).where("error is not null").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


FAULTS = """(SELECT 'node' AS kind, CASE WHEN last_seen = 3 THEN 'broken:' || name ELSE node_key END AS key, CASE WHEN last_seen = 3 THEN 'malformed key' WHEN last_seen = 4 THEN 'confidence out of range' END AS issue FROM nodes
UNION ALL SELECT 'edge', CASE WHEN last_seen = 5 THEN a || '=>' || b ELSE a || '->' || b || ':' || edge_type END, CASE WHEN last_seen = 5 THEN 'malformed key' {more} END FROM drawn)"""


def _faulty(w):
    """Nodes and edges with broken keys and confidences out of range."""
    n = w.nodes.withColumn("node_key", F.when(F.col("last_seen") == 3, F.concat(F.lit("broken:"), "name")).otherwise(F.col("node_key"))).withColumn("confidence", F.when(F.col("last_seen") == 4, F.lit(2.0)).otherwise(F.lit(1.0)))
    e = w.drawn.withColumn("edge_key", F.when(F.col("last_seen") == 5, F.concat("from_node_key", F.lit("=>"), "to_node_key")).otherwise(F.col("edge_key"))).withColumn("confidence", F.when(F.col("last_seen") == 6, F.lit(-1.0)).otherwise(F.lit(1.0)))
    return n, e


@query(f"SELECT kind, key, issue FROM {FAULTS.format(more='WHEN last_seen = 6 THEN ' + repr('confidence out of range'))} WHERE issue IS NOT NULL")
def integrity_issues(w):
    return validate.integrity(*_faulty(w))


@query(f"SELECT kind, key, issue FROM {FAULTS.format(more='')} WHERE issue IS NOT NULL")
def integrity_issues_strict(w):
    return validate.integrity_strict(*_faulty(w))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey WHEN 1 THEN p_size WHEN 2 THEN -p_size ELSE 0 END::INT AS n FROM part", graph=False)
def lenient_int_parse(w):
    raw = F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey").cast("string")).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(" +"), F.col("p_size").cast("string"), F.lit("abc"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("-"), F.col("p_size").cast("string"), F.lit(".5"))).otherwise(F.lit("x1"))
    return w.table("part").select("p_partkey", keys.lenient_int(raw).alias("n"))


# --- walks -----------------------------------------------------------------------------------------------------------
def _walk_sql(start: str, depth: int, reverse: bool, where: str, edges: str = "edges") -> str:
    a, b = ("to_node_key", "from_node_key") if reverse else ("from_node_key", "to_node_key")
    return f"""
    WITH RECURSIVE open_edges AS MATERIALIZED (SELECT * FROM {edges} WHERE active AND {where}),
    walked AS (
      SELECT '{start}' AS k, 0 AS d, []::VARCHAR[] AS ord, ['{start}'] AS ks, []::VARCHAR[] AS ts, 1.0::double AS product
      UNION ALL SELECT e.{b}, d + 1, list_append(ord, e.edge_key), list_append(ks, e.{b}), list_append(ts, e.edge_type), product * e.trust_score
      FROM walked JOIN open_edges e ON e.{a} = k WHERE d < {depth} AND NOT list_contains(ks, e.{b})),
    reached AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, ord) AS r FROM walked) WHERE r = 1 AND d > 0)"""


def _recursive(sql: str) -> str:
    """The projection and a recursive part in one WITH."""
    return "WITH RECURSIVE " + CTES.strip()[5:] + ", " + sql.strip()[len("WITH RECURSIVE ") :]


def walk_query(name: str, start: str, depth: int, reverse: bool = False, derivations: tuple[str, ...] = ()):
    where = f"derivation_kind IN ({', '.join(map(repr, derivations))})" if derivations else "true"
    ORACLES[name] = _recursive(_walk_sql(start, depth, reverse, where) + """
    SELECT n.node_key, n.name, n.layer, d AS depth, array_to_string(ord, '|') AS via FROM reached JOIN nodes n ON n.node_key = k""")

    def run(spark, sf_dir):
        w = World(spark, sf_dir)
        return traverse.deps(w.nodes, w.edges, start, depth, reverse, derivations, w.edges_at).select("node_key", "name", "layer", "depth", "via")

    QUERIES[name] = run


walk_query("deps_depth1", f"{PART}77", 1)
walk_query("deps_depth3", f"{PART}77", 3)
walk_query("deps_hard_only", f"{PART}77", 4, derivations=("hard",))
walk_query("reverse_deps_depth3", f"{PART}5", 3, reverse=True)

IMPACT_EDGES = "edge_type IN ('INJECTS', 'IMPORTS', 'CALLS_SERVICE', 'CONSUMES_TOPIC')"


def impact_query(name: str, start: str, depth: int, top_k: int = 50, min_score: float = 0.0, structural: bool = False, part: str = "nodes"):
    top = f"""top AS (SELECT * FROM (SELECT k, d, ord, ks, ts, round(100.0::double * product * pow(0.95::double, d - 1) * 100.0) / 100.0 AS score,
        round(product * 1000.0) / 1000.0 AS trust_chain FROM reached) WHERE score >= {min_score} ORDER BY score DESC, d, ord LIMIT {top_k})"""
    if part == "nodes":
        tail = "SELECT n.node_key, n.name, d AS depth, score, trust_chain, array_to_string(ks, '>') AS path, array_to_string(ts, '>') AS edge_types FROM top JOIN nodes n ON n.node_key = k"
    else:
        kind = "EXPOSES_ENDPOINT" if part == "endpoint" else "PUBLISHES_TOPIC"
        tail = f"""SELECT to_node_key AS target_key, arg_min(label, row(minus, d, ord, label)) AS exposed_by FROM edges JOIN (SELECT k, k AS label, -score AS minus, d, ord FROM top
        UNION ALL SELECT '{start}', '(changed)', -1e9::double, 0, ['']) x ON from_node_key = x.k WHERE active AND edge_type = '{kind}' GROUP BY 1"""
    ORACLES[name] = _recursive(_walk_sql(start, depth, True, IMPACT_EDGES) + f", {top} {tail}")

    def run(spark, sf_dir):
        w = World(spark, sf_dir)
        found = traverse.impact(w.nodes, w.edges, Registry.load(), start, depth, top_k, min_score, include_structural=structural, some=w.edges_at)
        if part == "nodes":
            return found.nodes.select("node_key", "name", "depth", "score", "trust_chain", "path", "edge_types")
        return found.surface.where(F.col("kind") == part).select("target_key", "exposed_by")

    QUERIES[name] = run


impact_query("impact_depth4", f"{PART}5", 4, 1000)
impact_query("impact_min_score", f"{PART}3", 4, 1000, 5.0)
impact_query("impact_topk", f"{SUPPLIER}7", 2, 25)
impact_query("impact_include_structural_noop", f"{PART}5", 4, 1000, structural=True)
impact_query("impact_surface_endpoints", f"{PART}5", 3, 200, part="endpoint")
impact_query("impact_surface_topics", f"{CUSTOMER}11", 2, 50, part="topic")


def path_query(name: str, start: str, end: str, depth: int, top_k: int, connected: bool = False, structural: bool = False, derivations: tuple[str, ...] = (), source: str = "drawn"):
    where = [f"derivation_kind IN ({', '.join(map(repr, derivations))})"] if derivations else []
    if not structural:
        where.append("edge_type NOT IN ('OWNED_BY', 'DEPENDS_ON_DOMAIN')")
    back = "true" if connected else "edge_type = 'CONSUMES_TOPIC' AND starts_with(to_node_key, 'contract:topic:')"
    edges = "edges" if source == "edges" else "(SELECT a AS from_node_key, b AS to_node_key, a || '->' || b || ':' || edge_type AS edge_key, edge_type, derivation_kind, true AS active, base AS confidence FROM drawn JOIN (VALUES ('hard', 0.5::double), ('linked', 0.4::double), ('inferred', 0.3::double), ('unknown', 0.15::double)) x(kind, base) ON kind = derivation_kind)"
    ORACLES[name] = _recursive(f"""WITH RECURSIVE open_edges AS MATERIALIZED (SELECT * FROM {edges} WHERE active AND {' AND '.join(where) or 'true'}),
    hops AS MATERIALIZED (SELECT from_node_key AS a, to_node_key AS b, '0|' || edge_key AS o, edge_key, edge_type, confidence FROM open_edges
      UNION ALL SELECT to_node_key, from_node_key, '1|' || edge_key, edge_key, edge_type, confidence FROM open_edges WHERE {back}),
    reach AS (SELECT '{end}' AS node, 0 AS h UNION SELECT a, h + 1 FROM reach JOIN hops ON b = node WHERE h < {depth - 1}),
    far AS MATERIALIZED (SELECT node, min(h) AS h FROM reach GROUP BY 1),
    grown AS (SELECT '{start}' AS pos, ['{start}'] AS ns, []::VARCHAR[] AS ord, []::VARCHAR[] AS es, []::VARCHAR[] AS ts, 1.0::double AS p, 0.0::double AS c
      UNION ALL SELECT b, list_append(ns, b), list_append(ord, o), list_append(es, edge_key), list_append(ts, edge_type), p * CASE WHEN confidence <= 0 THEN 1.0 ELSE confidence END, c - ln(CASE WHEN confidence <= 0 THEN 1.0 ELSE confidence END)
      FROM grown JOIN hops ON a = pos JOIN far ON far.node = b WHERE len(ord) < {depth} AND pos <> '{end}' AND NOT list_contains(ns, b) AND far.h <= {depth} - 1 - len(ord)),
    hits AS (SELECT *, len(ord) AS depth FROM grown WHERE pos = '{end}' AND len(ord) > 0 ORDER BY len(ord), ord LIMIT {top_k * 10})
    SELECT depth::INT AS depth, round((c + 0.05::double * depth) * 10000.0) / 10000.0 AS cost, round(p * CASE WHEN depth > 1 THEN pow(0.95::double, depth - 1) ELSE 1.0 END * 10000.0) / 10000.0 AS score,
      array_to_string(ns, ',') AS nodes, array_to_string(es, ',') AS edges, array_to_string(ts, ',') AS types, (SELECT count(*) FROM hits)::INT AS total_found FROM hits ORDER BY cost, depth, nodes, ord LIMIT {top_k}""")

    def run(spark, sf_dir):
        w = World(spark, sf_dir)
        edges, some = (w.edges, w.edges_at) if source == "edges" else (w.drawn, w.drawn_at)
        return paths.paths(edges, Registry.load(), start, end, depth, top_k, connected, structural, derivations, some)

    QUERIES[name] = run


path_query("path_directed", f"{PART}150", f"{PART}1", 6, 5, derivations=("hard", "linked"))
path_query("path_connected", f"{PART}12", f"{PART}13", 3, 3, connected=True, derivations=("hard",))
path_query("path_pubsub", f"{CUSTOMER}10", f"{SUPPLIER}3", 3, 3)
path_query("path_derivation_filter", f"{PART}150", f"{PART}1", 8, 5, derivations=("hard",))
path_query("path_include_structural", f"{NATION}6", f"{NATION}1", 2, 3, connected=True, structural=True)
path_query("path_topk_cost", f"{PART}199", f"{PART}0", 7, 3, source="edges", derivations=("hard", "linked"))


# --- trust -----------------------------------------------------------------------------------------------------------
@query("SELECT edge_key, round(positive * 1e6) / 1e6 AS positive FROM judged")
def confidence_positive(w):
    return w.judged.select("edge_key", R6("positive"))


@query("SELECT edge_key, round(negative * 1e6) / 1e6 AS negative FROM judged")
def confidence_negative(w):
    return w.judged.select("edge_key", R6("negative"))


@query("SELECT edge_key, round(freshness * 1e6) / 1e6 AS freshness FROM judged")
def freshness(w):
    return w.judged.select("edge_key", R6("freshness"))


@query("SELECT edge_key, ceiling FROM judged")
def confidence_cap(w):
    return w.judged.select("edge_key", "ceiling")


@query("SELECT edge_key, round(confidence * 1e6) / 1e6 AS confidence, round(confidence * freshness * 1e6) / 1e6 AS trust_score, status FROM judged")
def edge_trust(w):
    return w.judged.select("edge_key", R6("confidence"), R6("trust_score"), "status")


@query("SELECT status, count(*) AS n FROM judged GROUP BY 1")
def edge_status_counts(w):
    return w.judged.groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT node_key, count(*) AS n, round((1.0::double - product(CASE WHEN polarity = 'positive' AND status = 'valid' THEN 1.0::double - confidence ELSE 1.0::double END)) * 1e6) / 1e6 AS positive
FROM evidence GROUP BY 1""")
def node_trust(w):
    return trust.trust(w.evidence, ["node_key"]).select("node_key", "n", R6("positive"))


@query("SELECT 'edge' AS kind, edge_type AS name, coalesce(j.status, 'unknown') AS trust_status, count(*) AS n FROM drawn d LEFT JOIN judged j ON j.edge_key = d.a || '->' || d.b || ':' || d.edge_type GROUP BY ALL")
def status_with_unknown(w):
    told = trust.status_of(w.drawn, w.judged, "edge_key")
    return told.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("name"), "trust_status").agg(F.count("*").alias("n"))


@query("""SELECT edge_key, version, round(CASE version WHEN 'closed' THEN 0.33::double ELSE confidence END * 1e6) / 1e6 AS confidence, CASE version WHEN 'closed' THEN true ELSE status NOT IN ('contradicted', 'removed') END AS active
FROM judged, (VALUES ('open'), ('closed')) v(version)""")
def trust_write_back_versions(w):
    """Closed versions keep what they say; open ones get the trust of their evidence."""
    calls = w.drawn.where("edge_type = 'CALLS_SERVICE'").withColumn("confidence", F.lit(0.33))  # those that evidence tells of
    versions = calls.withColumn("valid_to", F.lit(None).cast("long")).unionAll(calls.withColumn("valid_to", F.lit(7).cast("long")))
    after = trust.apply_to_edges(versions, w.judged)
    return after.select("edge_key", F.when(F.col("valid_to").isNull(), "open").otherwise("closed").alias("version"), R6("confidence"), "active")


# --- changes ---------------------------------------------------------------------------------------------------------
def _customers(w):
    """A version of a customer for each year with an order: its greatest price; the last year's version is open."""
    o = w.table("orders").groupBy(F.concat(F.lit(CUSTOMER), "o_custkey").alias("node_key"), (F.year("o_orderdate") - 1990).cast("long").alias("valid_from")).agg(F.max("o_totalprice").alias("trust_score"), F.min("o_orderpriority").alias("status"))
    following = F.expr("lead(valid_from) over (partition by node_key order by valid_from)")
    return o.withColumn("valid_to", following).withColumn("node_id", F.xxhash64("node_key", "valid_from"))


VERSIONS = f"""customers AS (SELECT *, lead(valid_from) OVER (PARTITION BY node_key ORDER BY valid_from) AS valid_to FROM (
  SELECT '{CUSTOMER}' || o_custkey AS node_key, year(o_orderdate) - 1990 AS valid_from, max(o_totalprice) AS trust_score, min(o_orderpriority) AS status FROM orders GROUP BY ALL))"""


def _incoming(w):
    return w.table("customer").where("c_custkey % 5 = 0").select(F.concat(F.lit(CUSTOMER), "c_custkey").alias("node_key"), F.col("c_acctbal").alias("trust_score"), F.lit("imported").alias("status"))


@query(f"WITH {VERSIONS}, inc AS (SELECT '{CUSTOMER}' || c_custkey AS node_key, c_acctbal AS trust_score FROM customer WHERE c_custkey % 5 = 0) SELECT coalesce(i.node_key, c.node_key) AS node_key, coalesce(i.trust_score, c.trust_score) AS trust_score, CASE WHEN i.node_key IS NULL THEN c.status ELSE 'imported' END AS status FROM (SELECT * FROM customers WHERE valid_to IS NULL) c FULL JOIN inc i ON i.node_key = c.node_key".replace("WITH ", "WITH ", 1), graph=False)
def node_upsert_current(w):
    after = mutate.upsert(_customers(w), _incoming(w), "node_key", "node_id")
    return after.where(mutate.is_open()).select("node_key", "trust_score", "status")


@query(f"""WITH {VERSIONS}, inc AS (SELECT '{CUSTOMER}' || c_custkey AS node_key, c_acctbal AS trust_score FROM customer WHERE c_custkey % 5 = 0)
SELECT c.node_key, c.valid_from, CASE WHEN c.valid_to IS NULL AND i.node_key IS NOT NULL THEN 99 ELSE c.valid_to END AS valid_to, c.status FROM customers c LEFT JOIN inc i ON i.node_key = c.node_key
UNION ALL SELECT node_key, 99, NULL, 'imported' FROM inc""", graph=False)
def node_upsert_versions(w):
    return mutate.upsert(_customers(w), _incoming(w), "node_key", "node_id", revision=99).select("node_key", "valid_from", "valid_to", "status")


@query("""SELECT edge_key, 1::BIGINT AS valid_from, CASE WHEN edge_type = 'INJECTS' AND last_seen > 4 THEN 8::BIGINT END AS valid_to, derivation_kind FROM (SELECT *, a || '->' || b || ':' || edge_type AS edge_key FROM drawn)
UNION ALL SELECT a || '->' || b || ':' || edge_type, 8, NULL, 'linked' FROM drawn WHERE edge_type = 'INJECTS' AND last_seen > 4""")
def edge_upsert_versions(w):
    base = w.drawn.withColumns({"valid_from": F.lit(1).cast("long"), "valid_to": F.lit(None).cast("long"), "edge_id": F.xxhash64("edge_key")})
    incoming = base.where("edge_type = 'INJECTS' and last_seen > 4").drop("valid_from", "valid_to", "edge_id").withColumn("derivation_kind", F.lit("linked"))
    return mutate.upsert(base, incoming, "edge_key", "edge_id", revision=8).select("edge_key", "valid_from", "valid_to", "derivation_kind")


@query(f"""WITH inc AS (SELECT '{CUSTOMER}' || o_custkey AS node_key, arg_max(o_orderpriority, o_orderkey) AS status, arg_max(o_orderkey, o_orderkey) AS last_seen FROM orders GROUP BY 1)
SELECT '{CUSTOMER}' || c_custkey AS node_key, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 9 END::BIGINT AS first_seen, coalesce(i.last_seen, 1)::BIGINT AS last_seen, coalesce(i.status, 'old') AS status
FROM customer LEFT JOIN inc i ON i.node_key = '{CUSTOMER}' || c_custkey WHERE c_custkey % 2 = 0 OR i.node_key IS NOT NULL""", graph=False)
def node_upsert_batch(w):
    """A batch that repeats keys: its last row counts, and a node that is there keeps when it was first seen."""
    key = lambda c: F.concat(F.lit(CUSTOMER), c).alias("node_key")
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    there = w.table("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("node_id"), key("c_custkey"), F.lit("code").alias("layer"), F.lit("old").alias("status"), one.alias("first_seen"), one.alias("last_seen"), none.alias("valid_from"), none.alias("valid_to"))
    batch = w.table("orders").select(F.col("o_orderkey").alias("position"), key("o_custkey"), F.lit("code").alias("layer"), F.col("o_orderpriority").alias("status"), F.lit(9).cast("long").alias("first_seen"), F.col("o_orderkey").alias("last_seen"))
    return mutate.upsert(there, batch, "node_key", "node_id", fixed=("layer",)).select("node_key", "first_seen", "last_seen", "status")


@query(f"SELECT '{CUSTOMER}' || o_custkey AS from_node_key, '{ORDER}' || o_orderkey AS to_node_key, CASE WHEN o_orderkey % 3 = 0 THEN 'linked' ELSE 'hard' END AS derivation_kind FROM orders", graph=False)
def edge_upsert_keeps_ends(w):
    """Ends that a batch doesn't give stay as they are stored."""
    base = w.drawn.where("edge_type = 'PUBLISHES_TOPIC'").withColumns({"valid_from": F.lit(None).cast("long"), "valid_to": F.lit(None).cast("long"), "edge_id": F.xxhash64("edge_key")})
    third = F.split("to_node_key", "-").getItem(F.size(F.split("to_node_key", "-")) - 1).cast("long") % 3 == 0
    batch = base.where(third).select("edge_key", F.lit(None).cast("string").alias("from_node_key"), F.lit(None).cast("string").alias("to_node_key"), F.lit("linked").alias("derivation_kind"), F.lit(1).alias("position"))
    return mutate.upsert(base, batch, "edge_key", "edge_id", filled=("from_node_key", "to_node_key")).select("from_node_key", "to_node_key", "derivation_kind")


def _deleted_versions(w, key: str):
    return mutate.soft_delete(_customers(w), "node_key", key, {"status": F.lit("deleted")})


@query(f"WITH {VERSIONS} SELECT node_key, valid_from, CASE WHEN node_key = '{CUSTOMER}11' THEN 'deleted' ELSE status END AS status FROM customers", graph=False)
def soft_delete_node(w):
    return _deleted_versions(w, f"{CUSTOMER}11").select("node_key", "valid_from", "status")


@query(f"SELECT a || '->' || b || ':' || edge_type AS edge_key, NOT (a = '{PART}9' AND b = '{PART}4' AND edge_type = 'INJECTS') AS active FROM drawn WHERE edge_type = 'INJECTS'")
def soft_delete_edge(w):
    return mutate.soft_delete(w.drawn.where("edge_type = 'INJECTS'"), "edge_key", f"{PART}9->{PART}4:INJECTS", {"active": F.lit(False)}).select("edge_key", "active")


def _stored(w, rows: DataFrame) -> DataFrame:
    """One stored row for each identity among evidence rows."""
    cols = [c for c in mutate.IDENTITY]
    one = rows.groupBy(F.xxhash64(*cols).alias("_hash"), *cols).agg(F.max("status").alias("status"), F.max("confidence").alias("confidence")).drop("_hash")  # sorted by a number first
    extra = {"evidence_id": F.xxhash64(*cols), "commit_sha": F.lit(""), "extractor_version": F.lit("1"), "last_verified": F.lit(0).cast("long"), "valid_from": F.lit(0).cast("long"), "valid_to": F.lit(None).cast("long")}
    return one.withColumns(extra)


IDENT = "edge_key, source_kind, file_path, line_start, polarity"


@query(f"SELECT {IDENT}, 'valid' AS status, max(confidence) AS confidence FROM evidence GROUP BY {IDENT}")
def evidence_dedup(w):
    empty = _stored(w, w.evidence.where("false"))
    incoming = w.evidence.select(*mutate.IDENTITY, "confidence", "commit_sha", "extractor_version", F.col("confidence").alias("position"))
    after = mutate.upsert_evidence(empty, incoming)
    return after.select(F.col("target_key").alias("edge_key"), "source_kind", "file_path", "line_start", "polarity", "status", "confidence")


@query(f"""SELECT {IDENT}, CASE WHEN again = 0 THEN status WHEN status = 'stale' AND again = 1 THEN 'revalidated' ELSE 'valid' END AS status FROM (
SELECT {IDENT}, max(status) AS status, count(*) FILTER (l_quantity > 30) AS again FROM evidence GROUP BY {IDENT})""")
def evidence_revalidate(w):
    incoming = w.evidence.where("l_quantity > 30").select(*mutate.IDENTITY, "confidence", "commit_sha", "extractor_version", F.col("confidence").alias("position"))
    after = mutate.upsert_evidence(_stored(w, w.evidence), incoming, 9)
    return after.select(F.col("target_key").alias("edge_key"), "source_kind", "file_path", "line_start", "polarity", "status")


@query("SELECT CASE WHEN last_seen < 4 THEN 'stale' ELSE 'active' END AS status, layer, count(*) AS n FROM nodes GROUP BY ALL")
def stale_mark_nodes(w):
    return mutate.mark_stale_nodes(w.nodes, "shop", 4).groupBy("status", "layer").agg(F.count("*").alias("n"))


@query("SELECT edge_type, active AND last_seen >= 4 AS active, count(*) AS n FROM edges GROUP BY ALL")
def stale_mark_edges(w):
    return mutate.mark_stale_edges(w.edges, w.nodes, "shop", 4).groupBy("edge_type", "active").agg(F.count("*").alias("n"))


def _changed(w):
    return w.table("orders").where("o_orderkey % 10 = 3").select(F.concat(F.lit("orders/"), "o_orderkey").alias("file_path"))


CHANGED = "file_path IN (SELECT 'orders/' || o_orderkey FROM orders WHERE o_orderkey % 10 = 3)"


@query(f"SELECT CASE WHEN {CHANGED} THEN 'stale' ELSE status END AS status, polarity, count(*) AS n FROM evidence GROUP BY ALL")
def invalidate_legacy(w):
    return mutate.invalidate(w.evidence, _changed(w)).groupBy("status", "polarity").agg(F.count("*").alias("n"))


@query(f"""SELECT status, closed, count(*) AS n FROM (SELECT status, status = 'valid' AND {CHANGED} AS closed FROM evidence UNION ALL SELECT 'stale', false FROM evidence WHERE status = 'valid' AND {CHANGED}) GROUP BY ALL""")
def invalidate_versioned(w):
    rows = w.evidence.withColumns({"valid_from": F.lit(0).cast("long"), "valid_to": F.lit(None).cast("long"), "evidence_id": F.xxhash64("target_key", "line_start")})
    after = mutate.invalidate(rows, _changed(w), revision=50)
    return after.groupBy("status", (F.coalesce("valid_to", F.lit(0)) > 0).alias("closed")).agg(F.count("*").alias("n"))


@query(f"SELECT 'stale' AS status, count(*) AS n FROM evidence WHERE status = 'stale' OR {CHANGED}")
def finalize_counts(w):
    return mutate.status_counts(mutate.invalidate(w.evidence, _changed(w)))


@query(f"SELECT DISTINCT 'edge' AS target_kind, edge_key AS target_key FROM evidence WHERE {CHANGED}")
def invalidated_targets(w):
    return mutate.invalidated_targets(mutate.invalidate(w.evidence, _changed(w)), _changed(w))


#: The projection with evidence as an import keeps it: of equal rows the surest, stale if one of them is.
KEPT = CTES.replace("FROM evidence),\njudged_sums", "FROM (SELECT edge_key, source_kind, file_path, line_start, polarity, max(confidence) AS confidence, min(status) AS status FROM evidence GROUP BY ALL)),\njudged_sums")


@query(KEPT + """SELECT 'nodes' AS kind, count(*) AS n, 0.0::double AS trust FROM nodes UNION ALL SELECT edge_type, count(*), round(sum(trust_score) * 1e3) / 1e3 FROM edges WHERE active GROUP BY 1
UNION ALL SELECT 'edges', count(*), 0.0 FROM edges UNION ALL SELECT 'evidence', count(*), 0.0 FROM (SELECT DISTINCT edge_key, source_kind, file_path, line_start, polarity FROM evidence)
UNION ALL SELECT 'evidence taken', count(*), 0.0 FROM evidence UNION ALL SELECT 'aliases', count(*), 0.0 FROM part""", graph=False)
def import_summary(w):
    """The whole graph imported as one payload: what the tables hold afterwards. Its evidence goes in as new, that is valid,
    and is invalidated afterwards where it is stale, which brings the trust of the other queries."""
    folder = own_folder(w.spark, "import")
    store = GraphStore(w.spark, folder)
    layer = lambda c: F.substring_index(c, ":", 1)
    place = F.monotonically_increasing_id()
    e = w.evidence.withColumns({"position": F.col("confidence"), "line_end": F.col("line_start"), "node_key": F.lit(None).cast("string")})
    nodes = w.nodes.withColumns({"position": place, "metadata": F.lit("")})
    edges = w.drawn.withColumns({"position": place, "metadata": F.lit(""), "from_layer": layer("from_node_key"), "to_layer": layer("to_node_key")})
    aliases = w.table("part").select(F.concat(F.lit(PART), "p_partkey").alias("node_key"), F.col("p_name").alias("alias"), F.lit("name").alias("alias_kind"), F.lit(0.0).alias("confidence"))
    payload = {"nodes": nodes.select("position", "node_key", "layer", "node_type", "domain_key", "name", "status", "confidence", "metadata"), "edges": edges.select("position", "edge_key", "from_node_key", "to_node_key", "edge_type", "derivation_kind", "from_layer", "to_layer", "confidence", "metadata"), "evidence": e, "aliases": aliases}
    done = store.import_payload(payload)
    stale = w.evidence.where("status = 'stale'").select(*mutate.IDENTITY, F.lit("stale").alias("_now")).distinct()
    told = store.table("evidence").join(stale, list(mutate.IDENTITY), "left").withColumn("status", F.coalesce("_now", "status"))
    after = trust.apply_to_edges(store.table("edges"), trust.trust(told.withColumnRenamed("target_key", "edge_key"), ["edge_key"]))
    total = lambda kind, n: w.spark.range(1).select(F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("n"), F.lit(0.0).alias("trust"))
    by_type = after.where("active").groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n"), (F.round(F.sum("trust_score") * 1e3) / 1e3).alias("trust"))
    rows = by_type.unionAll(total("edges", done["edges"])).unionAll(total("nodes", store.table("nodes").count())).unionAll(total("evidence", store.table("evidence").count())).unionAll(total("evidence taken", done["evidence"])).unionAll(total("aliases", store.table("aliases").count()))
    out = cut(rows)
    remove(w.spark, folder)
    return out


# --- time ------------------------------------------------------------------------------------------------------------
def _revisions(w):
    y = (F.year("l_shipdate") - 1990).cast("long")
    return w.table("lineitem").select(y.alias("revision_id")).distinct().select("revision_id", F.when(F.col("revision_id") <= 8, 1).otherwise(2).cast("long").alias("context_id"), F.lit("shop").alias("domain_key"))


def _contexts(w):
    return w.spark.createDataFrame([(1, "main", None, None), (2, "branch", 1, 6)], "context_id bigint, name string, base_context_id bigint, base_revision_id bigint")


def visible_query(name: str, context: int, as_of: int, where: str):
    ORACLES[name] = f"SELECT DISTINCT year(l_shipdate) - 1990 AS revision_id FROM lineitem WHERE {where}"
    QUERIES[name] = lambda spark, d: temporal.visible_revisions(_revisions(World(spark, d)), _contexts(World(spark, d)), context, as_of)


visible_query("visible_revisions_root", 1, 0, "year(l_shipdate) - 1990 <= 8")
visible_query("visible_revisions_branch", 2, 0, "year(l_shipdate) - 1990 <= 6 OR year(l_shipdate) - 1990 > 8")
visible_query("visible_revisions_asof", 2, 9, "year(l_shipdate) - 1990 <= 6 OR year(l_shipdate) - 1990 = 9")


@query(f"WITH {VERSIONS} SELECT node_key, valid_from, trust_score FROM customers WHERE valid_from <= 8 AND (valid_to IS NULL OR valid_to > 8)", graph=False)
def graph_as_of(w):
    seen = temporal.visible_revisions(_revisions(w), _contexts(w), 1, 8)
    return temporal.as_of_view(_customers(w), seen).select("node_key", "valid_from", "trust_score")


@query(f"""WITH {VERSIONS}, lagged AS (SELECT *, lag(trust_score) OVER v AS t, lag(status) OVER v AS s, lag(valid_from) OVER v AS f FROM customers WINDOW v AS (PARTITION BY node_key ORDER BY valid_from))
SELECT valid_from AS revision_id, node_key, CASE WHEN f IS NULL THEN 'created' ELSE 'updated' END AS change_type FROM lagged WHERE f IS NULL OR trust_score IS DISTINCT FROM t OR status IS DISTINCT FROM s""", graph=False)
def changelog_by_diff(w):
    return temporal.changelog(_customers(w), "node_key", ["trust_score", "status"])


def _snapshots(w):
    return _revisions(w).where("revision_id % 3 <> 0").select((F.col("revision_id") * 10).alias("snapshot_id"), "revision_id", "domain_key")


@query("SELECT DISTINCT (year(l_shipdate) - 1990) * 10 AS snapshot_id, year(l_shipdate) - 1990 AS revision_id, CASE WHEN year(l_shipdate) - 1990 <= 8 THEN 'main' ELSE 'branch' END AS context_name FROM lineitem WHERE (year(l_shipdate) - 1990) % 3 <> 0", graph=False)
def snapshot_list(w):
    return temporal.snapshots_with_context(_snapshots(w), _revisions(w), _contexts(w)).select("snapshot_id", "revision_id", "context_name").orderBy(F.desc("snapshot_id"))


@query("SELECT 'shop' AS domain_key, max(year(l_shipdate) - 1990) * 10 AS snapshot_id FROM lineitem WHERE (year(l_shipdate) - 1990) % 3 <> 0", graph=False)
def latest_snapshot(w):
    return temporal.latest(_snapshots(w), "domain_key", "snapshot_id").select("domain_key", "snapshot_id")


@query("SELECT DISTINCT year(l_shipdate) - 1990 AS revision_id FROM lineitem WHERE (year(l_shipdate) - 1990) % 3 = 0", graph=False)
def abandoned_revisions(w):
    return temporal.without_snapshot(_revisions(w), _snapshots(w)).select("revision_id")


@query(f"WITH {VERSIONS} SELECT node_key, valid_from, status FROM customers WHERE valid_to IS NULL", graph=False)
def current_versions(w):
    return traverse.current(_customers(w), "node_key", "node_id").select("node_key", "valid_from", "status")


# --- insight ---------------------------------------------------------------------------------------------------------
def stats_query(name: str, kind: str, sql: str):
    ORACLES[name] = CTES + sql
    QUERIES[name] = lambda spark, d: (lambda w: insight.stats(w.nodes, w.drawn, "shop").where(F.col("kind") == kind).select("name", "n"))(World(spark, d))


stats_query("stats_by_layer", "layer", "SELECT layer AS name, count(*) AS n FROM nodes GROUP BY 1")
stats_query("stats_by_edge_type", "edge_type", "SELECT edge_type AS name, count(*) AS n FROM drawn GROUP BY 1")
stats_query("stats_by_derivation", "derivation", "SELECT derivation_kind AS name, count(*) AS n FROM drawn GROUP BY 1")


@query("SELECT e.edge_key, e.edge_type, a.name AS from_name, b.name AS to_name, round(confidence * 1e6) / 1e6 AS confidence FROM edges e JOIN nodes a ON a.node_key = from_node_key JOIN nodes b ON b.node_key = to_node_key WHERE active AND confidence < 0.6")
def low_confidence_edges(w):
    return insight.low_confidence(w.edges, w.nodes, 0.6).withColumn("confidence", R6("confidence"))


@query("SELECT node_key FROM nodes WHERE node_key NOT IN (SELECT node_key FROM evidence)")
def nodes_without_evidence(w):
    told = w.evidence.select(F.lit("node").alias("target_kind"), F.col("node_key").alias("target_key"))
    return insight.without_evidence(w.nodes, told).select("node_key")


@query("SELECT node_key FROM nodes WHERE node_type = 'provider' AND last_seen <> 2")
def modules_without_contains(w):
    holds = w.nodes.where("node_type = 'provider' and last_seen = 2").select(F.lit("CONTAINS").alias("edge_type"), F.lit(True).alias("active"), F.col("node_key").alias("from_node_key"))
    return insight.modules_without_contains(w.nodes, holds, module="provider").select("node_key")


@query("""SELECT 1 AS rule, (SELECT count(*) FROM edges WHERE active AND confidence > 0 AND confidence < 0.7) AS n UNION ALL SELECT 2, (SELECT count(*) FROM nodes WHERE layer <> 'service') UNION ALL SELECT 6, 1""")
def discovery_rules(w):
    told = w.evidence.select(F.lit("node").alias("target_kind"), F.col("node_key").alias("target_key"))
    every = w.table("supplier").select(F.lit("node").alias("target_kind"), F.concat(F.lit(SUPPLIER), "s_suppkey").alias("target_key"))
    return insight.discoveries(w.nodes, w.edges, told.unionAll(every)).select("rule", "n")


@query("""SELECT 5 AS rule, 'warning' AS severity, count(*) AS n FROM nodes WHERE node_type = 'service' AND last_seen > 2 UNION ALL SELECT 4, 'critical', count(*) FROM nodes WHERE node_type = 'controller'""")
def discovery_rules_by_type(w):
    """A part of the services as workers, which rule 5 doesn't count, and no edges to endpoints or services."""
    nodes = w.nodes.withColumn("node_type", F.when((F.col("layer") == "service") & (F.col("last_seen") <= 2), "worker").otherwise(F.col("node_type")))
    edges = w.drawn.where("edge_type in ('INJECTS', 'OWNED_BY')")
    found = insight.discoveries(nodes, edges, w.evidence.select("target_kind", "target_key"))
    return found.where("rule in (4, 5)").select("rule", "severity", "n")


@query("SELECT node_key, n.name, term, anti_pattern FROM nodes n JOIN (VALUES ('component', 'widget'), ('band', 'RING'), ('component', 'gizmo')) g(term, anti_pattern) ON contains(lower(n.name), lower(anti_pattern)) OR contains(n.node_key, lower(anti_pattern))")
def language_violations(w):
    glossary = w.spark.createDataFrame([("component", ["widget", "gizmo"]), ("band", ["RING"])], "term string, anti_patterns array<string>")
    return insight.language_violations(w.nodes, glossary)


METRICS = "count(*) AS calls, round(avg(value) * 1e3) / 1e3 AS avg_ms, sum(length(props))::BIGINT AS total_chars, max(length(props))::INT AS max_chars, count(*) FILTER (event_type = 'error') AS errors, round(sum(value) * 1e3) / 1e3 AS total_ms"


@query(f"SELECT {METRICS} FROM events", graph=False)
def request_stats(w):
    return insight.request_metrics(w.requests, []).select("calls", "total_chars", "max_chars", "errors", (F.round(F.col("total_ms") * 1e3) / 1e3).alias("total_ms"), (F.round(F.col("avg_ms") * 1e3) / 1e3).alias("avg_ms"))


@query(f"SELECT event_type AS tool_name, {METRICS} FROM events GROUP BY 1", graph=False)
def request_metrics_by_tool(w):
    return insight.request_metrics(w.requests, ["tool_name"]).select("tool_name", "calls", "total_chars", "max_chars", "errors", (F.round(F.col("total_ms") * 1e3) / 1e3).alias("total_ms"), (F.round(F.col("avg_ms") * 1e3) / 1e3).alias("avg_ms"))


#: Events one after another for each user: the next number, and the last ten errors as number and tool.
RETRIES = """WITH RECURSIVE s AS MATERIALIZED (SELECT user_id, event_id, event_type, event_id % 4 = 0 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
run AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS event_type, 0 AS next_seq, NULL::INT AS seq, NULL::INT AS again, []::STRUCT(n INT, t VARCHAR)[] AS errors FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, i, event_id, event_type, next_seq + 1 + (again IS NOT NULL)::INT, next_seq, again, CASE WHEN failed THEN list_slice(list_append(errors, {'n': next_seq, 't': event_type}), -10, -1) ELSE errors END
  FROM (SELECT s.user_id, s.i, s.event_id, s.event_type, s.failed, next_seq, errors, CASE WHEN NOT s.failed THEN [e.n FOR e IN errors IF e.t = s.event_type AND next_seq - e.n <= 3][1] END AS again FROM run JOIN s ON s.user_id = run.user_id AND s.i = run.i + 1))
SELECT user_id, event_id AS request_id, event_type AS tool_name, seq::INT AS seq, again::INT AS failed_seq FROM run WHERE again IS NOT NULL"""


def _failing(w):
    return w.requests.withColumn("error_message", F.when(F.col("request_id") % 4 == 0, "failed"))


@query(RETRIES, graph=False)
def retry_detection(w):
    return insight.retries(_failing(w), "user_id")


@query("SELECT count(*) AS calls, avg(length(props)) AS avg_chars, max(length(props))::INT AS max_chars FROM events WHERE event_type = 'click'", graph=False)
def metrics_of_one_tool(w):
    return insight.metrics_of(w.requests, "click")


@query("SELECT event_id AS request_id, CASE event_id % 3 WHEN 0 THEN json_array_length('[' || event_id || ',' || user_id || ']') || ' items' WHEN 1 THEN len(json_keys(props)) || ' keys' ELSE '' END AS summary FROM events", graph=False)
def result_summaries(w):
    result = F.when(F.col("request_id") % 3 == 0, F.concat(F.lit(" ["), "request_id", F.lit(","), "user_id", F.lit("]"))).when(F.col("request_id") % 3 == 1, F.col("params_json")).otherwise("no json")
    return insight.summaries(w.requests.withColumn("result_json", result))


@query("SELECT DISTINCT a || '->' || b || ':' || edge_type AS edge_key FROM drawn WHERE edge_type IN ('OWNED_BY', 'DEPENDS_ON_DOMAIN')")
def domain_subgraph(w):
    # owners as a domain of their own: edges that touch them on either end
    nodes = w.nodes.withColumn("domain_key", F.when(F.col("layer") == "ownership", "owners").otherwise(F.col("domain_key")))
    return insight.touching(w.drawn, nodes, "owners").select("edge_key")


# --- streams ---------------------------------------------------------------------------------------------------------
@query("SELECT event_id, event_type FROM events WHERE event_id > 500", graph=False)
def stream_requests_tail(w):
    folder, source = own_folder(w.spark, "stream"), w.table("events")
    source.write.parquet(f"{folder}/log")
    sink = lambda batch, n: batch.select("event_id", "event_type").write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    streams.tail(w.spark, f"{folder}/log", source.schema, f"{folder}/checkpoint", sink, after=500, once=True, key="event_id").awaitTermination()
    return _taken(w, folder, "event_id", "event_type")


def _taken(w, folder: str, *columns: str) -> DataFrame:
    """What a stream wrote below its folder, which goes."""
    rows = cut(w.spark.read.parquet(f"{folder}/out").select(*columns))
    remove(w.spark, folder)
    return rows


@query(f"SELECT CASE WHEN {CHANGED} THEN 'stale' ELSE status END AS status, count(*) AS n FROM evidence GROUP BY ALL")
def stream_invalidate(w):
    folder = own_folder(w.spark, "stream")
    _changed(w).select(F.lit(1).cast("long").alias("revision"), "file_path").write.parquet(f"{folder}/changes")
    write = lambda after, judged: after.groupBy("status").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/out")
    streams.invalidate_changed(w.spark, f"{folder}/changes", f"{folder}/checkpoint", lambda: w.evidence, write, once=True).awaitTermination()
    return _taken(w, folder, "status", "n")


@query(RETRIES, graph=False)
def stream_retries(w):
    """The log in two batches, in order: what sessions remember goes on from one to the other."""
    folder, rows = own_folder(w.spark, "stream"), _failing(w).select("request_id", "user_id", "tool_name", "error_message")
    half = rows.agg(F.max("request_id")).first()[0] // 2
    for n, part in enumerate((rows.where(F.col("request_id") <= half), rows.where(F.col("request_id") > half))):
        part.write.mode("append").parquet(f"{folder}/log")
        sink = lambda batch, i, n=n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}-{i}")
        streams.retries(w.spark.readStream.schema(rows.schema).parquet(f"{folder}/log"), "user_id", sink, f"{folder}/checkpoint", once=True).awaitTermination()
    return _taken(w, folder, "user_id", "request_id", "tool_name", "seq", "failed_seq")


@query("SELECT 'missing_edge' AS category, count(*)::INT AS n FROM region WHERE r_regionkey < 3 UNION ALL SELECT 'missing_edge', count(*)::INT FROM region", graph=False)
def stream_import_discoveries(w):
    """Two payload files with nodes that nothing tells of; after each, the nodes without evidence are counted."""
    folder = own_folder(w.spark, "stream")
    store = GraphStore(w.spark, f"{folder}/graph")
    node = F.struct(F.concat(F.lit("ownership:domain:shop:region-"), "r_regionkey").alias("node_key"), F.lit("ownership").alias("layer"), F.lit("domain").alias("node_type"), F.lit("shop").alias("domain_key"), F.col("r_name").alias("name"))
    none = lambda name: F.array().cast(PAYLOAD[name]).alias(name)
    files = w.table("region").groupBy(F.floor(F.col("r_regionkey") / 3).alias("part")).agg(F.collect_list(node).alias("nodes")).select("part", "nodes", none("edges"), none("evidence"), none("aliases"))
    files.repartition(1).write.partitionBy("part").json(f"{folder}/in")
    streams.import_payloads(store, f"{folder}/in/*", f"{folder}/checkpoint", once=True, clock="2024-01-01 00:00:00").awaitTermination()
    found = lookup.discoveries(store.table("discoveries"), "shop", "missing_edge").select("category", F.regexp_extract("title", r"^rule 2: (\d+)$", 1).try_cast("int").alias("n")).where("n is not null")
    found.write.parquet(f"{folder}/out")
    return _taken(w, folder, "category", "n")


__all__ = ["BRAND", "ORACLES", "ORDER", "QUERIES"]
