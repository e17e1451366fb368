"""Small graphs with known answers, and the random check of the two ordering rules."""

from __future__ import annotations

import itertools
import json
import os
import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from archloom.functions import keys
from archloom.operators import insight, ledger, lookup, mutate, paths, temporal, traverse, trust, validate
from archloom.plans.queries import QUERIES
from archloom.schema import TABLES
from archloom.session import own_folder, shared_dir
from archloom.sources import payload
from archloom.sources.projection import BRAND, PART, World
from archloom.sources.registry import Manifest, Registry
from archloom.store import Busy, GraphStore, ImportFailed

REGISTRY = Registry.load()
A, B, C, D = (f"code:provider:x:{c}" for c in "abcd")
SHELF, WEB, CART, PRICE, STOCK, DEPOT, PAGE = (f"code:provider:x:{c}" for c in "shelf web cart price stock depot page".split())
SHOP = [(SHELF, WEB, "CONTAINS", "hard"), (WEB, CART, "INJECTS", "hard"), (WEB, PRICE, "IMPORTS", "linked"), (CART, STOCK, "INJECTS", "hard"), (PRICE, STOCK, "INJECTS", "hard"), (STOCK, DEPOT, "CALLS_SERVICE", "linked"), (WEB, PAGE, "EXPOSES_ENDPOINT", "hard")]
BASE = {"hard": 0.5, "linked": 0.4}


def graph(spark, rows):
    edges = spark.createDataFrame([(f"{a}->{b}:{t}", a, b, t, d, True, BASE[d], BASE[d]) for a, b, t, d in rows], "edge_key string, from_node_key string, to_node_key string, edge_type string, derivation_kind string, active boolean, confidence double, trust_score double")
    names = sorted({x for r in rows for x in r[:2]})
    nodes = spark.createDataFrame([(n, n.rsplit(":", 1)[1], n.split(":")[0], n.split(":")[1], "x", "active", 0.0, 0.0) for n in names], "node_key string, name string, layer string, node_type string, domain_key string, status string, trust_score double, freshness double")
    return nodes, edges


def test_registry_and_manifest():
    assert len(REGISTRY.edge_types) == 44 and len(REGISTRY.structural) == 10 and len(REGISTRY.no_reverse) == 4
    assert not REGISTRY.reverse_allowed("CONTAINS") and not REGISTRY.reverse_allowed("EXPOSES_ENDPOINT") and REGISTRY.reverse_allowed("INJECTS")
    with pytest.raises(ValueError, match="unknown layers"):
        Registry.parse("layers: [code]\nnode_types: {cloud: [x]}\nedge_types: {}\nderivation_kinds: []\nsource_kinds: []\nnode_statuses: []\ntrigger_kinds: []")
    own = Registry.parse("version: '1'\nlayers: [code, data]\nnode_types: {code: [module]}\nedge_types:\n  READS: {from_layers: [code], to_layers: [data, code]}\n  HOLDS: {from_layers: [code], to_layers: [code]}\ntraversal_policy: {structural_edge_types: [HOLDS], no_reverse_impact: [READS]}")
    assert own.edge_types["READS"] == ({"code"}, {"data", "code"}) and own.forward_allowed("READS") and not own.forward_allowed("HOLDS") and not own.reverse_allowed("READS")
    assert Manifest.parse("domain: d\nrepositories: [{name: a, path: b}]").domain == "d"
    with pytest.raises(ValueError, match="domain"):
        Manifest.parse("repositories: [{name: a, path: b}]")


def test_keys(spark):
    cases = {" Code:Provider:X:Thing ": "code:provider:x:thing", "code:endpoint:x:/get:/a/": "code:endpoint:x:get:/a", "code:provider:x:": None, "code:provider:x": None, "code::x:y": None, "code:provider: x : a:b:c ": "code:provider:x:a:b:c", "code:provider:x:33": "code:provider:x:33"}
    rows = spark.createDataFrame(list(cases.items()), "raw string, want string").select("want", keys.node_key(F.col("raw")).alias("got"))
    assert all(r.got == r.want for r in rows.collect())
    edge = spark.createDataFrame([("A:b:c:D->a:b:c:e:f:TYPE",), ("no arrow",), ("a:b:c:d->a:b:c:e:",)], "raw string").select(keys.edge_key(F.col("raw")).alias("k"))
    assert [r.k for r in edge.collect()] == ["a:b:c:d->a:b:c:e:f:TYPE", None, None]
    ints = spark.createDataFrame([("12",), ("12abc",), ("",), (" -3",), (None,), ("x",)], "raw string").select(keys.lenient_int(F.col("raw")).alias("n"))
    assert [r.n for r in ints.collect()] == [12, 12, 0, -3, 0, 0]


def test_deps(spark):
    nodes, edges = graph(spark, SHOP)
    got = traverse.deps(nodes, edges, WEB, 2).orderBy("depth", "via").collect()
    assert [(r.node_key, r.depth) for r in got] == [(CART, 1), (PAGE, 1), (PRICE, 1), (STOCK, 2)]
    assert got[-1].via == f"{WEB}->{CART}:INJECTS|{CART}->{STOCK}:INJECTS"
    assert traverse.deps(nodes, edges, SHELF, 1).first().node_key == WEB  # structural edges are walked
    assert {r.node_key for r in traverse.deps(nodes, edges, DEPOT, 9, reverse=True).collect()} == {STOCK, CART, PRICE, WEB, SHELF}
    assert {r.node_key for r in traverse.deps(nodes, edges, WEB, 9, derivations=("hard",)).collect()} == {CART, PAGE, STOCK}
    assert traverse.deps(nodes, edges, WEB, 0).count() == 0
    with pytest.raises(LookupError):
        traverse.deps(nodes, edges, "code:provider:x:none", 1)


def test_impact(spark, monkeypatch):
    nodes, edges = graph(spark, SHOP)
    found = traverse.impact(nodes, edges, REGISTRY, DEPOT, 5)
    got = {r.node_key: (r.depth, r.score, r.trust_chain) for r in found.nodes.collect()}
    assert got == {STOCK: (1, 40.0, 0.4), CART: (2, 19.0, 0.2), PRICE: (2, 19.0, 0.2), WEB: (3, 9.03, 0.1)}  # the container isn't hit
    assert found.max_depth_reached == 3
    assert [(r.target_key, r.exposed_by, r.kind) for r in found.surface.collect()] == [(PAGE, WEB, "endpoint")]
    high = traverse.impact(nodes, edges, REGISTRY, DEPOT, 5, min_score=15)
    assert high.nodes.count() == 3 and high.max_depth_reached == 3
    own = traverse.impact(nodes, edges, REGISTRY, WEB, 4)
    assert own.nodes.count() == 0 and own.surface.first().exposed_by == "(changed)"
    monkeypatch.setattr(traverse, "SMALL_FRONTIER", 0)  # frontiers are shuffled, not broadcast
    same = traverse.impact(nodes, edges, REGISTRY, DEPOT, 5, include_structural=True)
    assert {r.node_key: (r.depth, r.score, r.trust_chain) for r in same.nodes.collect()} == got


def test_paths(spark):
    _, edges = graph(spark, SHOP)
    got = paths.paths(edges, REGISTRY, WEB, DEPOT, 6).collect()
    assert [(r.depth, r.cost, r.score, r.total_found) for r in got] == [(3, 2.4526, 0.0903, 2), (3, 2.6757, 0.0722, 2)]
    assert paths.paths(edges, REGISTRY, WEB, DEPOT, 6, derivations=("hard",)).count() == 0
    assert paths.paths(edges, REGISTRY, DEPOT, WEB, 6).count() == 0 and paths.paths(edges, REGISTRY, DEPOT, WEB, 6, connected=True).count() == 2
    assert paths.paths(edges, REGISTRY, WEB, WEB, 6).count() == 0
    assert paths.paths(edges, REGISTRY, SHELF, CART, 6).count() == 0 and paths.paths(edges, REGISTRY, SHELF, CART, 6, structural=True).count() == 1
    topic = "contract:topic:x:sold"
    _, edges = graph(spark, [(CART, topic, "PUBLISHES_TOPIC", "hard"), (PRICE, topic, "CONSUMES_TOPIC", "linked"), (PRICE, STOCK, "INJECTS", "hard")])
    got = paths.paths(edges, REGISTRY, CART, STOCK, 4).collect()
    assert [(r.depth, r.cost, r.score, r.types) for r in got] == [(3, 2.4526, 0.0903, "PUBLISHES_TOPIC,CONSUMES_TOPIC,INJECTS")]


def _queue_walk(edges, start, depth):
    out, seen, queue = {}, {start}, deque([(start, 0, ())])
    while queue:
        at, d, via = queue.popleft()
        if d < depth:
            for key, a, b in sorted(edges):
                if a == at and b not in seen:
                    seen.add(b)
                    out[b] = (d + 1, via + (key,))
                    queue.append((b, d + 1, via + (key,)))
    return out


def _queue_paths(edges, start, end, depth):
    out, queue = [], deque([(start, (start,), ())])
    while queue:
        at, nodes, via = queue.popleft()
        if len(via) < depth:
            for key, a, b in sorted(edges):
                if a == at and b not in nodes:
                    if b == end:
                        out.append(via + (key,))
                    else:
                        queue.append((b, nodes + (b,), via + (key,)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_orders_equal_a_queue(spark, seed):
    rng = random.Random(seed)
    names = [f"code:provider:x:{i:02d}" for i in range(40)]
    rows = sorted({(rng.choice(names), rng.choice(names), rng.choice(["INJECTS", "IMPORTS"]), "hard") for _ in range(110)})
    rows = [r for r in rows if r[0] != r[1]]
    nodes, edges = graph(spark, rows)
    plain = [(f"{a}->{b}:{t}", a, b) for a, b, t, _ in rows]
    start = rows[0][0]
    got = {r.node_key: (r.depth, tuple(r.via.split("|"))) for r in traverse.deps(nodes, edges, start, 4).collect()}
    assert got == _queue_walk(plain, start, 4)
    end = next(k for k, v in sorted(got.items()) if v[0] >= 2)
    want = _queue_paths(plain, start, end, 4)[:50]
    cost = lambda p: round((sum(-__import__("math").log(0.5) for _ in p) + 0.05 * len(p)) * 1e4) / 1e4
    found = paths.paths(edges, REGISTRY, start, end, 4, top_k=5)
    assert found.first().total_found == len(want)
    assert sorted(round(r.cost, 4) for r in found.collect()) == sorted(cost(p) for p in want)[:5]


def test_trust(spark):
    rows = [("two", "positive", "valid", "file", 0.95), ("two", "positive", "valid", "prisma", 0.95), ("stale", "positive", "valid", "file", 0.95), ("stale", "positive", "stale", "file", 0.8), ("neg", "positive", "valid", "file", 0.95), ("neg", "negative", "valid", "file", 0.92), ("hook", "positive", "revalidated", "webhook", 0.99), ("old", "positive", "stale", "file", 0.9), ("weak", "negative", "valid", "file", 0.3)]
    got = {r.k: r for r in trust.trust(spark.createDataFrame(rows, "k string, polarity string, status string, source_kind string, confidence double"), ["k"]).collect()}
    assert got["two"].positive == pytest.approx(0.9975) and got["two"].confidence == 0.92 and got["two"].status == "active"
    assert got["stale"].freshness == 0.6 and got["stale"].trust_score == pytest.approx(0.85 * 0.6)
    assert got["neg"].trust_score == 0 and got["neg"].status == "contradicted"
    assert got["hook"].confidence == 0.65 and got["old"].status == "stale" and got["old"].trust_score == 0
    assert got["weak"].status == "removed" and got["weak"].freshness == 0


def _payload(spark, tmp_path, **parts):
    path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
    path.write_text(json.dumps({"nodes": [], "edges": [], "evidence": [], "aliases": []} | parts))
    return payload.read(spark, str(path))


def node(key):
    layer, kind, domain, name = key.split(":", 3)
    return {"node_key": key, "layer": layer, "node_type": kind, "domain_key": domain, "name": name}


def edge(a, b, kind="INJECTS"):
    return {"from_node_key": a, "to_node_key": b, "edge_type": kind, "from_layer": "code", "to_layer": "code"}


def test_import(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"))
    folder = tmp_path / "in"
    folder.mkdir()
    seen = {"target_kind": "node", "node_key": A, "source_kind": "file", "file_path": "a.py", "line_start": "12abc", "extractor_id": "x", "extractor_version": "1", "confidence": 0.99}
    full = {"nodes": [node(A), node(B)], "edges": [edge(A, B)], "evidence": [seen, seen | {"source_kind": "nonsense"}], "aliases": [{"node_key": A, "alias": " Al ", "alias_kind": "short"}, {"node_key": A, "alias": "", "alias_kind": "short"}]}
    assert store.import_payload(_payload(spark, folder, **full)) == {"nodes": 2, "edges": 1, "evidence": 1, "aliases": 1}
    a, b = store.table("nodes").orderBy("node_key").collect()
    assert a.trust_score == pytest.approx(0.85) and b.trust_score == 0.0
    assert store.table("edges").first().trust_score == 0.5 and store.table("evidence").first().line_start == 12
    store.import_payload(_payload(spark, folder, **full))
    assert store.table("nodes").count() == 2 and store.table("evidence").count() == 1 and store.table("aliases").count() == 1
    with pytest.raises(ImportFailed, match=r"edges\[1\]"):
        store.import_payload(_payload(spark, folder, nodes=[node(C)], edges=[edge(A, B), edge(A, D)]))
    assert store.table("nodes").count() == 2  # nothing of a failed import stays
    with pytest.raises(ImportFailed, match=r"nodes\[1\]: unknown layer"):
        store.import_payload(_payload(spark, folder, nodes=[node(C), node("cloud:x:y:z")]))
    store.reset()
    assert store.table("nodes").count() == 0


def test_evidence_cycle(spark):
    empty = spark.createDataFrame([], TABLES["evidence"])
    row = [("edge", "e", "file", "r", "f.py", 1, "x", "positive", 0.95, "c", "1", 0)]
    schema = "target_kind string, target_key string, source_kind string, repo_name string, file_path string, line_start int, extractor_id string, polarity string, confidence double, commit_sha string, extractor_version string, position int"
    given = spark.createDataFrame(row, schema)
    once = mutate.upsert_evidence(empty, given)
    files = spark.createDataFrame([("f.py",)], "file_path string")
    gone = mutate.invalidate(once, files)
    assert gone.first().status == "stale" and mutate.stale_files(gone).first().file_path == "f.py"
    assert mutate.upsert_evidence(gone, given).first().status == "revalidated"
    assert mutate.upsert_evidence(gone, given.unionAll(given)).first().status == "valid"
    both = mutate.invalidate(once, files, revision=7).orderBy("evidence_id").collect()
    assert sorted((r.status, r.valid_to) for r in both if r.valid_to) == [("valid", 7)] and len(both) == 2


def test_versions_and_visibility(spark):
    versions = spark.createDataFrame([(1, "k", "a", 1, None)], "node_id bigint, node_key string, layer string, valid_from bigint, valid_to bigint")
    incoming = spark.createDataFrame([("k", "a"), ("n", "b")], "node_key string, layer string")
    after = mutate.upsert(versions, incoming, "node_key", "node_id", revision=5, fixed=("layer",))
    assert sorted((r.node_key, r.valid_from, r.valid_to or 0) for r in after.collect()) == [("k", 1, 5), ("k", 5, 0), ("n", 5, 0)]
    with pytest.raises(ValueError, match="cannot change"):
        mutate.upsert(versions, incoming.withColumn("layer", F.lit("z")), "node_key", "node_id", fixed=("layer",))
    revisions = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 1)], "revision_id bigint, context_id bigint")
    contexts = spark.createDataFrame([(1, None, None), (2, 1, 2)], "context_id bigint, base_context_id bigint, base_revision_id bigint")
    seen = lambda *a: sorted(r.revision_id for r in temporal.visible_revisions(revisions, contexts, *a).collect())
    assert seen(1) == [1, 2, 4] and seen(1, 2) == [1, 2] and seen(2) == [1, 2, 3] and seen(2, 1) == [1, 2]
    log = temporal.changelog(after.withColumn("fact", F.col("valid_from")), "node_key", ["fact"])
    assert sorted((r.node_key, r.revision_id, r.change_type) for r in log.collect()) == [("k", 1, "created"), ("k", 5, "updated"), ("n", 5, "created")]


def test_equal_keys_in_a_batch(spark):
    table = spark.createDataFrame([(1, "k", "a", "old", 1, 1, None, None)], "node_id bigint, node_key string, layer string, name string, first_seen bigint, last_seen bigint, valid_from bigint, valid_to bigint")
    batch = lambda *rows: spark.createDataFrame(list(rows), "position int, node_key string, layer string, name string, first_seen bigint, last_seen bigint")
    after = mutate.upsert(table, batch((0, "k", "a", "z", 9, 9), (1, "k", "a", "b", 9, 9), (2, "n", "a", "x", 9, 9)), "node_key", "node_id", fixed=("layer",))
    assert sorted((r.node_key, r.name, r.first_seen, r.last_seen) for r in after.collect()) == [("k", "b", 1, 9), ("n", "x", 9, 9)]
    with pytest.raises(ValueError, match="of n cannot change"):
        mutate.upsert(table, batch((0, "n", "a", "x", 9, 9), (1, "n", "b", "x", 9, 9)), "node_key", "node_id", fixed=("layer",))


@pytest.mark.parametrize("few", [500, 1])
def test_language_violations(spark, monkeypatch, few):
    monkeypatch.setattr(insight, "FEW_PATTERNS", few)
    nodes = spark.createDataFrame([("code:a:x:Wid.get", "Wid.get (old)"), ("code:a:x:b", None), ("code:a:x:widxget", "gadget"), ("k", "ÄRGER")], "node_key string, name string")
    glossary = spark.createDataFrame([("part", ["wid.GET", "(OLD"]), ("item", ["gadget", "x:b", None]), ("joy", ["ärger"]), ("none", [])], "term string, anti_patterns array<string>")
    got = sorted((r.node_key, r.anti_pattern) for r in insight.language_violations(nodes, glossary).collect())
    assert got == [("code:a:x:Wid.get", "(OLD"), ("code:a:x:Wid.get", "wid.GET"), ("code:a:x:b", "x:b"), ("code:a:x:widxget", "gadget"), ("k", "ärger")]
    assert insight.language_violations(nodes, glossary.limit(0)).count() == 0


def _retries(calls):
    """Retries of one session by the rules, written out: (tool, failed) in order."""
    seq, errors, out = 0, [], []
    for i, (tool, bad) in enumerate(calls):
        if bad:
            errors = (errors + [(seq, tool)])[-10:]
        else:
            hit = [n for n, t in errors if t == tool and seq - n <= 3]
            if hit:
                out.append((i, seq, hit[0]))
                seq += 1
        seq += 1
    return out


def test_retries(spark):
    rng = random.Random(5)
    logs = {u: [(rng.choice("ab"), rng.random() < 0.5) for _ in range(60)] for u in range(4)}
    rows = [(u, u * 1000 + i, tool, "failed" if bad else ["", None][i % 2]) for u, log in logs.items() for i, (tool, bad) in enumerate(log)]
    frame = spark.createDataFrame(rows, "user_id bigint, request_id bigint, tool_name string, error_message string")
    got = sorted((r.user_id, r.request_id - r.user_id * 1000, r.seq, r.failed_seq) for r in insight.retries(frame, "user_id").collect())
    assert got == sorted((u, *x) for u, log in logs.items() for x in _retries(log)) and len(got) > 20


def test_store_records(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"))
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    main = store.create_context("x", "main", "main")
    assert store.create_revision("x", "abc", context=main) == 1 and store.create_revision("x", "def", trigger="manual", context=main) == 2
    with pytest.raises(ledger.Taken):
        store.create_revision("x", "abc")
    with pytest.raises(ValueError, match="unknown trigger"):
        store.create_revision("x", "ghi", trigger="whim")
    store.move_context(main, 2, "def")
    head = lookup.context_by_ref(store.table("contexts"), "x", "main").first()
    assert (head.head_revision_id, head.head_commit_sha) == (2, "def")
    store.archive_context(main)
    assert lookup.context_by_ref(store.table("contexts"), "x", "main").count() == 0
    with pytest.raises(LookupError):
        store.archive_context(99)
    assert store.create_snapshot(2, "x", clock="2024-01-01 00:00:00") == 1
    payload_rows = [{"position": 0, **node(A), "status": "", "metadata": "", "confidence": 0.0}, {"position": 1, **node(B), "status": "", "metadata": "", "confidence": 0.0}]
    store.upsert_nodes(spark.createDataFrame(payload_rows), 1)
    store.upsert_nodes(spark.createDataFrame(payload_rows[:1]), 2, version=2, context=main)
    versions = store.table("nodes").where(F.col("node_key") == A).orderBy("node_id").collect()
    assert [(r.valid_from, r.valid_to, r.first_seen) for r in versions] == [(None, 2, 1), (2, None, 2)]
    link = {"position": 0, **edge(A, B), "edge_key": "", "derivation_kind": "linked", "confidence": 0.9, "metadata": ""}
    store.upsert_edges(spark.createDataFrame([link]), 2)
    assert store.table("edges").first().trust_score == 0.4
    with pytest.raises(ImportFailed, match="to node not found"):
        store.upsert_edges(spark.createDataFrame([link | {"to_node_key": C}]))
    seen = {"position": 0, "target_kind": "node", "node_key": A, "edge_key": "", "source_kind": "file", "repo_name": "r", "file_path": "a.py", "line_start": 1, "line_end": 2, "extractor_id": "x", "extractor_version": "1", "commit_sha": "", "confidence": 0.0, "polarity": "positive"}
    store.add_evidence(spark.createDataFrame([seen]), 2)
    with pytest.raises(ImportFailed, match="unknown source kind"):
        store.add_evidence(spark.createDataFrame([seen | {"source_kind": "rumour"}]))
    with pytest.raises(ImportFailed, match="target not found"):
        store.add_evidence(spark.createDataFrame([seen | {"node_key": C}]))
    assert sorted((r.valid_to or 0, round(r.trust_score, 2)) for r in store.table("nodes").where(F.col("node_key") == A).collect()) == [(0, 0.85), (2, 0.0)]
    store.put_setting("mode", "a")
    store.put_setting("mode", "b")
    store.put_diagram("d1", "{}")
    assert lookup.setting(store.table("settings"), "mode") == "b" and lookup.diagrams(store.table("diagram_sessions")).count() == 1
    status = store.scan_status("x")
    assert status == {"nodes": 2, "edges": 1, "revision_id": 2, "commit": "def", "snapshot_id": 1}
    assert {r.rule for r in store.discover("2024-01-01 00:00:00").collect()} >= {1, 2} and store.table("discoveries").count() >= 2
    store.delete_node(B)
    assert store.mark_stale("x", 9) == (2, 1)  # all versions of a node
    store.log_changes(rows([(1, 2, "node", A, "updated")], "context_id bigint, revision_id bigint, entity_type string, entity_key string, change_type string"))
    assert lookup.changes(store.table("changelog"), 1, A, 1, 2).count() == 1 and lookup.changes(store.table("changelog"), 1, A, 3).count() == 0
    store.reset()
    assert store.table("settings").count() == 0 and store.table("diagram_sessions").count() == 1


def test_one_writer_at_a_time(spark, tmp_path):
    store, other = (GraphStore(spark, str(tmp_path / "graph")) for _ in range(2))
    with store._change(), pytest.raises(Busy):
        other.put_setting("a", "b")
    other.put_setting("a", "b")
    assert lookup.setting(store.table("settings"), "a") == "b"


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark) and own_folder(spark, "x") != own_folder(spark, "x")


def test_resolve_and_checks(spark):
    nodes, edges = graph(spark, SHOP + [(WEB, "service:service:x:web", "CALLS_SERVICE", "hard")])
    assert insight.resolve(nodes, WEB) == WEB and insight.resolve(nodes, "shel") == SHELF
    with pytest.raises(LookupError, match="no node"):
        insight.resolve(nodes, "zzz")
    assert validate.integrity(nodes.withColumn("confidence", F.lit(0.5)), edges).count() == 0
    assert {r.rule for r in insight.discoveries(nodes, edges, spark.createDataFrame([], "target_kind string, target_key string")).collect()} >= {1, 2}
    empty = [f.limit(0) for f in (nodes, edges)]
    assert insight.stats(*empty).count() == 0 and list(itertools.chain(insight.touching(empty[1], empty[0], "x").collect())) == []


def test_keys_in_normal_form_are_the_long_way_s(spark):
    """Keys that are taken as they are, and near ones that aren't, come out as normalisation part by part makes them."""
    ends = ["a:b:c:d", "a:b:c:d:e", "a:b:c:/d", "a:b:c:d/", "a:b:c:d/e", "a:b:c:/", "a:b:c", "a::c:d", "A:b:c:d", " a:b:c:d", "a:b: c:d", "a:b:c:d e", "a:b:c:é", "a:b:c:É", "a:b:c:x->y", "a:b:c:x>y", "a:b:c:d-", "a:b:c:d\n", "a:b:c:d/\n", "a/b:/b:c/:d", "", ":", "a:b:c:/ /d"]
    rows = [(e,) for e in ends] + [(f"{a}->{b}{k}",) for a in ends for b in ends for k in (":T", ":t", "", ":", ": T ", ":T\n")] + [(None,)]
    raw = spark.createDataFrame(rows, "raw string")

    def node(text):
        parts = [p.strip(" ") for p in text.strip(" ").lower().split(":", 3)]
        last = re.sub("^/+|/+(?=\n?\\Z)", "", parts[-1]).strip(" ")
        return ":".join([*parts[:3], last]) if len(parts) == 4 and all(parts[:3]) and last else None

    def edge(text):
        a, arrow, rest = text.strip(" ").partition("->")
        b, colon, kind = rest.rpartition(":")
        whole = (node(a), node(b), kind.strip(" "))
        return f"{whole[0]}->{whole[1]}:{whole[2]}" if arrow and colon and all(whole) else None

    for r in raw.select("raw", keys.node_key(F.col("raw")).alias("n"), keys.edge_key(F.col("raw")).alias("e")).collect():
        assert (r.n, r.e) == ((None, None) if r.raw is None else (node(r.raw), edge(r.raw))), r.raw
    # each step of normalisation is written a few times only, and so computed as seldom
    plan = spark.range(1).select(keys.edge_key(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 4


def test_steps_at_few_nodes_are_looked_up_alone(spark):
    """Only active edges at the nodes asked for are written, and trust is joined to no edge that has no evidence."""
    rows = [(A, B, "INJECTS", True), (A, C, "INJECTS", False), (B, C, "INJECTS", True)]
    frame = spark.createDataFrame(rows, "a string, b string, edge_type string, active boolean")
    got = traverse.Steps(frame).at("a", spark.createDataFrame([(A,)], "_at string"), 1)
    assert [tuple(r) for r in got.collect()] == [(A, B, "INJECTS")]
    plan = World(spark, "/root/testdata/sf0.001").edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_a_batch_is_validated_once(spark, tmp_path):
    """Steps behind validation read what it wrote: rows that are made anew at each reading keep their values, and columns
    without a type may be written."""
    store = GraphStore(spark, str(tmp_path / "g"))
    rows = spark.range(20).select(F.col("id").alias("position"), F.rand().alias("drawn"), F.lit(None).alias("note"), F.lit(None).cast("string").alias("error"))
    checked = store._checked(rows, "nodes")
    assert sorted(checked.collect()) == sorted(checked.collect()) and checked.select("drawn").distinct().count() == 20
    assert checked.where("note is null").count() == 20 and "rand" not in checked._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_by_domain(spark):
    """Targets that aren't there, other kinds, repeated keys and null ones; the same counts by numbers. Edges
    aren't sorted before they are dealt out."""
    nodes = spark.createDataFrame([("a", "x"), ("a", "w"), ("b", "y"), (None, "z")], "node_key string, domain_key string")
    edges = spark.createDataFrame([("e", "b"), ("e", "a"), ("f", "b"), ("g", "lost"), (None, "a")], "edge_key string, from_node_key string")
    told = [("edge", "e", "valid")] * 2 + [("edge", k, "valid") for k in ("f", "g", "none", None)] + [("node", "a", "stale"), ("node", "e", "stale"), ("node", None, "stale"), ("team", "a", "stale"), (None, "a", None)]
    evidence = spark.createDataFrame(told, "target_kind string, target_key string, status string")
    found = insight.evidence_by_domain(evidence, nodes, edges)
    assert {tuple(r) for r in found.collect()} == {("w", "valid", 2), ("y", "valid", 1), (None, "valid", 3), ("w", "stale", 1), (None, "stale", 3), (None, None, 1)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    numbers = spark.createDataFrame([(1, 1), (1, 1), (1, None), (None, 1)], "p int, s int")
    got = insight.told_by_start(numbers.withColumn("status", F.lit("valid")), numbers.distinct(), ["p", "s"], "p")
    assert {tuple(r) for r in got.collect()} == {(1, "valid", 2), (None, "valid", 2)}


def test_evidence_of_calls_is_counted_by_numbers(spark):
    """Only the lines' calls and the nodes that they start from are dealt out: no edge of another type, no key of an edge."""
    plan = QUERIES["finalize_domain"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "CONSUMES_TOPIC" not in plan and "CALLS_SERVICE" not in plan


def test_numbers_that_keys_end_in(spark):
    """A value and the key that it makes have one number, or -1: no row is missed that is found by numbers first."""
    values = [0, 7, 99, -7, 10**17, 10**17 + 1, 2**63 - 1, -(2**63), None]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = {r.v: (r.a, r.b) for r in rows.select("v", keys.as_number(F.col("v")).alias("a"), keys.number_of(F.concat(F.lit(PART), "v")).alias("b")).collect()}
    assert all(a in (-1, b) for a, b in got.values()) and got[99] == (99, 99) and got[-7][0] == -1
    text = spark.createDataFrame([("brand#12",), ("x",), ("",), ("1" * 19,), ("12",)], "v string")
    assert [tuple(r) for r in text.select(keys.as_number(F.col("v")), keys.number_of(F.col("v"))).collect()] == [(-1, 12), (-1, -1), (-1, -1), (-1, -1), (-1, 12)]


def test_edges_are_found_by_numbers_before_keys_and_trust(spark):
    """What World.edges_at and drawn_at find at nodes is what all edges have there, and lines are told before they are grouped."""
    w = World(spark, "/root/testdata/sf0.001")
    some = w.edges.orderBy(F.xxhash64("edge_key")).limit(12).select("from_node_key", "to_node_key").collect()
    for column in ("from_node_key", "to_node_key"):
        nodes = spark.createDataFrame([(r[column],) for r in some] + [("ownership:team:shop:nation-3",), (f"{BRAND}brand#12",)], "_at string").distinct()
        for whole, at in ((w.edges, w.edges_at), (w.drawn, w.drawn_at)):
            want, got = (sorted(map(repr, f.join(nodes, F.col(column) == F.col("_at"), "left_semi").select(whole.columns).collect())) for f in (whole, at(column, nodes)))
            assert got == want and len(want) > 2
        plan = w.edges_at(column, nodes)._jdf.queryExecution().optimizedPlan().toString()
        trusted = plan[plan.index("product("):]
        assert trusted.index("Join LeftSemi") < trusted.index("Relation")


def test_evidence_is_upserted_in_one_join(spark):
    """Null parts of an identity are alike, closed rows stay, all open rows of an identity are hit, new ones get numbers of
    their own; the stored rows are dealt out once."""
    def stored(number, line, status, closed=None, repo="r"):
        return (number, "edge", "e", "file", repo, "f", line, 5, "x", "0", "old", 0.1, "positive", status, 1, 1, closed, 3)

    names = "evidence_id target_kind target_key source_kind repo_name file_path line_start line_end extractor_id extractor_version commit_sha confidence polarity status last_verified valid_from valid_to context_id".split()
    table = spark.createDataFrame([stored(1, None, "stale"), stored(2, None, "stale", 4), stored(3, 1, "invalidated"), stored(4, 1, "stale"), stored(5, 2, "stale"), stored(6, 3, "stale", 4), stored(7, 9, "stale", None, None)], "evidence_id bigint, " + TABLES["evidence"].split(", ", 1)[1]).select(*names)
    given = [(i, "edge", "e", "file", repo, "f", line, 6, "x", "1", f"c{i}", 0.5, polarity) for i, (line, repo, polarity) in enumerate([(None, "r", None), (1, "r", "positive"), (3, "r", "positive"), (3, "r", "positive"), (9, None, "positive"), (9, "r", "positive"), (2, "r", "negative")])]
    incoming = spark.createDataFrame(given, "position int, target_kind string, target_key string, source_kind string, repo_name string, file_path string, line_start int, line_end int, extractor_id string, extractor_version string, commit_sha string, confidence double, polarity string")
    after = mutate.upsert_evidence(table, incoming, 9)
    rows = after.collect()
    assert after.columns == table.columns and after.dtypes == table.dtypes
    old = {r.evidence_id: (r.status, r.commit_sha, r.confidence, r.last_verified, r.valid_from, r.valid_to, r.line_end, r.context_id) for r in rows if r.evidence_id <= 7}
    assert old == {1: ("revalidated", "c0", 0.5, 9, 1, None, 5, 3), 2: ("stale", "old", 0.1, 1, 1, 4, 5, 3), 3: ("valid", "c1", 0.5, 9, 1, None, 5, 3), 4: ("revalidated", "c1", 0.5, 9, 1, None, 5, 3), 5: ("stale", "old", 0.1, 1, 1, None, 5, 3), 6: ("stale", "old", 0.1, 1, 1, 4, 5, 3), 7: ("revalidated", "c4", 0.5, 9, 1, None, 5, 3)}
    new = {(r.line_start, r.repo_name, r.polarity, r.status, r.commit_sha, r.last_verified, r.valid_from, r.valid_to, r.line_end, r.context_id) for r in rows if r.evidence_id > 7}
    assert new == {(3, "r", "positive", "valid", "c3", 9, 9, None, 6, None), (9, "r", "positive", "valid", "c5", 9, 9, None, 6, None), (2, "r", "negative", "valid", "c6", 9, 9, None, 6, None)}
    assert len({r.evidence_id for r in rows}) == len(rows) == 10
    plan = after.drop("evidence_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_evidence_is_dealt_out_once_per_node(spark):
    """However many rows tell of a node, the join with nodes gets one of each task."""
    nodes, edges = graph(spark, SHOP)
    told = spark.range(0, 1000, 1, 2).select(F.lit("node").alias("target_kind"), F.lit(WEB).alias("target_key"))
    found = insight.without_evidence(nodes, told)
    assert WEB not in (keys_ := {r.node_key for r in found.collect()}) and len(keys_) == nodes.count() - 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("LeftAnti"):]


def test_pairs_of_lines_are_dealt_out_by_the_size_of_their_table(spark, monkeypatch):
    """A task's share of the different pairs doesn't grow with the table, and shares lose none."""
    folder = "/root/testdata/sf0.001"
    size = os.path.getsize(f"{folder}/lineitem.parquet")
    for share, most, want in ((size // 8, 99, 9), (size // 8, 6, 6), (size, 99, 4)):
        monkeypatch.setattr("archloom.sources.projection.SHARE", share)
        monkeypatch.setattr("archloom.sources.projection.MOST_SHARES", most)
        w = World(spark, folder)
        plan = w.drawn._jdf.queryExecution().optimizedPlan().toString()
        assert re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan) == [str(want)] * 2
        lines = w.table("lineitem")
        for kind, columns in (("CALLS_SERVICE", ("l_partkey", "l_suppkey")), ("CONSUMES_TOPIC", ("l_partkey", "l_orderkey"))):
            found = w.drawn.where(F.col("edge_type") == kind)
            assert found.count() == found.select("edge_key").distinct().count() == lines.select(*columns).distinct().count()


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_rows_meet_a_batch_by_number_and_key(spark, monkeypatch, limit):
    """Keys of one number are told apart, null ones are nobody's and closed rows stay, whether rows are sorted or the batch is
    broadcast; the join knows a number only."""
    table = spark.createDataFrame([("aa", 1, "old", 1, None), ("ab", 2, "old", 1, None), ("ab", 3, "older", 0, 1), (None, 4, "old", 1, None), ("c", 5, "old", 1, None)], "node_key string, node_id bigint, status string, valid_from bigint, valid_to bigint")
    batch = spark.createDataFrame([("ab", "new"), ("zz", "new"), (None, "new")], "node_key string, status string")
    stay = {("aa", "old", None), ("ab", "older", 1), (None, "old", None), ("c", "old", None), ("ab", "new", None), ("zz", "new", None), (None, "new", None)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        plan = mutate.upsert(table, batch, "node_key", "node_id", revision=9).drop("node_id")._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"(SortMerge|BroadcastHash)Join \[xxhash64\(node_key#\d+, 42\)\], \[xxhash64\(_key#\d+, 42\)\], LeftOuter", plan)
        for number in (F.xxhash64, F.length):  # lengths: many keys of one number
            monkeypatch.setattr(F, "xxhash64", number)
            for revision, more in ((9, {("ab", "old", 9)}), (0, set())):
                rows = mutate.upsert(table, batch, "node_key", "node_id", revision).collect()
                assert {(r.node_key, r.status, r.valid_to) for r in rows} == stay | more and len(rows) == 7 + len(more)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
