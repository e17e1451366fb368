"""Row types of the graph's tables."""

from __future__ import annotations

PAYLOAD = {
    "nodes": "array<struct<node_key:string,layer:string,node_type:string,domain_key:string,name:string,qualified_name:string,repo_name:string,file_path:string,lang:string,owner_key:string,environment:string,visibility:string,status:string,confidence:double,metadata:string>>",
    "edges": "array<struct<edge_key:string,from_node_key:string,to_node_key:string,edge_type:string,derivation_kind:string,from_layer:string,to_layer:string,context_key:string,confidence:double,metadata:string>>",
    "evidence": "array<struct<target_kind:string,node_key:string,edge_key:string,source_kind:string,repo_name:string,file_path:string,line_start:string,line_end:string,column_start:string,column_end:string,locator:string,extractor_id:string,extractor_version:string,ast_rule:string,snippet_hash:string,commit_sha:string,confidence:double,polarity:string,metadata:string>>",
    "aliases": "array<struct<node_key:string,alias:string,alias_kind:string,confidence:double>>",
}
PAYLOAD_SCHEMA = ", ".join(f"{k} {v}" for k, v in PAYLOAD.items())

_VERSION = "valid_from bigint, valid_to bigint, context_id bigint"
TABLES = {
    "nodes": f"node_id bigint, node_key string, layer string, node_type string, domain_key string, name string, qualified_name string, repo_name string, file_path string, lang string, owner_key string, environment string, visibility string, status string, confidence double, freshness double, trust_score double, metadata string, first_seen bigint, last_seen bigint, {_VERSION}",
    "edges": f"edge_id bigint, edge_key string, from_node_key string, to_node_key string, edge_type string, derivation_kind string, context_key string, active boolean, confidence double, freshness double, trust_score double, metadata string, first_seen bigint, last_seen bigint, {_VERSION}",
    "evidence": f"evidence_id bigint, target_kind string, target_key string, source_kind string, repo_name string, file_path string, line_start int, line_end int, extractor_id string, extractor_version string, commit_sha string, confidence double, polarity string, status string, last_verified bigint, {_VERSION}",
    "aliases": "node_key string, alias string, normalized_alias string, alias_kind string, confidence double",
    "revisions": "revision_id bigint, domain_key string, git_before_sha string, git_after_sha string, trigger_kind string, mode string, context_id bigint",
    "snapshots": "snapshot_id bigint, revision_id bigint, domain_key string, kind string, summary string, created_at timestamp",
    "contexts": "context_id bigint, domain_key string, name string, git_ref string, base_context_id bigint, base_revision_id bigint, head_revision_id bigint, head_commit_sha string, status string",
    "changelog": "change_id bigint, context_id bigint, revision_id bigint, entity_type string, entity_key string, change_type string",
    "glossary": "domain_key string, term string, context string, definition string, aliases array<string>, anti_patterns array<string>, examples array<string>",
    "discoveries": "discovery_id bigint, domain_key string, category string, severity string, title string, description string, confidence double, applied boolean, created_at timestamp",
    "requests": "request_id bigint, ts timestamp, tool_name string, params_json string, result_json string, error_message string, duration_ms double",
    "settings": "key string, value string",
    "diagram_sessions": "session_id string, body string",
}
