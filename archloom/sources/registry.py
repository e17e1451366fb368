"""The type registry: which node types, edge types and kinds exist, and how edges may be walked."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

DEFAULT = Path(__file__).with_name("registry.yaml")


@dataclass(frozen=True)
class Registry:
    layers: frozenset[str]
    node_types: dict[str, frozenset[str]]
    edge_types: dict[str, tuple[frozenset[str], frozenset[str]]]
    structural: frozenset[str]
    no_reverse: frozenset[str]
    derivation_kinds: frozenset[str]
    source_kinds: frozenset[str]
    node_statuses: frozenset[str]
    trigger_kinds: frozenset[str]

    @classmethod
    def parse(cls, text: str) -> Registry:
        raw = yaml.safe_load(text) or {}
        of = lambda part, key: frozenset((part or {}).get(key) or ())
        layers = of(raw, "layers")
        types = {k: frozenset(v or ()) for k, v in (raw.get("node_types") or {}).items()}
        edges = {k: (of(v, "from_layers"), of(v, "to_layers")) for k, v in (raw.get("edge_types") or {}).items()}
        if unknown := (set(types) | {x for a, b in edges.values() for x in a | b}) - layers:
            raise ValueError(f"unknown layers: {sorted(unknown)}")
        policy = raw.get("traversal_policy")
        kinds = {k: of(raw, k) for k in ("derivation_kinds", "source_kinds", "node_statuses", "trigger_kinds")}
        return cls(layers, types, edges, of(policy, "structural_edge_types"), of(policy, "no_reverse_impact"), **kinds)

    @classmethod
    def load(cls, path: str | Path = DEFAULT) -> Registry:
        return cls.parse(Path(path).read_text())

    def forward_allowed(self, edge_type: str) -> bool:
        return edge_type not in self.structural

    def reverse_allowed(self, edge_type: str) -> bool:
        return edge_type not in self.structural | self.no_reverse

    def node_type_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted((k, t) for k, v in self.node_types.items() for t in v), "layer string, node_type string")

    def allowed_pairs(self, spark: SparkSession) -> DataFrame:
        """edge_type, from_layer, to_layer of every edge that may exist."""
        rows = sorted((k, a, b) for k, (froms, tos) in self.edge_types.items() for a in froms for b in tos)
        return spark.createDataFrame(rows, "edge_type string, from_layer string, to_layer string")


@dataclass(frozen=True)
class Manifest:
    domain: str
    repositories: list[dict]
    description: str = ""
    owner: str = ""

    @classmethod
    def parse(cls, text: str) -> Manifest:
        raw = yaml.safe_load(text) or {}
        if not raw.get("domain"):
            raise ValueError("manifest: domain is required")
        repositories = raw.get("repositories") or []
        if not repositories or any(not r.get("name") or not r.get("path") for r in repositories):
            raise ValueError("manifest: at least one repository, each with name and path, is required")
        return cls(raw["domain"], repositories, raw.get("description", ""), raw.get("owner", ""))
