"""Where the engine's tables are, and its thresholds."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    """Paths and thresholds; ``from_env`` lets CORBEL_<NAME> override any of them."""

    label_master: str = "data/labels.jsonl"
    label_chunks: str = "data/label_chunks.jsonl"
    label_vectors: str = "data/label_vectors.parquet"
    concept_master: str = "data/concepts.jsonl"
    concept_vectors: str = "data/concept_vectors.parquet"
    drug_master: str = "data/drugs.jsonl"
    resolved_links: str = "data/links_resolved.jsonl"
    resolved_links_fallback: str = "data/links_resolved_old.jsonl"
    rollup: str = "data/rollup.jsonl"
    blocklist: str = "data/blocklist.txt"
    top_k: int = 6
    min_conf: float = 0.80
    min_labels: int = 2
    top_edges: int = 10
    fuzzy_cutoff: float = 88.0
    chunk_target: int = 1100
    chunk_max: int = 1800
    chunk_overlap: int = 160
    synonym_tokens: int = 300
    neighbours: int = 5
    run_ts: str = "1970-01-01T00:00:00+00:00"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> EngineConfig:
        """Defaults, overridden by the environment; numbers keep their type."""
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            if value := env.get(f"CORBEL_{f.name.upper()}"):
                found[f.name] = type(getattr(cls, f.name))(value)
        return cls(**found)

    def links_path(self) -> str:
        """The links file, or its older place where only that exists."""
        if "://" not in self.resolved_links and not os.path.exists(self.resolved_links) and os.path.exists(self.resolved_links_fallback):
            return self.resolved_links_fallback
        return self.resolved_links
