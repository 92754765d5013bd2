"""Settings of the engine with their ranges; bad values fail at once, all of them named."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

# Versions of what decides stored rows: a change here asks for a re-run.
VERSIONS = {
    "checks": "checks@1", "compare": "compare@2", "normalize": "normalize@2", "chunk": "chunk@1", "batch": "batch@1", "parse": "parse@1", "verify": "verify@1", "layout": "layout@1",
}

def frozen_versions(path: str | None = None) -> dict[str, str]:
    """The versions that stored results were made with, from the file that records them; a run under others is not comparable with these."""
    return json.loads(Path(path or Path(__file__).with_name("frozen_versions.json")).read_text())["versions"]


@dataclass(frozen=True)
class Settings:
    """Defaults are those of the published configuration."""

    semantic_top_k: int = 15
    model_concurrency: int = 2
    batch_input_tokens: int = 3000
    batch_chunks: int = 4
    extract_token_budget: int = 1_500_000
    compare_token_budget: int = 400_000
    chunk_target_tokens: int = 1200
    chunk_most_tokens: int = 2000
    embedding_width: int = 768
    most_upload_mb: int = 50
    most_pages: int = 300
    provider_timeout_ms: int = 120_000
    provider_retries: int = 5

    RANGES = {
        "semantic_top_k": (1, 1000), "model_concurrency": (1, 64), "batch_input_tokens": (100, 1_000_000), "batch_chunks": (1, 100), "extract_token_budget": (0, 10**12), "compare_token_budget": (0, 10**12),
        "chunk_target_tokens": (1, 100_000), "chunk_most_tokens": (1, 100_000), "embedding_width": (1, 65_536), "most_upload_mb": (1, 2000), "most_pages": (1, 100_000),
        "provider_timeout_ms": (1000, 600_000), "provider_retries": (0, 20),
    }

    def __post_init__(self) -> None:
        bad = [f"{f.name}={getattr(self, f.name)} is not in {self.RANGES[f.name]}" for f in fields(self) if not self.RANGES[f.name][0] <= getattr(self, f.name) <= self.RANGES[f.name][1]]
        if self.chunk_target_tokens > self.chunk_most_tokens:
            bad.append("chunk_target_tokens is above chunk_most_tokens")
        if bad:
            raise ValueError("; ".join(bad))


def load_settings(values: Mapping[str, str]) -> Settings:
    """Settings from texts (for example an environment); names in capitals, others keep their defaults."""
    known = {f.name: f for f in fields(Settings)}
    chosen: dict[str, int] = {}
    bad = []
    for name, text in values.items():
        if name.lower() in known:
            try:
                chosen[name.lower()] = int(text)
            except ValueError:
                bad.append(f"{name}={text!r} is not a whole number")
    if bad:
        raise ValueError("; ".join(bad))
    return Settings(**chosen)
