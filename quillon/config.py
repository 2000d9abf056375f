"""Engine settings. The defaults that results depend on."""

from __future__ import annotations

import os
from collections.abc import MutableMapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Defaults of retrieval, chunking, context packing and caching."""

    top_k: int = 50
    rerank_top_k: int = 8
    rerank_pool: int = 20
    candidate_multiplier: int = 3
    rrf_k: int = 20
    dense_weight: float = 1.0
    bm25_weight: float = 1.0
    sparse_weight: float = 0.25
    sparse_coverage: float = 0.95
    mmr_lambda: float = 0.6
    mmr_on: bool = True
    cap_on: bool = False
    cap_n: int = 3
    chunk_max_tokens: int = 800
    chunk_overlap: int = 200
    chunk_min_tokens: int = 50
    embedding_dim: int = 1024
    cache_ttl_seconds: int = 604_800
    context_window: int = 8192
    context_margin: int = 512
    min_output_tokens: int = 256
    answer_tokens: int = 2048
    thinking_multiplier: int = 4
    estimate_factor: float = 1.15
    stale_minutes: int = 30


DEFAULTS = Settings()


def load_env(path: str, into: MutableMapping[str, str] = os.environ) -> dict[str, str]:
    """The ``KEY=value`` lines of a file, put into the environment where a key isn't set yet; blank lines and comments are passed over, a missing file is empty."""
    found: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                key, mark, value = line.strip().partition("=")
                if mark and not key.startswith("#"):
                    found[key.strip()] = value.strip()
                    into.setdefault(key.strip(), value.strip())
    return found


def from_env(prefix: str = "QUILLON_", env: MutableMapping[str, str] = os.environ) -> Settings:
    """The defaults with what the environment sets, e.g. QUILLON_TOP_K; true, yes, on and 1 are true."""
    kinds = {"int": int, "float": float, "bool": lambda v: v.strip().lower() in ("1", "true", "yes", "on"), "str": str}
    return replace(DEFAULTS, **{f.name: kinds[f.type](env[prefix + f.name.upper()]) for f in fields(Settings) if prefix + f.name.upper() in env})
