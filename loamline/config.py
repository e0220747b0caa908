"""Settings of indexing and search in one frozen record."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    vector_weight: float = 1.1
    lexical_weight: float = 0.5
    file_weight: float = 1.0
    fusion_k: int = 25
    fusion_alpha: float = 0.40
    candidate_factor: int = 8
    rescore_factor: int = 6
    k1: float = 1.5
    b: float = 0.75
    path_tokens: bool = True
    dimensions: int = 256
    chunker: str = "syntax"
    max_tokens: int = 220
    overlap: int = 1
    min_gap_lines: int = 1
    cap_header: bool = False
    spans: int = 2
    top: int = 10

    @classmethod
    def from_environment(cls, prefix: str = "LOAMLINE_") -> Settings:
        """Defaults overridden by variables such as LOAMLINE_FUSION_K; what can't be read as a number is ignored."""
        out = cls()
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is None:
                continue
            kind = type(getattr(out, f.name))
            try:
                value = raw.lower() in ("1", "true", "on", "yes") if kind is bool else kind(raw)
            except ValueError:
                continue
            out = replace(out, **{f.name: value})
        return out
