"""Settings as a frozen value, from a mapping or the environment, with the rules that they obey."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 800
    chunk_overlap: int = 150
    embedding_dim: int = 768
    batch_size: int = 16
    k: int = 5
    temperature: float = 0.1
    max_tokens: int = 512
    similarity_threshold: float = 0.1

    def problems(self) -> list[str]:
        out = []
        if self.chunk_size <= 0:
            out.append("chunk_size must be positive")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            out.append("chunk_overlap must lie below chunk_size")
        if not 0 <= self.temperature <= 2:
            out.append("temperature must lie in 0..2")
        if not 1 <= self.k <= 1000:
            out.append("k must lie in 1..1000")
        if not 0 <= self.similarity_threshold <= 1:
            out.append("similarity_threshold must lie in 0..1")
        return out


def from_mapping(values: Mapping[str, object], base: Settings = Settings()) -> Settings:
    """Known names only, cast to the type of the default; invalid settings raise."""
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(Settings)}
    out = replace(base, **{k: kinds[k](v) for k, v in values.items() if k in kinds})
    if bad := out.problems():
        raise ValueError("; ".join(bad))
    return out


def from_file(path: str, base: Settings = Settings()) -> Settings:
    """Settings from a JSON file, or from lines `name: value` (YAML without nesting; sections and comments are skipped)."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if text.lstrip().startswith("{"):
        return from_mapping(json.loads(text), base)
    found = (re.match(r"\s*(\w+)\s*:\s*([^#\n]+?)\s*(?:#.*)?$", line) for line in text.splitlines())
    return from_mapping({m[1]: m[2].strip("\"'") for m in found if m}, base)


def from_env(prefix: str = "DOCLOOM_") -> Settings:
    return from_mapping({k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)})
