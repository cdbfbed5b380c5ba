"""Thresholds of the curation steps, passed explicitly; values can come from a mapping, a file or the environment."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping


@dataclasses.dataclass(frozen=True)
class Curation:
    languages: tuple[str, ...] = ("en",)
    min_chars: int = 200
    max_chars: int = 100_000
    max_symbol_ratio: float = 0.10
    max_digit_ratio: float = 0.15
    min_alpha_ratio: float = 0.60
    max_dup_line_ratio: float = 0.30
    max_ngram_ratio: float = 0.20
    min_words: int = 30
    min_stop_share: float = 0.03
    min_word_length: float = 2.5
    max_word_length: float = 12.0
    max_perplexity: float = 3000.0
    reference_sources: tuple[str, ...] = ()
    permutations: int = 128
    bands: int = 32
    near_dup: float = 0.8
    shingle: int = 5
    max_toxic_share: float = 0.01
    decontam_ngram: int = 13
    validation_share: float = 0.02
    shard_tokens: int = 100_000
    review_samples: int = 100
    seed: int = 1234


def load(values: Mapping[str, object] | None = None, path: str | None = None, prefix: str = "LOOMWORK__") -> Curation:
    """Defaults, then a JSON file, then environment variables (PREFIX + field name, any case), then `values`."""
    known = {f.name: f for f in dataclasses.fields(Curation)}
    merged: dict[str, object] = {}
    if path and os.path.exists(path):
        with open(path) as file:
            merged |= json.load(file)
    for name, raw in os.environ.items():
        field = name[len(prefix) :].lower()
        if name.upper().startswith(prefix) and field in known:
            try:
                merged[field] = json.loads(raw)
            except ValueError:
                merged[field] = raw
    merged |= dict(values or {})
    unknown = set(merged) - set(known)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Curation(**{k: tuple(v) if isinstance(v, list) else v for k, v in merged.items()})
