"""Knobs of the engine; frozen, so a plan built with one is deterministic."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from .constants import KEYS, METRICS

# Ranges that a value must lie in.
RANGES = {
    "t_page": (0, 100),
    "t_doc": (0, 100),
    "doc_flag_ratio": (0, 1),
    "l_max_token": (1, 1000),
    "short_page_token_floor": (0, 10_000),
    "lexical_good": (0, 1),
    "lexical_warn": (0, 1),
    "lexical_zero": (0, 1),
    "ced_mojibake_bad": (1, 1000),
    "xsa_repeat_ngram": (1, 20),
    "xsa_repeat_max": (1, 1000),
    "xsa_cer_bad": (0, 1),
    "xsa_md_sim_warn": (0, 1),
    "bcc_tolerance": (0, 1),
    "render_dpi": (36, 1200),
}


@dataclass(frozen=True)
class Config:
    t_page: float = 70.0
    t_doc: float = 75.0
    doc_flag_ratio: float = 0.20
    l_max_token: int = 25
    short_page_token_floor: int = 40
    lexical_good: float = 0.92
    lexical_warn: float = 0.80
    lexical_zero: float = 0.60
    ced_kl_good: float = 0.15
    ced_kl_bad: float = 1.5
    ced_mojibake_bad: int = 3
    wsa_good: float = 0.02
    wsa_bad: float = 0.15
    xsa_repeat_ngram: int = 5
    xsa_repeat_max: int = 5
    xsa_cer_bad: float = 0.25
    xsa_md_sim_warn: float = 0.60
    bcc_tolerance: float = 0.20
    perplexity_backend: str = "ngram"
    render_dpi: int = 200
    weights: dict[str, float] = field(default_factory=lambda: {k: w for k, _, w in METRICS})

    def __post_init__(self):
        for f in fields(self):
            if f.name in RANGES:
                low, high = RANGES[f.name]
                if not low <= getattr(self, f.name) <= high:
                    raise ValueError(f"{f.name} must lie in [{low}, {high}]")
        if self.perplexity_backend not in ("ngram", "kenlm", "gpt2"):
            raise ValueError("perplexity_backend must be ngram, kenlm or gpt2")
        if unknown := set(self.weights) - set(KEYS):
            raise ValueError(f"unknown metrics in weights: {sorted(unknown)}")

    def normalized_weights(self, available: list[str]) -> dict[str, float]:
        """Weights of the available metrics with sum 1; equal ones if none has weight."""
        total = sum(self.weights.get(k, 0.0) for k in available)
        if total <= 0:
            return {k: 1.0 / len(available) for k in available}
        return {k: self.weights.get(k, 0.0) / total for k in available}
