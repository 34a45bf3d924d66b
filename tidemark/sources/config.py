"""Rule and weight files."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

from tidemark.operators.rule_scoring import Rule


def load_yaml(path: str) -> dict:
    """A YAML file as a dict; empty files give {}, missing ones FileNotFoundError."""
    import yaml

    if not Path(path).exists():
        raise FileNotFoundError(path)
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def load_rules(path: str, weights_path: str | None = None) -> list[Rule]:
    """Rules from a file with a list 'clauses' of id, name, keywords, expected_elements, required, risk_if_missing.

    What a rule leaves out is: required, medium risk, no keywords, no elements. Weights come from a mapping 'weights'.
    """
    weights = load_yaml(weights_path).get("weights", {}) if weights_path else {}
    return [
        Rule(c["id"], c.get("name", c["id"]), tuple(c.get("keywords") or ()), tuple(c.get("expected_elements") or ()), weights.get(c["id"]), c.get("required", True), c.get("risk_if_missing", "medium"))
        for c in load_yaml(path).get("clauses", [])
    ]


@dataclass
class Settings:
    """Settings of a model-backed extractor: explicit values before the environment's, those before the defaults."""

    base_url: str = field(default_factory=lambda: os.environ.get("TIDEMARK_MODEL_URL", "http://localhost:11434"))
    model: str = field(default_factory=lambda: os.environ.get("TIDEMARK_MODEL", ""))
    timeout: int = 120
    retries: int = 3
