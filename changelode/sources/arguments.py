"""What a user hands over as text: sources with labels, lists of numbers, rule files."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path
from typing import Any

from changelode.operators.rules import CAP, HIGH, MEDIUM, KeywordRule, PathRule, RuleSet


def source(argument: str) -> tuple[str, str]:
    """``[label=]path``; without a label, the parent folder's name, then the file's stem."""
    label, cut, path = argument.partition("=")
    if not cut:
        label, path = "", argument
    if not path.strip():
        raise ValueError("a source needs a path")
    p = Path(path)
    return label or p.parent.name or p.stem, path


def numbers(argument: str) -> list[int]:
    """Request numbers from a comma list, or a file of lines, a JSON array or object; sorted, distinct."""
    text = Path(argument[1:] if argument.startswith("@") else argument).read_text() if argument.startswith("@") or Path(argument).is_file() else argument
    try:
        found = _from_json(json.loads(text))
    except ValueError:
        found = [int(x.lstrip("#")) for x in re.split(r"[,\s]+", text.strip()) if x]
    if any(n <= 0 for n in found):
        raise ValueError("request numbers are positive")
    return sorted(set(found))


def _from_json(value: Any) -> list[int]:
    if isinstance(value, bool):
        raise ValueError("no number")
    if isinstance(value, int):
        return [value]
    if isinstance(value, str):
        return [int(value.lstrip("#"))]
    if isinstance(value, list):
        return [n for x in value for n in _from_json(x)]
    if isinstance(value, dict):
        for name in ("number", "pr", "prs", "numbers", "pairs", "cases"):
            if name in value:
                return _from_json(value[name])
        return [n for k in ("positive", "negative") if k in value for n in _from_json(value[k])]
    raise ValueError(f"no numbers in {value!r}")


def rule_set(path: str) -> tuple[RuleSet, str]:
    """A rule file (YAML where the library is there, else JSON) and the SHA-256 of its bytes.

    Limits that are absent or 0 take their defaults; a bad pattern is an error here.
    """
    raw = Path(path).read_bytes()
    try:
        import yaml

        data = yaml.safe_load(raw)
    except ImportError:
        data = json.loads(raw)
    h = data.get("heuristics", data)
    for rule in [*h.get("path_rules", []), *h.get("keyword_rules", [])]:
        re.compile(rule["pattern"])
    limits = h.get("scoring", {})
    rules = RuleSet(
        tuple(PathRule(r["name"], r["pattern"], float(r["weight"])) for r in h.get("path_rules", [])),
        tuple(KeywordRule(r["name"], r["pattern"], float(r["weight"]), tuple(r.get("match_fields", ()))) for r in h.get("keyword_rules", [])),
        limits.get("max_cap") or CAP, limits.get("high_threshold") or HIGH, limits.get("medium_threshold") or MEDIUM,
    )
    return rules, hashlib.sha256(raw).hexdigest()
