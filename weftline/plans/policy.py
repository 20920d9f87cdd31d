"""Policies: defaults, validation of given values, and presets laid over defaults with a record of where each value came from."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    """A parameter's default and what it may be: a range of numbers, a set of words, or a boolean."""

    default: object
    low: float | None = None
    high: float | None = None
    words: tuple[str, ...] = ()
    whole: bool = True


#: Parameters with defaults and ranges, fixed values.
RULES: dict[str, Rule] = {
    "segmentation.chunkTokens": Rule(512, 64, 8192),
    "segmentation.overlapTokens": Rule(64, 0, 4096),
    "recall.threshold": Rule(0.55, 0, 1, whole=False),
    "recall.window": Rule(16, 4, 1_048_576),
    "recall.depth": Rule(16, 1, 16),
    "recall.tier1": Rule("s1", words=("s1", "off")),
    "recall.minRecalledSegments": Rule(1, 1, 8),
    "recall.minRecalledShare": Rule(0.0, 0, 1, whole=False),
    "recall.deliveryMaxTokens": Rule(0, 0, 65_536),
    "recall.deliveryMaxSegments": Rule(0, 0, 64),
    "recall.anchorWaitMs": Rule(10_000, 0, 60_000),
    "tail.k": Rule(3, 0, 20),
    "tas.on": Rule(True),
    "tas.tMaxChars": Rule(50_000, 0, 200_000),
    "tas.updatePolicy": Rule("perTask", words=("perTask", "perTurn", "milestone")),
    "tracePlacement": Rule("trace-as-state", words=("trace-as-state", "trace-append")),
    "contextSelection.shortContextTokens": Rule(32_768, 0, 1_048_576),
    "deliver": Rule(False),
    "assemblyTrigger": Rule("every-step", words=("claimed-only", "every-step")),
    "s1.questionsPerCall": Rule(20, 1, 64),
    "s1.retryAttempts": Rule(1, 1, 5),
    "s1.admissionLimit": Rule(2, 1, 64),
    "cache.reselectPolicy": Rule("perTask", words=("perTask", "perTurn")),
    "cache.blockTokens": Rule(64, 1, 4096),
}


@dataclass
class Policy:
    values: dict[str, object]
    source: dict[str, str] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def flat(tree: Mapping, prefix: str = "") -> dict[str, object]:
    """Nested values by dotted path; keys that start with an underscore are notes and left out."""
    out: dict[str, object] = {}
    for key, value in tree.items():
        if not str(key).startswith("_"):
            out |= flat(value, f"{prefix}{key}.") if isinstance(value, Mapping) else {f"{prefix}{key}": value}
    return out


def fault(path: str, value: object) -> str | None:
    rule = RULES.get(path)
    if rule is None:
        return f"{path}: no such parameter"
    if isinstance(rule.default, bool):
        return None if isinstance(value, bool) else f"{path}: must be true or false"
    if rule.words:
        return None if value in rule.words else f"{path}: must be one of {', '.join(rule.words)}"
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or (rule.whole and value != int(value)):
        return f"{path}: must be a {'whole ' if rule.whole else ''}number"
    return None if rule.low <= value <= rule.high else f"{path}: must be from {rule.low} to {rule.high}"


def layered(*layers: tuple[str, Mapping]) -> Policy:
    """Defaults under named layers, later ones over earlier ones. A faulty value keeps what was there and is reported.

    An overlap that is not below the chunk size sets both back to their defaults.
    """
    policy = Policy({p: r.default for p, r in RULES.items()}, dict.fromkeys(RULES, "default"))
    for name, layer in layers:
        for path, value in flat(layer).items():
            if said := fault(path, value):
                policy.errors.append(f"{name}: {said}")
                continue
            if policy.source[path] != "default":
                policy.warnings.append(f"{path}: {name} overrides {policy.source[path]}")
            policy.values[path], policy.source[path] = value, name
    chunk, overlap = "segmentation.chunkTokens", "segmentation.overlapTokens"
    if policy.values[overlap] >= policy.values[chunk]:
        policy.errors.append(f"{overlap}: must be below {chunk}")
        for path in (chunk, overlap):
            policy.values[path], policy.source[path] = RULES[path].default, "default"
    if policy.values["deliver"] and policy.values["recall.tier1"] == "off":
        policy.warnings.append("deliver: nothing is recalled while recall.tier1 is off")
    return policy


#: Arms of a comparison, fixed values.
PRESETS: dict[str, dict] = {
    "C0": {"tas": {"on": False}, "recall": {"tier1": "off"}, "deliver": False},
    "C1": {"tas": {"on": True}, "recall": {"tier1": "off"}, "deliver": True},
    "C2": {"tas": {"on": True, "updatePolicy": "milestone", "tMaxChars": 2400}, "recall": {"tier1": "s1", "deliveryMaxTokens": 2048, "deliveryMaxSegments": 4}, "deliver": True},
}
