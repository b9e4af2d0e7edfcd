"""Settings of the analytics pipeline: one table of fields, and the rules between them."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

#: Columns that tell the answer and so are never features. Fixed values.
NEVER_FEATURES = frozenset({"verdict", "family", "is_unseen", "alert_id", "rule_id", "mitre_technique", "mitre_tactic", "split", "metadata"})
#: Names that published settings files use for sections and backends here. Fixed values.
ALIASES = {"flyhash": "expansion", "connectome": "measured", "rewired_connectome": "rewired", "mbon": "readout"}


@dataclass(frozen=True)
class Field:
    """One setting: where it stands, its default, its kind, and the interval of its values ("(" and ")" leave an end out)."""

    path: str
    default: Any
    kind: str
    interval: str = ""
    empty: bool = False

    def problem(self, x: Any) -> str | None:
        """What is wrong with a value."""
        if x is None or isinstance(x, (list, dict)) and not x:
            return None if self.empty else f"{self.path} is empty"
        kind, each = (self.kind[:-1], x) if self.kind.endswith("s") else (self.kind, [x])
        if kind == "map":
            return next((p for k, v in x.items() if (p := Field(f"{self.path}.{k}", 1.0, "real", self.interval, True).problem(v))), None) if isinstance(x, dict) else f"{self.path} must be a map"
        if not isinstance(each, list):
            return f"{self.path} must be a list"
        good = {
            "whole": lambda v: isinstance(v, int) and not isinstance(v, bool),
            "real": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v),
            "flag": lambda v: isinstance(v, bool),
            "name": lambda v: isinstance(v, str) and bool(v),
        }[kind]
        if not all(good(v) for v in each):
            return f"{self.path} must be {kind}"
        if self.interval and not all(self._within(v) for v in each):
            return f"{self.path} must lie in {self.interval}"
        return None

    def _within(self, v: float) -> bool:
        low, high = (math.inf if e == "inf" else float(e) for e in self.interval[1:-1].split(", "))
        return (v > low if self.interval[0] == "(" else v >= low) and (v < high if self.interval[-1] == ")" else v <= high)


#: All settings with their published defaults (fixed values) and bounds.
FIELDS = (
    Field("seed", 42, "whole"),
    Field("representation.backend", "expansion", "name"),
    Field("dataset.size", 5000, "whole", "[100, inf)"),
    Field("dataset.start", "2026-01-01T00:00:00Z", "name"),
    Field("dataset.heldout_family", "vault_export", "name"),
    Field("dataset.unseen_test_fraction", 0.30, "real", "(0, 1)"),
    Field("features.input_features", 4096, "whole", "[1, inf)"),
    Field("features.categorical_hash_dim", 2048, "whole", "[1, inf)"),
    Field("features.text_max_features", 2040, "whole", "[1, inf)"),
    Field("features.categorical_weight", 0.7, "real", "[0, inf)"),
    Field("features.identity_weight", 0.15, "real", "[0, inf)"),
    Field("features.text_weight", 1.0, "real", "[0, inf)"),
    Field("features.numeric_weight", 0.2, "real", "[0, inf)"),
    Field("features.text_fields", ["alert_name", "process_command_line"], "names", empty=True),
    Field("features.categorical_fields", ["severity", "category", "process_name", "action"], "names", empty=True),
    Field("features.identity_fields", ["hostname", "username", "source_ip", "destination_ip"], "names", empty=True),
    Field("features.ablation.enabled", False, "flag"),
    Field("features.ablation.disabled_fields", [], "names", empty=True),
    Field("expansion.kc_dim", 8192, "whole", "[1, inf)"),
    Field("expansion.fan_in", 8, "whole", "[1, inf)"),
    Field("expansion.top_k", 64, "whole", "[1, inf)"),
    Field("expansion.batch_size", 128, "whole", "[1, inf)"),
    Field("measured.enabled", False, "flag"),
    Field("measured.dataset", None, "name", empty=True),
    Field("measured.dataset_version", None, "name", empty=True),
    Field("measured.projection_path", None, "name", empty=True),
    Field("measured.mode", "binary", "name"),
    Field("measured.bridge_fan_out", 2, "whole", "[1, inf)"),
    Field("measured.top_k", 64, "whole", "[1, inf)"),
    Field("measured.batch_size", 128, "whole", "[1, inf)"),
    Field("controls.rewired.enabled", False, "flag"),
    Field("controls.rewired.preserve_degree", True, "flag"),
    Field("controls.rewired.swaps_per_edge", 5.0, "real", "[0, inf)"),
    Field("readout.enabled", False, "flag"),
    Field("readout.learning_rate", 0.01, "real", "(0, inf)"),
    Field("readout.weight_decay", 0.0, "real", "[0, 1)"),
    Field("readout.weight_clip", 3.0, "real", "(0, inf)"),
    Field("novelty.percentile", 99, "real", "(0, 100]"),
    Field("novelty.baselines.enabled", False, "flag"),
    Field("novelty.baselines.lof_neighbors", 35, "whole", "[1, inf)"),
    Field("novelty.baselines.ocsvm_nu", 0.01, "real", "(0, 1]"),
    Field("evaluation.train_ratio", 0.70, "real", "(0, 1)"),
    Field("evaluation.validation_ratio", 0.15, "real", "(0, 1)"),
    Field("evaluation.test_ratio", 0.15, "real", "(0, 1)"),
    Field("evaluation.retrieval_k", [1, 5, 10], "wholes", "[1, inf)"),
    Field("evaluation.query_batch_size", 128, "whole", "[1, inf)"),
    Field("classification.knn_neighbors", 5, "whole", "[1, inf)"),
    Field("classification.forest_trees", 100, "whole", "[1, inf)"),
    Field("classification.logistic_max_iter", 1000, "whole", "[1, inf)"),
    Field("deduplication.similarity_threshold", 0.75, "real", "(0, 1]"),
    Field("deduplication.max_false_merge_rate", 0.01, "real", "[0, 1]"),
    Field("deduplication.thresholds", {}, "map", "(0, 1]", empty=True),
    Field("experiments.seeds", [42], "wholes"),
    Field("experiments.heldout_families", ["vault_export"], "names", empty=True),
)


def _nested(flat: dict[str, Any]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for path, value in flat.items():
        *sections, name = path.split(".")
        at = out
        for s in sections:
            at = at.setdefault(s, {})
        at[name] = value
    return out


def _copied(x: Any) -> Any:
    return list(x) if isinstance(x, list) else dict(x) if isinstance(x, dict) else x


DEFAULTS: dict[str, Any] = _nested({f.path: f.default for f in FIELDS})
_BY_PATH = {f.path: f for f in FIELDS}


def _flat(given: dict[str, Any], at: str = "") -> dict[str, Any]:
    """Settings by path, in the names used here."""
    out: dict[str, Any] = {}
    for key, value in given.items():
        path = at + (ALIASES.get(key, key) if not at else key)
        if isinstance(value, dict) and (path not in _BY_PATH or _BY_PATH[path].kind != "map"):
            out |= _flat(value, f"{path}.")
        else:
            out[path] = ALIASES.get(value, value) if path == "representation.backend" and isinstance(value, str) else value
    return out


def with_defaults(given: dict[str, Any] | None = None) -> dict[str, Any]:
    """Settings over the defaults; a key that is no setting raises."""
    flat = _flat(given or {})
    if unknown := sorted(set(flat) - set(_BY_PATH)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return _nested({f.path: _copied(flat.get(f.path, f.default)) for f in FIELDS})


Get = Callable[[str], Any]


def _feature_fields(get: Get) -> set[str]:
    return {x for kind in ("text", "categorical", "identity") for x in get(f"features.{kind}_fields") or []}


#: Rules between fields, looked at once every field is good by itself: what is demanded, and whether it holds.
RULES: tuple[tuple[str, Callable[[Get], bool]], ...] = (
    ("the input width is that of categories and text, and 8 numbers", lambda get: get("features.input_features") - 8 == get("features.categorical_hash_dim") + get("features.text_max_features")),
    ("there are more units than inputs, and no more inputs of a unit or winners than there can be", lambda get: get("expansion.fan_in") <= get("features.input_features") < get("expansion.kc_dim") >= get("expansion.top_k")),
    ("the three parts make a whole", lambda get: abs(1 - sum(get(f"evaluation.{p}_ratio") for p in ("train", "validation", "test"))) < 1e-9),
    ("answers and keys are not features", lambda get: _feature_fields(get).isdisjoint(NEVER_FEATURES)),
    ("only features are switched off", lambda get: set(get("features.ablation.disabled_fields") or []) <= _feature_fields(get) | {"timestamp", "source_port", "destination_port"}),
    ("the backend is expansion, measured or rewired", lambda get: get("representation.backend") in ("expansion", "measured", "rewired")),
    ("measured weights are binary, synapse or column_normalized", lambda get: get("measured.mode") in ("binary", "synapse", "column_normalized")),
    ("a measured backend is enabled and has its projection", lambda get: get("representation.backend") == "expansion" or get("measured.enabled") and get("measured.projection_path") is not None),
    ("the rewired backend is enabled and keeps degrees", lambda get: get("representation.backend") != "rewired" or get("controls.rewired.enabled") and get("controls.rewired.preserve_degree")),
    ("no seed comes twice", lambda get: len(get("experiments.seeds")) == len(set(get("experiments.seeds")))),
)


def check(settings: dict[str, Any]) -> list[str]:
    """What is wrong with the settings; nothing if they are good."""
    flat = _flat(settings)
    get = lambda path: flat.get(path, _BY_PATH[path].default)
    out = [f"unknown setting {p}" for p in sorted(set(flat) - set(_BY_PATH))]
    out += [p for f in FIELDS if (p := f.problem(get(f.path)))]
    return out or [f"demanded: {says}" for says, holds in RULES if not holds(get)]


def load(path: str | Path) -> dict[str, Any]:
    """Settings of a YAML file over the defaults, checked."""
    import yaml

    given = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(given, dict):
        raise ValueError("settings must be a mapping")
    settings = with_defaults(given)
    if problems := check(settings):
        raise ValueError("; ".join(problems))
    return settings


def active_fields(features: dict[str, Any]) -> dict[str, list[str]]:
    """Feature fields by role, without those an ablation switches off."""
    off = set(features["ablation"]["disabled_fields"]) if features["ablation"]["enabled"] else set()
    return {k: [x for x in features[k] if x not in off] for k in ("text_fields", "categorical_fields", "identity_fields")}
