"""Configuration: defaults, then the file, then what the caller gives; None given by the caller is as if not given."""

from __future__ import annotations

import copy
from datetime import date, datetime
from pathlib import Path
from typing import Any

from modelgauge.sources.project import ConfigError

DEFAULTS: dict[str, Any] = {
    "version": 1,
    "confidence_threshold": 0.7,
    "render": {"mode": "AUTO", "compiled_min_coverage": 0.5, "compiled_dir": None},
    "rules": {},
    "coverage": {"weights": {"trivial": 0.0, "structural": 0.25, "logical": 1.0, "unknown": 0.0}, "classes": {"logical": [], "structural": [], "trivial": []}, "unit_test_cc_threshold": 3, "thresholds": {}},
    "complexity": {"warn": 15, "block": 30, "include_jinja": True, "exempt_models": []},
    "architecture": {"layers": None, "prefixes": None, "allowed": None},
    "lint": {"severities": {}},
    "baseline": None,
    "scoring": {},
    "overrides": [],
    "gate": {"fail_on_tier": 1, "fail_on_new_only": False, "unexecuted_max": 0, "skips": {"RULE_ERROR": 0, "ADAPTER_FAILED": 0}},
}


def _merge(a: dict, b: dict) -> dict:
    out = copy.deepcopy(a)
    for k, v in b.items():
        if v is None:
            continue
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def _day(v: Any) -> str:
    if isinstance(v, datetime):
        return v.date().isoformat()
    if isinstance(v, date):
        return v.isoformat()
    try:
        return datetime.fromisoformat(str(v)).date().isoformat()
    except ValueError as e:
        raise ConfigError(f"not a date: {v}") from e


def checked(cfg: dict) -> dict:
    if cfg["version"] != 1:
        raise ConfigError("version must be 1")
    if cfg["complexity"]["block"] < cfg["complexity"]["warn"]:
        raise ConfigError("complexity.block is under complexity.warn")
    for e in cfg["overrides"]:
        if not e.get("waive") or not str(e.get("reason") or "").strip() or not any(e.get(k) for k in ("models", "paths", "node_ids")):
            raise ConfigError("an override needs a reason, rules to waive and a selector")
        if e.get("expires"):
            e["expires"] = _day(e["expires"])
    cov = cfg["coverage"]
    cov["thresholds"] = cov["thresholds"] | {k: v["min"] for k, v in cov.items() if isinstance(v, dict) and "min" in v}
    return cfg


def load_config(path: str | None = None, given: dict | None = None) -> dict:
    cfg = DEFAULTS
    if path is not None:
        import yaml

        try:
            data = yaml.safe_load(Path(path).read_text("utf-8")) or {}
        except yaml.YAMLError as e:
            raise ConfigError(f"{path} isn't YAML") from e
        if not isinstance(data, dict):
            raise ConfigError(f"{path} isn't a map")
        cfg = _merge(cfg, data)
    return checked(_merge(cfg, given or {}))


TEMPLATE = """# every setting has a default; this file names those that projects change most
version: 1
confidence_threshold: 0.7
render:
  mode: AUTO  # AUTO, COMPILED or MOCK
complexity:
  warn: 15
  block: 30
coverage:
  unit_test_cc_threshold: 3
gate:
  fail_on_tier: 1
overrides: []
"""


def write_template(folder: str, name: str = "modelgauge.yml", force: bool = False) -> Path:
    """A first configuration file; one that exists is left alone unless `force` is given."""
    file = Path(folder) / name
    if file.exists() and not force:
        raise ConfigError(f"{file} exists")
    file.write_text(TEMPLATE, "utf-8")
    return file
