"""Settings of a project, from the nearest biblion.toml at or above its folder."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from biblion.operators.hygiene import apply_settings
from biblion.plans.rules import RULES

NAME = "biblion.toml"
SEVERITIES = ("error", "warning", "info")


@dataclass(frozen=True)
class Settings:
    ignore_rules: tuple[str, ...] = ()
    ignore_keys: tuple[str, ...] = ()
    severity: dict[str, str] = field(default_factory=dict)
    disable_sources: tuple[str, ...] = ()
    fail_on: str = "error"

    def apply(self, findings: DataFrame) -> DataFrame:
        return apply_settings(findings, list(self.ignore_rules), list(self.ignore_keys), self.severity)


def find(start: Path) -> Path | None:
    """The nearest settings file; the search ends at a repository's root."""
    for folder in [start, *start.resolve().parents] if start.is_dir() else start.resolve().parents:
        if (folder / NAME).is_file():
            return folder / NAME
        if (folder / ".git").exists():
            return None
    return None


def load(path: Path) -> Settings:
    """Unknown keys, rules and severities are errors, so that a typing slip does not switch a rule off unseen."""
    data = tomllib.loads(path.read_text(encoding="utf-8"))
    known = {r for r, *_ in RULES}
    if unknown := set(data) - set(Settings.__dataclass_fields__):
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    rules = {*data.get("ignore_rules", ()), *data.get("severity", {})}
    if unknown := rules - known:
        raise ValueError(f"{path}: unknown rules {sorted(unknown)}")
    if bad := ({*data.get("severity", {}).values()} | {data.get("fail_on", "error")}) - {*SEVERITIES, "never"}:
        raise ValueError(f"{path}: unknown severities {sorted(bad)}")
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})
