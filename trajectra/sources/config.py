"""Settings by dotted name, over defaults, from and to YAML."""

from __future__ import annotations

import copy
from pathlib import Path

DEFAULTS: dict = {"robot": {"type": "generic_6dof", "dof": 6}, "dataset": {"cache_dir": "data", "account": ""}, "metrics": {"spatial_coverage": {"voxel_size": 0.05}}}


class Config:
    def __init__(self, values: dict | None = None):
        self.values = copy.deepcopy(DEFAULTS)
        self.update(values or {})

    @classmethod
    def load(cls, path: str | Path) -> Config:
        import yaml

        return cls(yaml.safe_load(Path(path).read_text()) or {})

    def save(self, path: str | Path) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(self.values, sort_keys=True))

    def get(self, name: str, default: object = None) -> object:
        """The value under a dotted name, or the default."""
        at: object = self.values
        for key in name.split("."):
            if not isinstance(at, dict) or key not in at:
                return default
            at = at[key]
        return at

    def section(self, name: str) -> dict:
        found = self.get(name, {})
        return found if isinstance(found, dict) else {}

    def update(self, values: dict) -> None:
        """Merge nested values, or dotted names, into the settings."""

        def merge(into: dict, more: dict) -> None:
            for key, value in more.items():
                if isinstance(value, dict) and isinstance(into.get(key), dict):
                    merge(into[key], value)
                else:
                    into[key] = copy.deepcopy(value)

        for name, value in values.items():
            *path, last = name.split(".")
            nested: dict = {last: value}
            for key in reversed(path):
                nested = {key: nested}
            merge(self.values, nested)

    @property
    def robot_type(self) -> str:
        return str(self.get("robot.type"))

    @property
    def robot_dof(self) -> int:
        return int(self.get("robot.dof"))  # type: ignore[call-overload]
