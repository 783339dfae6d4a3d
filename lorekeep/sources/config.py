"""Settings of a store: a JSON file of plain values."""

from __future__ import annotations

import json
from pathlib import Path


class Config:
    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.values: dict = json.loads(self.path.read_text()) if self.path.exists() else {}

    def get(self, key: str, default=None):
        return self.values.get(key, default)

    def get_bool(self, key: str) -> bool:
        value = self.values.get(key, False)
        return value.strip().lower() in ("true", "1", "yes") if isinstance(value, str) else bool(value)

    def get_int(self, key: str, default: int = 0) -> int:
        try:
            return int(self.values.get(key, default))
        except (TypeError, ValueError):
            return default

    def set(self, key: str, value) -> None:
        self.values[key] = value
        self._save()

    def delete(self, key: str) -> None:
        self.values.pop(key, None)
        self._save()

    def keys(self) -> list[str]:
        return sorted(self.values)

    def _save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps(self.values, indent=2, sort_keys=True))
