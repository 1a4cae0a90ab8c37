"""Configuration files: a mapping of names to values, as YAML or JSON."""

from __future__ import annotations

import json
from pathlib import Path


def load_config(path: str | Path) -> dict:
    """The mapping in a file, empty for an empty file. JSON is read without further packages, YAML with PyYAML.

    ``FileNotFoundError`` without the file, ``ValueError`` if it holds no mapping.
    """
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"no configuration file at {path}")
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        found = json.loads(text or "{}")
    else:
        try:
            import yaml
        except ImportError:  # an optional package
            found = _plain(text)
        else:
            found = yaml.safe_load(text)
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def _plain(text: str) -> dict:
    """YAML of one level: ``name: value`` lines with comments, values as JSON or else as text. For where PyYAML is missing."""
    out = {}
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line or line.startswith("#") or line == "---":
            continue
        if line[0].isspace() or ":" not in line:
            raise ValueError(f"PyYAML is needed to read {line!r}")
        name, value = line.split(":", 1)
        try:
            out[name.strip()] = json.loads(value.strip() or "null")
        except json.JSONDecodeError:
            out[name.strip()] = value.strip().strip("'\"")
    return out
