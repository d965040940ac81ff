"""What the jobs share: their config file and their log."""

from __future__ import annotations

import os

from sheetspark.sources.config import parse_yaml


def config(path: str | None, beside: str) -> dict:
    """The settings of ``path``, a small YAML file of the driver, over those of the job's own file (``beside``, its module,
    ending in yaml); keys that the own file lacks are refused."""
    own = _read(os.path.splitext(os.path.abspath(beside))[0] + ".yaml")
    given = _read(path) if path else {}
    unknown = sorted(set(given) - set(own))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return own | given


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return parse_yaml(f.read()) or {}
