"""Messages to the standard error stream with their level and the section that is open."""

from __future__ import annotations

import logging
from contextlib import contextmanager
from contextvars import ContextVar

_section: ContextVar[str] = ContextVar("section", default="")
LOG = logging.getLogger("sheetspark")


class _Tagged(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        tag = _section.get()
        return f"[{record.levelname.lower()}]{f' [{tag}]' if tag else ''} {record.getMessage()}"


def configure(level: str = "info") -> None:
    """One handler; ``off`` silences everything."""
    handler = logging.StreamHandler()
    handler.setFormatter(_Tagged())
    LOG.handlers, LOG.propagate = [handler], False
    LOG.setLevel(logging.CRITICAL + 1 if level == "off" else level.upper())


@contextmanager
def section(name: str):
    """Messages inside carry the section's name; sections nest."""
    outer = _section.get()
    token = _section.set(f"{outer}/{name}" if outer else name)
    try:
        yield
    finally:
        _section.reset(token)
