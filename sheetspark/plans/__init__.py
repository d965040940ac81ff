"""Queries over the tables and end-to-end plans."""
from . import queries, reports, shapes  # noqa: F401  (both register their queries beside those of queries)
