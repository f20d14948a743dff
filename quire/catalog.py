"""Every query of the engine by name, and the SQL that states its rows."""

from __future__ import annotations

from quire.queries import composition, curation, evaluation, learning, reports, segmentation, sizes, small  # noqa: F401  they register their queries
from quire.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
