"""All queries over the reference's operators, with SQL for those that SQL can express."""

from __future__ import annotations

from . import chains, columns, detectors, dialogues, landscapes, real, stars, studies  # noqa: F401  (they register their queries)
from .register import QUERIES, SQL

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
FLAGSHIP = "agg17_supply"
