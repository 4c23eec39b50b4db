"""All registered queries and the SQL that says the same, by name."""

from __future__ import annotations

from .plans import formats, graphs, more, motion, predictions, windows  # noqa: F401
from .plans.views import ORACLE_SQL, QUERIES  # noqa: F401
