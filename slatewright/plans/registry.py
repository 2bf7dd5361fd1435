"""Every registered query of the engine and its SQL for DuckDB."""

from __future__ import annotations

from .queries import QUERIES  # noqa: F401
from .oracle import ORACLE_SQL  # noqa: F401
