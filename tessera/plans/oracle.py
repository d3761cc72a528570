"""DuckDB SQL of all registered queries that have one."""

from __future__ import annotations

from tessera.plans import catalogue  # noqa: F401
from tessera.plans.registry import SQL

__all__ = ["SQL"]
