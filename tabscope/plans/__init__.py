"""Plans: composed analyses and the registered query catalog."""

from __future__ import annotations

_MODULES = ["q_profile", "q_clean", "q_stats", "q_series", "q_forecast", "q_dashboard", "q_sources"]


def registry():
    """Import every query module and return (queries, oracle_sql)."""
    import importlib

    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
    from .catalog import ORACLE, QUERIES

    return QUERIES, ORACLE
