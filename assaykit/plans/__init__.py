"""Query catalogue."""

from __future__ import annotations

import importlib

MODULES = ["q_detect", "q_profile", "q_validate", "q_warehouse", "q_reports", "q_registry", "q_sources", "q_streaming"]


def load_all():
    """Import every query module and return the catalogue."""
    from .catalog import QUERIES

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES
