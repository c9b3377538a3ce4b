"""Registered queries by family; importing a module registers its queries and their oracles."""
from __future__ import annotations

import importlib

FAMILIES = ["content", "links", "metadata", "policy", "routing", "verification", "arrivals", "plans"]


def load():
    from portcullis.queries import base
    for name in FAMILIES:
        importlib.import_module(f"portcullis.queries.{name}")
    return base.QUERIES, base.ORACLES
