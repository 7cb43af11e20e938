"""Registered queries, grouped as in the operator inventory."""

import importlib

GROUPS = ("scans", "columns", "parsing", "physics", "relational", "quality", "features", "models", "screening")


def load():
    """Import every query module once and return the registry."""
    from cermetry.plans import registry

    for group in GROUPS:
        importlib.import_module(f"cermetry.plans.{group}")
    return registry
