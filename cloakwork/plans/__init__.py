"""Registered queries over the given tables."""

from importlib import import_module

MODULES = [
    "sources", "mapping", "expressions", "subsetting", "masking", "policies", "discovery", "generation", "checking",
    "changes", "entities",
]


def load_queries():
    """Import every query module once and return (queries, oracles)."""
    from cloakwork.plans import registry

    for name in MODULES:
        import_module(f"cloakwork.plans.{name}_queries")
    return registry.QUERIES, registry.ORACLES
