"""Operators bound to the driver's tables: one Spark callable and, where SQL can say it, one SQL twin."""

from importlib import import_module

_MODULES = ("redaction", "corpus", "registry", "lineage", "documents", "features", "modelling", "metrics", "jobs", "storage")


def load() -> tuple[dict, dict]:
    """All registered queries and their SQL twins."""
    from attesta.plans.catalog import ORACLES, QUERIES

    for name in _MODULES:
        import_module(f"attesta.plans.{name}")
    return dict(QUERIES), dict(ORACLES)
