"""All queries on the core operators."""

from __future__ import annotations

from rillmark.plans import Registry

REGISTRY = Registry()

MODULES = ("text_queries", "metric_queries", "corpus_queries", "retrieval_queries", "stat_queries", "benchmark_queries", "relational_queries", "source_queries", "more_queries", "entity_queries")


def load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"rillmark.plans.{name}")


load()
