"""Queries that apply the operators to the driver tables."""

from importlib import import_module

from evitrust.plans.registry import REGISTRY, Tables

AREAS = ["trust_queries", "harmonize_queries", "names_queries", "panel_queries", "distance_queries", "model_queries", "source_queries", "range_queries"]


def load_all():
    for area in AREAS:
        import_module(f"evitrust.plans.{area}")
    return REGISTRY


__all__ = ["REGISTRY", "Tables", "load_all"]
