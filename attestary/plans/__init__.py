"""Plans: the operators composed into named queries."""

import importlib

MODULES = ["admit", "texts", "provenance", "retrieve", "contexts", "filling", "forms", "reporting",
           "scoring", "live", "stored", "chat", "uploads"]


def load():
    for name in MODULES:
        importlib.import_module(f"attestary.plans.{name}")
    registry = importlib.import_module("attestary.plans.registry")
    return registry.QUERIES, registry.ORACLES
