"""The modules whose QUERIES and ORACLE the entry point registers."""

from importlib import import_module

NAMES = ["search", "catalogue", "facets", "scripts", "more", "library", "indexes", "streams"]


def modules() -> list:
    return [import_module(f"shotlake.plans.{n}") for n in NAMES]
