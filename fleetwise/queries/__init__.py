"""All registered queries, each with its checking SQL where one exists."""

from fleetwise.queries import analysis, learning, stores, tables  # noqa: F401  (they register)
from fleetwise.queries.base import REGISTRY, Entry

__all__ = ["REGISTRY", "Entry"]
