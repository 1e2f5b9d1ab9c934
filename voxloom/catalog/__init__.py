"""All registered queries."""

from voxloom.catalog import evaluation, preparation, transfer  # noqa: F401 - they register queries
from voxloom.catalog.registry import REGISTRY, Entry, Tables, query

__all__ = ["REGISTRY", "Entry", "Tables", "query"]
