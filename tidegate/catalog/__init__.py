"""The registered queries, one module per area."""

from tidegate.catalog import evaluation, keyed, operations, pit, quality, scalars, state, streams  # noqa: F401
from tidegate.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
