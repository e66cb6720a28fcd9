"""Registered queries with their SQL twins."""

from cinelake.plans import bitfields, clips, codetables, containers, files, grids, pictures, streams  # noqa: F401
from cinelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
