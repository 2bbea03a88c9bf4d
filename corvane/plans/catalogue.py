"""All queries of the library's operators."""

from corvane.plans import corpus, labels, search  # noqa: F401
from corvane.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
