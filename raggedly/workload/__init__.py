"""All registered queries."""

from . import vectors, files, features, evaluation, jobs, artifacts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
