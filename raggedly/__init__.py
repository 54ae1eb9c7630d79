"""Jagged event records to model-ready features, as Spark DataFrame jobs."""

from .plans.spec import ClassList, EventSpec, ObjectGroup, Treatment

__all__ = ["ClassList", "EventSpec", "ObjectGroup", "Treatment"]
