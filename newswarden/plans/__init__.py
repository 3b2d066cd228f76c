"""Registered queries: each name maps to a plan over the tables and, where SQL can express it, its SQL."""

from . import dictionary, domain, evaluation, landed, relational, review, search, streams, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
