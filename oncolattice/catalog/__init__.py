"""Queries over the given tables, one or more per operator."""

from . import narrow, texts, graphs, lookups, exports, validity, rankings, decisions, agreements  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
