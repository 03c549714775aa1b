"""Registered queries over the test tables, with their SQL twins."""

from . import combined, filed, framed, scored  # noqa: F401
from .bindings import ORACLES, QUERIES
from .scored import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
