"""The registered queries and their SQL."""

from . import graph, reading, retrieval, search, text  # noqa: F401  (they register themselves)
from .base import ORACLE, QUERIES  # noqa: F401
