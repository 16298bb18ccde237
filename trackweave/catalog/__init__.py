"""All registered queries with the SQL that checks them."""

from trackweave.catalog import (  # noqa: F401
    bundles,
    files,
    learning,
    relational,
    samples,
    scoring,
    signals,
    streams,
)
from trackweave.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
