"""All named queries; importing a module registers its queries."""

from peakweave.queries import analysis, features, learning, names, values  # noqa: F401
from peakweave.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
