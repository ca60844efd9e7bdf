"""All queries and their SQL."""

from interfera.plans import sets, spectra  # noqa: F401 (they register their queries)
from interfera.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
