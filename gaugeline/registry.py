"""All registered queries of the analytics operators."""

from .plans import generated, more, policies, records, rewards, series, texts  # noqa: F401  register their queries
from .plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "a1_stage_distribution"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
