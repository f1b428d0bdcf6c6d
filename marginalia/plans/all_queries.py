"""All registered queries and their SQL."""

from marginalia.plans import judge_queries, manuscript_queries, queries
from marginalia.plans.registered import ORACLES, QUERIES

flagship = queries.flagship
__all__ = ["ORACLES", "QUERIES", "flagship", "judge_queries", "manuscript_queries", "queries"]
