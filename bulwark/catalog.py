"""Registry of the robust-statistics queries and their SQL."""

from __future__ import annotations

from bulwark.queries import multivariate, scalar, univariate
from bulwark.queries.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "huber_onestep_by_flag"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "multivariate", "scalar", "univariate"]
