"""Registered queries over the given tables and the SQL they must agree with."""

from workload import (evaluation, geometry, relational, sequences,  # noqa: F401
                      sampling, jobs, summaries)
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
