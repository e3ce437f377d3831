"""All registered queries, and for each the SQL that must give the same rows."""

from ledgerlight.plans import graph, identity, indicators, ingestion, killtest, more, rules, tables, trials  # noqa: F401
from ledgerlight.plans import runs  # noqa: F401  after those whose SQL it takes up
from ledgerlight.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
