"""Every query of the engine by name, and the SQL that must give the same rows."""

from trackloom.plans.oracle import ORACLE_SQL
from trackloom.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
