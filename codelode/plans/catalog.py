"""All core queries; importing the modules registers them."""

from codelode.plans import graph, integrity, search, texts, upkeep  # noqa: F401
from codelode.plans.registry import CORE

QUERIES = CORE.queries
ORACLE_SQL = CORE.sql
