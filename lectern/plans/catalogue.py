"""All queries of the library and their DuckDB equivalents, gathered from the plan modules."""

from lectern.plans import documents, library, notes, pages, prose, reading, structure, text  # noqa: F401  (they register on import)
from lectern.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
