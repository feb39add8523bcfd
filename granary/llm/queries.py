"""The queries of this folder, and SQL for those that SQL can express."""

from granary.llm import decontaminate, exact_dedup, licenses, lm_score, mixing, near_dedup, pii, quality, secrets, sharding

_MODULES = (mixing, sharding, near_dedup, pii, exact_dedup, lm_score, secrets, decontaminate, quality, licenses)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
