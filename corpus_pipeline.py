"""The corpus pipeline over ``documents``: its stages, ``run`` and oracle SQL (see ``tessera.llm.pipeline``)."""

from tessera.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
