"""The corpus pipeline (streamloom.llm.pipeline): STAGES, run and ORACLE_SQL."""

from streamloom.llm.pipeline import ORACLE_SQL, run, STAGES

__all__ = ["ORACLE_SQL", "STAGES", "run"]
