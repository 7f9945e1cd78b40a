"""Corpus pipeline: STAGES of (name, function), each over all rows that its predecessor kept, and run()."""

from graphloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
