"""The five-stage training corpus pipeline (see lamella.llm.pipeline): STAGES, ORACLE_SQL and run(spark, sf_dir)."""

from __future__ import annotations

from lamella.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
