"""The corpus pipeline: STAGES, run() and ORACLE_SQL, as inkwell.llm.pipeline has them."""

from __future__ import annotations

from inkwell.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
