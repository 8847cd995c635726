"""The corpus pipeline: language, lines, near copies, benchmarks, packing."""

from __future__ import annotations

from ctxloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
