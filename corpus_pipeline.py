"""The corpus pipeline: documents in, training tokens out, one operator of ``sheaf.llm`` a stage."""

from __future__ import annotations

from sheaf.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
