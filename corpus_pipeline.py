"""Documents to token ids, stage by stage; each stage calls one operator of ``jobloom.llm``."""

from __future__ import annotations

from jobloom.llm.stages import STAGES, run

#: No SQL: the classifier and the tokenizer are not expressible in it.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
