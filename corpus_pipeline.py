"""The corpus pipeline's contract; its stages are in ``palimpsest.llm.pipeline``."""

from palimpsest.llm.pipeline import STAGES, run

#: Votes of neighbours and components are beyond SQL; tests/llm/test_pipeline.py has a plain version of each stage.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
