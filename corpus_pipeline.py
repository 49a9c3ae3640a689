"""The pipeline from raw documents to token ids; its stages are in ``octetflow.llm.stages``."""

from octetflow.llm.stages import STAGES, run

#: The classifier, the shingles' XXH64 and BPE are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
