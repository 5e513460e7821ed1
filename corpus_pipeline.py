"""The corpus pipeline: raw documents to token ids. Its stages are in maskwright/llm/pipeline.py."""

from maskwright.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
