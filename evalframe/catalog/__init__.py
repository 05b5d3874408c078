"""Query catalogue: every registered query with its DuckDB oracle."""

from evalframe.catalog import evaluate_q, infer_q, io_q, prompts_q, qa, rubric_q, runs_q, stream_q, text_q  # noqa: F401  (registers queries)
from evalframe.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
