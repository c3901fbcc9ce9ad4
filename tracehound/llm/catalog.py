"""All queries of this subpackage."""

import corpus_pipeline
from tracehound.llm import alignment, chat, chosen_path, decontaminate, fertility, html_text, importance, licenses, mixing, repeats, secrets, topk, toxicity  # noqa: F401  register their queries
from tracehound.llm.common import ORACLE, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLE", "QUERIES"]
