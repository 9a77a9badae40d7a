"""Imports every operator, which registers its query: QUERIES and ORACLES."""

from slidemesh.llm import bpe, conversation_repair, embedding_neardup, exact_dedup, fill_middle, html_wrapper, mixing, quality_qda, quotes, sharding, simhash_ball, substring_dedup, warc_zip  # noqa: F401
from slidemesh.llm.common import ORACLES, QUERIES  # noqa: F401
