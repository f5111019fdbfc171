"""All queries of the library's own operators, with their DuckDB oracles."""

from __future__ import annotations

from . import lm_queries, source_queries, tensor_queries, text_queries, train_queries

QUERIES: dict = {**text_queries.QUERIES, **tensor_queries.QUERIES, **train_queries.QUERIES, **source_queries.QUERIES, **lm_queries.QUERIES}
ORACLES: dict = {**text_queries.ORACLES, **tensor_queries.ORACLES, **train_queries.ORACLES, **source_queries.ORACLES, **lm_queries.ORACLES}
FLAGSHIP = "bpe_train_k"
