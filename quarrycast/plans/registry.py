"""All queries outside the llm subpackage and their SQL."""

from __future__ import annotations

from quarrycast.plans import extraction, problems, readmodels, states, streams

FLAGSHIP = "RM2_pipeline"
PARTS = (readmodels.q, extraction.q, states.q, streams.q)
QUERIES: dict = {**problems.QUERIES, **{k: f for p in PARTS for k, f in p.queries.items()}}
SQL: dict = {**problems.SQL, **{k: f for p in PARTS for k, f in p.sql.items()}}
