"""All queries over the driver's tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from kinetra.plans import event_queries, grouped_queries, identity_queries, link_queries, motion_queries, pose_queries, review_queries, store_queries, study_queries, track_queries

_PARTS = (track_queries, pose_queries, motion_queries, identity_queries, review_queries, study_queries, grouped_queries, link_queries, event_queries, store_queries)
QUERIES = {k: q for part in _PARTS for k, q in part.QUERIES.items()}
ORACLE_SQL = {k: q for part in _PARTS for k, q in part.ORACLE_SQL.items()}
FLAGSHIP = "sequence_scores"
