"""Named queries and the SQL that each must equal."""

from __future__ import annotations

from claimweave.plans import claim_queries, queries

QUERIES = queries.QUERIES | claim_queries.QUERIES
ORACLES = queries.ORACLES | claim_queries.ORACLES
