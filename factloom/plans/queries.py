"""All queries over the claim tables, and their DuckDB SQL."""

from __future__ import annotations

from factloom.plans import queries_jobs, queries_pipeline, queries_reads, queries_stages, queries_values

QUERIES = {**queries_values.QUERIES, **queries_pipeline.QUERIES, **queries_reads.QUERIES, **queries_stages.QUERIES, **queries_jobs.QUERIES}
ORACLES = {**queries_values.ORACLES, **queries_pipeline.ORACLES, **queries_reads.ORACLES, **queries_stages.ORACLES, **queries_jobs.ORACLES}
