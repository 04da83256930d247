"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from trajectra.plans import motion_queries, quality_queries, report_queries

QUERIES: dict = motion_queries.QUERIES | quality_queries.QUERIES | report_queries.QUERIES
SQL: dict[str, str] = motion_queries.SQL | quality_queries.SQL | report_queries.SQL


def entry(spark, sf_dir):
    """Flagship: execution quality of every episode."""
    return motion_queries.execution_quality(spark, sf_dir)
