"""Every registered query of the review engine and its SQL."""

from __future__ import annotations

from . import jobs, review


def queries() -> dict:
    return review.QUERIES | jobs.QUERIES


def oracle_sql() -> dict:
    return review.ORACLE | jobs.ORACLE
