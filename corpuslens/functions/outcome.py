"""Run outcomes, provenance and map freshness as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.text import is_blank

# Outcome codes, freshness labels, and the bound between them.
OK, NO_STATUS, FAILED = 0, 2, 3
FRESH, SLIGHTLY_STALE, UNKNOWN = "Fresh", "SlightlyStale", "Unknown"
SLIGHTLY_STALE_MAX_COMMITS = 10
EMPTY_RESPONSE = "[error] harness exited 0 but produced an empty response"


def is_empty_success(exit_code: Column, response: Column) -> Column:
    return F.coalesce((exit_code == 0) & is_blank(response), F.lit(False))


def recorded_exit(exit_code: Column, response: Column) -> Column:
    """Exit code to record: a success with a blank answer counts as failed."""
    return F.when(is_empty_success(exit_code, response), F.lit(FAILED)).otherwise(exit_code)


def recorded_response(exit_code: Column, response: Column) -> Column:
    return F.when(is_empty_success(exit_code, response), F.lit(EMPTY_RESPONSE)).otherwise(response)


def outcome(exit_code: Column) -> Column:
    return F.when(exit_code.isNull(), NO_STATUS).when(exit_code == 0, OK).otherwise(FAILED)


def freshness(commits_behind: Column) -> Column:
    return (
        F.when(commits_behind == 0, FRESH)
        .when(commits_behind.between(1, SLIGHTLY_STALE_MAX_COMMITS), SLIGHTLY_STALE)
        .otherwise(UNKNOWN)
    )


def provenance(before: Column, after: Column) -> Column:
    """Value to record: the one after the run, else the one before it."""
    return F.coalesce(after, before)


def provenance_changed(before: Column, after: Column) -> Column:
    return ~before.eqNullSafe(after)
