"""All queries of the sequence operators, and for each the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.plans import alignment, formats, profiles, scalars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = alignment.QUERIES | profiles.QUERIES | scalars.QUERIES | formats.QUERIES
SQL: dict[str, str] = alignment.SQL | profiles.SQL | scalars.SQL | formats.SQL
