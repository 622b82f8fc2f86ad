"""The registered queries over the reference's own operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.catalogue import alignment, exchange, figures, prep, reports, selection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (prep, alignment, reports, figures, selection, exchange):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
