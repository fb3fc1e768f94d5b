"""All queries of the library and their SQL, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumaspan.plans import MODULES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
