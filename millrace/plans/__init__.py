"""What a physical plan does: for checks that a query stays as it was meant."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def node_counts(df: DataFrame) -> Counter:
    """How often each kind of node stands in the plan."""
    return Counter(re.findall(r"^[\s:|+*()\d-]*([A-Z]\w+)", plan_text(df), re.MULTILINE))


def read_columns(df: DataFrame) -> set[str]:
    """Columns that the scans read."""
    return {c for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan_text(df)) for c in re.findall(r"(\w+):", s)}
