"""Checks that raise ValueError before a plan is built or run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [x for x in names if x not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def require_none(df: DataFrame, condition: Column, message: str) -> None:
    """Raise if any row meets the condition (stops at the first one)."""
    if not df.where(condition).limit(1).isEmpty():
        raise ValueError(message)
