"""What each layer knows of one object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diagnose(key: str, value, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Where an object stands in each layer: its rows of each table that has the key."""
    return {name: df.where(F.col(key) == value) for name, df in tables.items() if key in df.columns}
