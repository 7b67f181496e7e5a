"""What every source can do."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Source(Protocol):
    """A table that can be read as a DataFrame."""

    def load(self, spark: SparkSession) -> DataFrame: ...


def sample(source: Source, spark: SparkSession, rows: int = 5) -> DataFrame:
    """The first rows; the limit goes to the source where it can take one."""
    return source.load(spark).limit(rows)


def schema(source: Source, spark: SparkSession) -> dict[str, str]:
    """Column names and types."""
    return dict(source.load(spark).dtypes)
