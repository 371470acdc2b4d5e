"""Inputs that may be absent or lack columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path`` with the columns of ``schema``, or a typed empty one where there is none.

    Columns that the table lacks are null, others are dropped; a table that is there but cannot be read raises."""
    empty = spark.createDataFrame([], schema)
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    have = set(found.columns)
    return found.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])


def first_available(df: DataFrame, *choices: tuple[tuple[str, ...], Column], default: Column | None = None) -> Column:
    """The first expression whose columns ``df`` has: each choice is (columns that it needs, expression)."""
    have = set(df.columns)
    for needs, column in choices:
        if have.issuperset(needs):
            return column
    return F.lit(None) if default is None else default
