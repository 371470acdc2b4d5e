"""Panel checks: each returns rows (check, subject, value, lo, hi, status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(values: DataFrame, bounds: dict[str, tuple[str, float | None, float | None]]) -> DataFrame:
    """One row a column of the one-row frame ``values``: PASS within its bounds, FAIL outside, UNKNOWN where it is null.

    ``bounds`` maps a column to (check, lowest, highest); None leaves a side open."""
    rows = [F.struct(F.lit(check).alias("check"), F.lit(name).alias("subject"), F.col(name).cast("double").alias("value"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi")) for name, (check, lo, hi) in bounds.items()]
    d = values.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    fine = (F.col("lo").isNull() | (F.col("value") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") <= F.col("hi")))
    return d.withColumn("status", F.when(F.col("value").isNull(), "UNKNOWN").when(fine, "PASS").otherwise("FAIL"))


def share(condition: Column) -> Column:
    """The share of rows that meet a condition; null counts as not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def null_rates(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(subject, rate) in one pass over all columns."""
    d = panel.agg(*[share(F.col(c).isNull()).alias(c) for c in columns])
    return d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).alias("rate")) for c in columns])).alias("x")).select("x.*")


def coverage(panel: DataFrame, key: str, columns: list[str], much: float = 50.0) -> DataFrame:
    """(key, subject, pct, flagged): the known share of each column by entity, flagged where it is 0 and over ``much`` for another."""
    d = panel.groupBy(key).agg(*[(100.0 * F.count(c) / F.count(F.lit(1))).alias(c) for c in columns])
    d = d.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).alias("pct")) for c in columns])).alias("x")).select(key, "x.*")
    most = d.groupBy("subject").agg(F.max("pct").alias("_most"))  # one row a column
    return d.join(F.broadcast(most), "subject").select(key, "subject", "pct", ((F.col("pct") == 0) & (F.col("_most") > much)).alias("flagged"))


def duplicates(panel: DataFrame, keys: list[str]) -> DataFrame:
    return panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def parity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in one table only, with the side they are on."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, keys, "left_anti").withColumn("side", F.lit("right")))
