"""Plain and vintage time series: cleaning, resampling, vintage-correct values, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .asof import asof_join


def clean(raw: DataFrame) -> DataFrame:
    """(date, value) of landed text rows: unreadable values go, the last of equal dates stays. Takes date, value, at."""
    d = raw.select(F.try_to_date("date").alias("date"), F.expr("try_cast(value as double)").alias("value"), "at").where("date is not null and value is not null")
    return d.groupBy("date").agg(F.max_by("value", "at").alias("value"))


def business_days(series: DataFrame) -> DataFrame:
    """Every weekday from the first to the last date of each series, values carried forward. Takes series, date, value."""
    ends = series.groupBy("series").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = ends.select("series", F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)
    return asof_join(days, series.withColumn("own", F.col("date")), "series", "date", "own", ["value"])


def vintage_asof(days: DataFrame, vintages: DataFrame) -> DataFrame:
    """``days`` (date) with what was known: the latest vintage by then, in it the latest observation, its value.

    Equal observations of a vintage count with the largest value. Takes observation_date, vintage_date, value."""
    v = vintages.groupBy("vintage_date", "observation_date").agg(F.max("value").alias("value")).withColumn("one", F.lit(1))
    d = asof_join(days.withColumn("one", F.lit(1)), v.select("one", "vintage_date").distinct().withColumn("vintage", F.col("vintage_date")), "one", "date", "vintage_date", ["vintage"]).drop("one")
    v = v.select(F.col("vintage_date").alias("vintage"), F.col("observation_date").alias("at"), F.col("observation_date").alias("observed"), "value")
    return asof_join(d, v, "vintage", "date", "at", ["observed", "value"])


def carried(days: DataFrame, series: DataFrame) -> DataFrame:
    """Days by series with the last value up to each. Takes days (series, date) and series (series, date, value)."""
    return asof_join(days, series.withColumn("own", F.col("date")), "series", "date", "own", ["value"])


def with_change(series: DataFrame, rows: int, name: str) -> DataFrame:
    w = Window.partitionBy("series").orderBy("date")
    return series.withColumn(name, F.col("value") - F.lag("value", rows).over(w))


def with_growth(series: DataFrame, rows: int, name: str) -> DataFrame:
    """Percent change against the value ``rows`` rows before."""
    before = F.lag("value", rows).over(Window.partitionBy("series").orderBy("date"))
    return series.withColumn(name, ratio(F.col("value") - before, before) * 100)


def real_rate(rate: str | None, inflation: str | None) -> Column:
    """A nominal rate less inflation, null where inflation is not known yet; without an inflation series the rate itself, without a rate null."""
    if rate is None:
        return F.lit(None).cast("double")
    return F.col(rate) if inflation is None else F.col(rate) - F.col(inflation)


def benchmark_trend(bars: DataFrame) -> DataFrame:
    """Above its 200-row average (1.0 or 0.0), and returns over 21, 63, 126 and 252 rows. Takes ticker, date, closeadj."""
    w = Window.partitionBy("ticker").orderBy("date")
    back = lambda n: ratio(F.col("closeadj"), F.lag("closeadj", n).over(w)) - 1
    above = F.when(F.col("closeadj") > F.avg("closeadj").over(w.rowsBetween(-199, 0)), 1.0).otherwise(0.0)
    return bars.withColumns({"above_ma200": above} | {f"ret_{k}": back(n) for k, n in (("1m", 21), ("3m", 63), ("6m", 126), ("12m", 252))})
