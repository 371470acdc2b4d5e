"""Holding periods between rebalance dates that need not be trading days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .asof import asof_join, asof_next

#: Rebalances a year, by frequency.
PER_YEAR = {"monthly": 12, "quarterly": 4, "annually": 1}


def calendar(ends: DataFrame, frequencies: tuple[str, ...] = tuple(PER_YEAR)) -> DataFrame:
    """(frequency, day, next_day): the calendar period ends from ``a`` to ``b`` of the one-row frame ``ends``, each with the one after it (null for the last)."""
    months = lambda f: F.lit(12 // PER_YEAR[f])
    day = F.last_day("m")
    d = ends.select(F.explode(F.array(*[F.struct(F.lit(f).alias("frequency"), months(f).alias("step")) for f in frequencies])).alias("x"), "a", "b")
    d = d.select("x.*", "b", F.explode(F.expr("sequence(trunc(a, 'month'), trunc(b, 'month'), interval 1 month)")).alias("m")).where((F.month("m") % F.col("step") == 0) & (day <= F.last_day("b")))
    d = d.select("frequency", day.alias("day"))
    return d.withColumn("next_day", F.lead("day").over(Window.partitionBy("frequency").orderBy("day")))


def returns(held: DataFrame, bars: DataFrame, key: str = "ticker", start: str = "day", end: str = "until") -> DataFrame:
    """``held`` with entry, exit and ret: in at the first price on or after its start, out at the last one on or before its end.

    An entity that stops trading is sold at its last price; rows without either price go. Both are as-of joins by entity, for
    which only the bars of entities that are held are exchanged and sorted. ``held`` is read twice: give it as a written table where it takes work."""
    price = bars.join(held.select(key).distinct(), key, "left_semi").select(key, F.col("date").alias("_at"), F.col("closeadj").alias("_price"))
    d = asof_next(held, price.withColumnRenamed("_price", "entry"), key, start, "_at", ["entry"])
    d = asof_join(d, price.withColumnRenamed("_price", "exit"), key, end, "_at", ["exit"]).where("entry is not null and exit is not null")
    return d.withColumn("ret", ratio("exit", "entry") - 1)


def statistics(returns_: DataFrame, keys: list[str], per_year: int, ret: str = "ret") -> DataFrame:
    """Of each group: count, mean, its compounding over a year, the annualised deviation, their ratio (0 without one), share of winners, median, 5th and 95th percentile."""
    mean, std = F.avg(ret), F.stddev_samp(ret) * F.sqrt(F.lit(float(per_year)))
    annual: Column = F.pow(1 + mean, F.lit(float(per_year))) - 1
    return returns_.groupBy(*keys).agg(
        F.count(ret).alias("n"), mean.alias("mean"), annual.alias("ann_return"), std.alias("ann_std"), F.when(std > 0, annual / std).otherwise(0.0).alias("sharpe"),
        F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"), F.median(ret).alias("median"), F.percentile(ret, 0.05).alias("p05"), F.percentile(ret, 0.95).alias("p95"),
    )
