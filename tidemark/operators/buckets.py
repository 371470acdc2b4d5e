"""Bucket-sort portfolios: assignment, return series and risk statistics, all as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, sample_kurtosis, sample_skewness


def month_ends(days: DataFrame) -> DataFrame:
    """The last date of each calendar month."""
    return days.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date")).select("date")


def top_by_cap(panel: DataFrame, most: int) -> DataFrame:
    """The ``most`` largest entities of each date; equal sizes by entity."""
    w = Window.partitionBy("date").orderBy(F.desc_nulls_last("marketcap"), "ticker")
    return panel.withColumn("cap_rank", F.row_number().over(w)).where(F.col("cap_rank") <= most)


def bucket_sort(panel: DataFrame, metric: str, n: int, most: int | None = None, screen: Column | None = None, at_ends: bool = False) -> DataFrame:
    """Rebalance rows with their bucket, 1 the smallest metric. Screens come before the size limit. ``at_ends``: the panel has no other rows than those of month ends."""
    d = panel if at_ends else panel.join(F.broadcast(month_ends(panel.select("date").distinct())), "date")
    if screen is not None:
        d = d.where(screen)
    if most is not None:
        d = top_by_cap(d, most)
    return d.withColumn("bucket", F.ntile(n).over(Window.partitionBy("date").orderBy(F.asc_nulls_last(metric), "ticker")))


def summary(assigned: DataFrame, metric: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and means of each bucket; ``share_delisted`` where ``assigned`` has a flag ``delisted``."""
    more = [F.avg(F.col("delisted").cast("double")).alias("share_delisted")] if "delisted" in assigned.columns else []
    return assigned.groupBy(*keys, "bucket").agg(
        F.count("fwd_ret").alias("n"), F.avg(metric).alias("mean_metric"), F.median(metric).alias("median_metric"), F.avg("fwd_ret").alias("mean_ret"), F.median("fwd_ret").alias("median_ret"),
        F.stddev_samp("fwd_ret").alias("std_ret"), F.avg(F.when(F.col("fwd_ret").isNotNull(), (F.col("fwd_ret") > 0).cast("double"))).alias("share_up"), F.avg("marketcap").alias("mean_cap"), *more,
    )


def returns(assigned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(date, bucket, ret): equal-weight return of each bucket and rebalance."""
    return assigned.groupBy(*keys, "date", "bucket").agg(F.avg("fwd_ret").alias("ret"))


def returns_by_month(series: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(month_end, bucket, ret) over every calendar month: a month without any row is 0, a bucket missing in a month is null."""
    s = series.groupBy(*keys, F.last_day("date").alias("month_end"), "bucket").agg(F.min_by("ret", "date").alias("ret"))
    held = s.groupBy(*keys).agg(F.min("month_end").alias("a"), F.max("month_end").alias("b"), F.collect_set("bucket").alias("all"), F.collect_set("month_end").alias("there"))  # as many as there are buckets and months
    months = held.select(*keys, "all", "there", F.explode(F.expr("transform(sequence(trunc(a, 'month'), trunc(b, 'month'), interval 1 month), x -> last_day(x))")).alias("month_end"))
    grid = months.select(*keys, "month_end", F.array_contains("there", F.col("month_end")).alias("active"), F.explode("all").alias("bucket"))
    d = grid.join(s, [*keys, "month_end", "bucket"], "left")
    return d.select(*keys, "month_end", "bucket", F.when(F.col("active"), F.col("ret")).otherwise(0.0).alias("ret"))


def cumulative(series: DataFrame, time: str = "date", keys: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """Growth of 1 and drawdown from the running maximum, by bucket; null where the return is."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    d = series.withColumn("growth", F.when(F.col("ret").isNotNull(), F.product(1 + F.col("ret")).over(w)))
    return d.withColumn("drawdown", ratio(F.col("growth") - F.max("growth").over(w), F.max("growth").over(w)))


def sharpe() -> Column:
    """Annualised Sharpe ratio of monthly returns as an aggregate; 0 for fewer than two values or none that vary."""
    mean, std = F.avg("ret") * 12, F.stddev_samp("ret") * F.sqrt(F.lit(12.0))
    return F.when(std > 0, mean / std).otherwise(0.0)


def performance(series: DataFrame, time: str = "date", keys: tuple[str, ...] = ("bucket",), years: Column | None = None) -> DataFrame:
    """Annualised return, volatility, Sharpe, Sortino, worst drawdown, growth rate and share of winning periods.

    Ratios without a denominator above 0 are 0. The growth rate is over the time from the first to the last row of a series, or over
    ``years``, and null where the last return is."""
    mean, std = F.avg("ret") * 12, F.stddev_samp("ret") * F.sqrt(F.lit(12.0))
    down = F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))) * F.sqrt(F.lit(12.0))
    span = F.datediff(F.max(time), F.min(time)) / 365.25 if years is None else F.max(years)
    d = cumulative(series, time, keys)
    return d.groupBy(*keys).agg(
        mean.alias("ann_return"), std.alias("ann_vol"), sharpe().alias("sharpe"), F.when(down > 0, mean / down).otherwise(0.0).alias("sortino"), F.min("drawdown").alias("max_drawdown"),
        F.when(span > 0, F.pow(F.max_by("growth", time), 1 / span) - 1).otherwise(0.0).alias("cagr"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
    )


def spread(series: DataFrame, low: int, high: int, time: str = "date") -> DataFrame:
    """Bucket ``low`` minus bucket ``high`` of each date, as a bucket 0."""
    one = lambda k: F.max(F.when(F.col("bucket") == k, F.col("ret")))
    return series.groupBy(time).agg((one(low) - one(high)).alias("ret")).select(time, F.lit(0).alias("bucket"), "ret")


def rolling_sharpe(series: DataFrame, months: int = 36, time: str = "month_end", keys: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """The Sharpe ratio of the last ``months`` rows, where all of them have a return."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(1 - months, 0)
    x = ratio(F.avg("ret").over(w) * 12, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(12.0)))
    return series.select(*keys, time, F.when(F.count("ret").over(w) == months, x).alias("sharpe"))


def sector_mix(assigned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The share of each sector in a bucket, by the keys (a strategy, a date)."""
    d = assigned.groupBy(*keys, "bucket", "sector").agg(F.count(F.lit(1)).alias("n"))
    return d.select(*keys, "bucket", "sector", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "bucket"))).alias("share"))


def turnover(assigned: DataFrame) -> DataFrame:
    """Share of a bucket's names that were not in it at the rebalance before, averaged over rebalances."""
    dates = assigned.select("date").distinct().withColumn("before", F.lag("date").over(Window.orderBy("date")))
    now = assigned.select("date", "bucket", "ticker").join(F.broadcast(dates), "date").where("before is not null")
    old = assigned.select(F.col("date").alias("before"), "bucket", "ticker", F.lit(1).alias("held"))
    d = now.join(old, ["before", "bucket", "ticker"], "left").groupBy("date", "bucket").agg(F.avg(F.when(F.col("held").isNull(), 1.0).otherwise(0.0)).alias("t"))
    return d.groupBy("bucket").agg(F.avg("t").alias("turnover"))


def shape(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("bucket").agg(sample_skewness("fwd_ret").alias("skew"), sample_kurtosis("fwd_ret").alias("kurtosis"))
