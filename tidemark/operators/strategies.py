"""Bucket-sort strategies as data: many strategies sorted and measured in one pass, keyed by strategy.

A strategy says which metric sorts, into how many buckets, among how many of the largest entities, and which rows take part.
Rows are listed under every strategy that lets them in; one exchange by (strategy, date) serves the size limit and the
sort, and every statistic is an aggregate keyed by strategy, so that a hundred strategies cost one plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import buckets as B


@dataclass(frozen=True)
class Strategy:
    """Rows need the metric above 0, a capitalisation and a forward return, besides what the fields say."""

    name: str
    metric: str
    buckets: int = 5
    most: int = 1500
    start: str | None = None
    exclude_sectors: tuple[str, ...] = ()
    #: Column -> (lowest, highest); the lowest itself counts, the highest does not, None leaves a side open.
    bands: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    #: Columns that must be above a value.
    above: dict[str, float] = field(default_factory=dict)

    def screen(self) -> Column:
        c = (F.col(self.metric) > 0) & F.col("marketcap").isNotNull() & F.col("fwd_ret").isNotNull()
        if self.start:
            c &= F.col("date") >= F.lit(self.start).cast("date")
        if self.exclude_sectors:
            c &= ~F.col("sector").isin(*self.exclude_sectors)
        for name, (lo, hi) in self.bands.items():
            c &= (F.col(name) >= lo if lo is not None else F.lit(True)) & (F.col(name) < hi if hi is not None else F.lit(True))
        for name, lo in self.above.items():
            c &= F.col(name) > lo
        return c


#: The three published strategies (fixed values).
PUBLISHED = (
    Strategy("0000_dreman_quintile_pe", "pe"),
    Strategy("0001_dreman_pcf_quintile", "pcf", start="2000-01-01", exclude_sectors=("Financial Services", "Real Estate")),
    Strategy("0004_pcf_quality_quintile", "pcf", 10, start="2000-01-01", exclude_sectors=("Financial Services", "Real Estate"), bands={"fcf_pct_positive": (0.5, None), "vix": (13, 35)}, above={"fcf_r2_10y": 0.5}),
)


def tile(place: Column, count: Column, n: Column) -> Column:
    """SQL's NTILE for a number of buckets that is a column: the first ones are a row larger where they do not divide evenly."""
    small, larger = F.floor(count / n), count % n
    first = larger * (small + 1)
    return F.when(place <= first, F.floor((place - 1) / (small + 1)) + 1).otherwise(larger + F.floor((place - 1 - first) / F.greatest(small, F.lit(1))) + 1).cast("long")


def assign(panel: DataFrame, strategies: tuple[Strategy, ...]) -> DataFrame:
    """Rows of ``panel`` (ticker, date, sector, marketcap, fwd_ret, delisted, and what the strategies name), one for each strategy that takes
    them: strategy, buckets, metric, cap_rank, bucket (1 the smallest metric). Equal sizes and metrics are ordered by entity."""
    own = ["ticker", "date", "sector", "marketcap", "fwd_ret", "delisted"]
    entry = lambda s: F.when(s.screen(), F.struct(F.lit(s.name).alias("strategy"), F.lit(s.buckets).alias("buckets"), F.lit(s.most).alias("most"), F.col(s.metric).cast("double").alias("metric")))
    d = panel.select(*own, F.explode(F.array(*map(entry, strategies))).alias("x")).where("x is not null").select(*own, "x.*")
    w = Window.partitionBy("strategy", "date")
    d = d.withColumn("cap_rank", F.row_number().over(w.orderBy(F.desc("marketcap"), "ticker")).cast("long")).where(F.col("cap_rank") <= F.col("most"))
    d = d.withColumns({"_k": F.row_number().over(w.orderBy("metric", "ticker")), "_n": F.count(F.lit(1)).over(w)})
    return d.withColumn("bucket", tile(F.col("_k"), F.col("_n"), F.col("buckets"))).drop("_k", "_n", "most")


KEYS = ("strategy",)


def spreads(months: DataFrame, sizes: DataFrame) -> DataFrame:
    """The first bucket less the last, and where there are seven or more the fourth less the last, as series named by ``spread``."""
    d = months.join(F.broadcast(sizes), "strategy")
    of = lambda k: F.max(F.when(F.col("bucket") == k, F.col("ret")))
    d = d.groupBy("strategy", "buckets", "month_end").agg(of(1).alias("one"), of(4).alias("four"), of(F.col("buckets")).alias("last"))
    both = F.array(F.struct(F.lit("first_last").alias("spread"), (F.col("one") - F.col("last")).alias("ret")), F.when(F.col("buckets") >= 7, F.struct(F.lit("fourth_last").alias("spread"), (F.col("four") - F.col("last")).alias("ret"))))
    return d.select("strategy", "month_end", F.explode(both).alias("x")).where("x is not null").select("strategy", "month_end", "x.*")


def sharpe_by_period(series: DataFrame, keys: list[str], periods: tuple[tuple[str, str], ...], time: str = "month_end") -> DataFrame:
    """The Sharpe ratio of each series within each period, both ends included; 0 for fewer than two values or none that vary."""
    inside = [F.when(F.col(time).between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.struct(F.lit(k).alias("period"), F.col("ret").alias("ret"))) for k, (a, b) in enumerate(periods)]
    listed = F.array(*[F.struct(F.lit(k).alias("period"), F.when(x.isNotNull(), x["ret"]).alias("ret")) for k, x in enumerate(inside)])
    d = series.select(*keys, F.explode(listed).alias("x")).select(*keys, "x.*")
    return d.groupBy(*keys, "period").agg(B.sharpe().alias("sharpe"))


def years(months: DataFrame, sizes: DataFrame) -> DataFrame:
    """Compounded return of the first and the last bucket by year, their difference, and whether the first wins."""
    of = lambda k: F.coalesce(F.product(F.when(F.col("bucket") == k, 1 + F.col("ret"))), F.lit(1.0)) - 1
    d = months.join(F.broadcast(sizes), "strategy").groupBy("strategy", F.year("month_end").cast("long").alias("year")).agg(of(1).alias("first"), of(F.col("buckets")).alias("last"))
    return d.withColumns({"spread": F.col("first") - F.col("last"), "first_wins": F.col("first") > F.col("last")})


def run_summary(assigned: DataFrame, summary: DataFrame, spread_stats: DataFrame, by_year: DataFrame) -> DataFrame:
    """One row a strategy: range, counts, mean returns of the first and last bucket and their difference, whether returns fall from bucket to
    bucket, the share of years that the first wins, and the Sharpe ratio of the difference. Takes the results of the functions of this module."""
    own = assigned.groupBy("strategy", "buckets").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("rebalances"), F.count(F.lit(1)).alias("n"))
    own = own.withColumn("per_bucket", F.floor(F.col("n") / F.col("rebalances") / F.col("buckets")))
    below = F.lead("mean_ret").over(Window.partitionBy("strategy").orderBy("bucket"))
    s = summary.join(own.select("strategy", "buckets"), "strategy").withColumn("falls", F.col("mean_ret") >= below)
    of = lambda k: F.max(F.when(F.col("bucket") == k, F.col("mean_ret")))
    s = s.groupBy("strategy").agg(of(1).alias("first_ret"), of(F.col("buckets")).alias("last_ret"), F.bool_and(F.coalesce("falls", F.lit(True))).alias("monotone"))
    s = s.withColumns({"spread_monthly": F.col("first_ret") - F.col("last_ret"), "spread_annual": 12 * (F.col("first_ret") - F.col("last_ret"))})
    wins = by_year.groupBy("strategy").agg(F.avg(F.col("first_wins").cast("double")).alias("win_rate"))
    sharpe = spread_stats.where("spread = 'first_last'").select("strategy", F.col("sharpe").alias("spread_sharpe"))
    return own.join(s, "strategy").join(wins, "strategy", "left").join(sharpe, "strategy", "left")
