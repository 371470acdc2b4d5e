"""Queries: bucket-sort backtests."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import q4, q6, r4, r6
from ..operators import buckets as B
from ..operators.strategies import sharpe_by_period, years
from ..registry import query

N, MOST = 5, 80
_P = f"""p AS (SELECT b.ticker, b.date, closeadj, marketcap, pe, i.sector,
  {q6('0.02 * (lead(closeadj, 21) OVER w / nullif(closeadj, 0) - 1)')} AS fwd_ret, {q6('closeadj / nullif(lag(closeadj, 63) OVER w, 0) - 1')} AS ret_3m, lead(closeadj, 21) OVER w IS NULL AND isdelisted = 'Y' AS delisted
  FROM bars b JOIN instruments i ON b.ticker = i.ticker LEFT JOIN vendor v ON b.ticker = v.ticker AND b.date = v.date WINDOW w AS (PARTITION BY b.ticker ORDER BY b.date)),
me AS (SELECT max(date) AS date FROM bars GROUP BY date_trunc('month', date)),
screened AS (SELECT p.* FROM p JOIN me ON p.date = me.date WHERE ret_3m IS NOT NULL AND closeadj > 0 AND sector NOT IN ('ASIA')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY marketcap DESC NULLS LAST, ticker) AS cap_rank FROM screened),
a AS (SELECT *, ntile({N}) OVER (PARTITION BY date ORDER BY ret_3m ASC NULLS LAST, ticker) AS bucket FROM ranked WHERE cap_rank <= {MOST}),
s AS (SELECT date, bucket, {q6('avg(fwd_ret)')} AS ret FROM a GROUP BY date, bucket)"""
ROLES = "bars instruments vendor"


def panel(r, at_ends=False):
    """Rows with a 21-row forward return, damped by 0.02 because the synthetic prices jump, and a 63-row past return.

    ``at_ends``: only those of month ends, which are picked before anything is joined to them."""
    r.keep("bars")
    ends = F.broadcast(B.month_ends(r.bars))
    picked = lambda d: d.join(ends, "date", "left_semi") if at_ends else d
    w = Window.partitionBy("ticker").orderBy("date")
    bars = r.bars.withColumns({"fwd_ret": r6(0.02 * (F.try_divide(F.lead("closeadj", 21).over(w), "closeadj") - 1)), "ret_3m": r6(F.try_divide("closeadj", F.lag("closeadj", 63).over(w)) - 1), "_last": F.lead("closeadj", 21).over(w).isNull()})
    bars = picked(bars).join(r.instruments.select("ticker", "sector", "isdelisted"), "ticker").withColumn("delisted", F.col("_last") & (F.col("isdelisted") == "Y")).drop("_last", "isdelisted")
    return bars.join(picked(r.vendor.select("ticker", "date", "marketcap", "pe")), ["ticker", "date"], "left")


SCREEN = "ret_3m is not null and closeadj > 0 and sector not in ('ASIA')"


def assigned(r):
    return B.bucket_sort(panel(r, True), "ret_3m", N, MOST, F.expr(SCREEN), at_ends=True)


def series(r):
    return B.returns(assigned(r)).withColumn("ret", r6("ret"))


def rounded(d, *names):
    return d.withColumns({c: r6(c) for c in names})


@query("rebalance_dates", "bars", "SELECT max(date) AS date FROM bars GROUP BY date_trunc('month', date)")
def rebalance_dates(r):
    return B.month_ends(r.bars)


@query("month_end_rows", ROLES, f"WITH {_P} SELECT p.ticker, p.date, p.fwd_ret FROM p JOIN me ON p.date = me.date")
def month_end_rows(r):
    return panel(r, True).select("ticker", "date", "fwd_ret")


@query("top_n_by_cap", ROLES, f"WITH {_P} SELECT ticker, date, cap_rank FROM ranked WHERE cap_rank <= 10")
def top_n_by_cap(r):
    return B.top_by_cap(panel(r, True).where(SCREEN), 10).select("ticker", "date", F.col("cap_rank").cast("long").alias("cap_rank"))


@query("bucket_assign", ROLES, f"WITH {_P} SELECT ticker, date, bucket, ret_3m, fwd_ret FROM a")
def bucket_assign(r):
    return assigned(r).select("ticker", "date", F.col("bucket").cast("long").alias("bucket"), "ret_3m", "fwd_ret")


_SUMMARY = ", ".join(f"{q6(e)} AS {n}" for n, e in (("mean_metric", "avg(ret_3m)"), ("median_metric", "median(ret_3m)"), ("mean_ret", "avg(fwd_ret)"), ("median_ret", "median(fwd_ret)"), ("std_ret", "stddev_samp(fwd_ret)"), ("share_up", "avg(CASE WHEN fwd_ret > 0 THEN 1.0 WHEN fwd_ret IS NOT NULL THEN 0.0 END)"), ("mean_cap", "avg(marketcap) / 1e6"), ("share_delisted", "avg(CASE WHEN delisted THEN 1.0 WHEN NOT delisted THEN 0.0 END)")))


@query("bucket_summary", ROLES, f"WITH {_P} SELECT bucket, count(fwd_ret) AS n, {_SUMMARY} FROM a GROUP BY bucket")
def bucket_summary(r):
    d = B.summary(assigned(r), "ret_3m").withColumn("mean_cap", F.col("mean_cap") / 1e6).withColumn("bucket", F.col("bucket").cast("long"))
    return rounded(d, "mean_metric", "median_metric", "mean_ret", "median_ret", "std_ret", "share_up", "mean_cap", "share_delisted")


_MONTHS = """m AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', (SELECT min(date) FROM s)), date_trunc('month', (SELECT max(date) FROM s)), INTERVAL 1 MONTH)) AS DATE)) AS month_end),
g AS (SELECT month_end, bucket FROM m CROSS JOIN (SELECT DISTINCT bucket FROM s)),
ts AS MATERIALIZED (SELECT g.month_end, g.bucket, CASE WHEN g.month_end IN (SELECT last_day(date) FROM s) THEN s.ret ELSE 0.0 END AS ret FROM g LEFT JOIN s ON last_day(s.date) = g.month_end AND s.bucket = g.bucket)"""


def months(r):
    """(month_end, bucket, ret) on the calendar: what growth, drawdowns, Sharpe ratios and years are worked out on."""
    return B.returns_by_month(series(r)).withColumn("bucket", F.col("bucket").cast("long"))


@query("bucket_returns_ts", ROLES, f"WITH {_P}, {_MONTHS} SELECT month_end, {', '.join(f'max(CASE WHEN bucket = {k} THEN ret END) AS q{k}' for k in range(1, N + 1))}, max(CASE WHEN bucket = 1 THEN ret END) - max(CASE WHEN bucket = {N} THEN ret END) AS q1_q{N} FROM ts GROUP BY month_end")
def bucket_returns_ts(r):
    d = months(r).groupBy("month_end").pivot("bucket", list(range(1, N + 1))).agg(F.max("ret"))
    return d.select("month_end", *[F.col(str(k)).alias(f"q{k}") for k in range(1, N + 1)], (F.col("1") - F.col(str(N))).alias(f"q1_q{N}"))


@query("bucket_annual_returns", ROLES, f"WITH {_P}, {_MONTHS} SELECT bucket, year(month_end) AS year, {q6('coalesce(product(1 + ret), 1) - 1')} AS ret FROM ts GROUP BY ALL")
def bucket_annual_returns(r):
    return months(r).groupBy("bucket", F.year("month_end").cast("long").alias("year")).agg(r6(F.coalesce(F.product(1 + F.col("ret")), F.lit(1.0)) - 1).alias("ret"))


@query("bucket_sector_mix", ROLES, f"WITH {_P} SELECT bucket, sector, {q6('count(*) / sum(count(*)) OVER (PARTITION BY bucket)')} AS share FROM a GROUP BY bucket, sector")
def bucket_sector_mix(r):
    return B.sector_mix(assigned(r)).withColumns({"bucket": F.col("bucket").cast("long"), "share": r6("share")})


@query("bucket_holdings", ROLES, f"WITH {_P} SELECT date, {', '.join(f'count(*) FILTER (bucket = {k}) AS q{k}' for k in range(1, N + 1))} FROM a GROUP BY date")
def bucket_holdings(r):
    d = assigned(r).groupBy("date").pivot("bucket", list(range(1, N + 1))).count().fillna(0)
    return d.select("date", *[F.col(str(k)).alias(f"q{k}") for k in range(1, N + 1)])


@query("bucket_return_shape", ROLES, f"WITH {_P} SELECT bucket, {q6('skewness(fwd_ret)')} AS skew, {q6('kurtosis(fwd_ret)')} AS kurtosis FROM a GROUP BY bucket")
def bucket_return_shape(r):
    return rounded(B.shape(assigned(r)).withColumn("bucket", F.col("bucket").cast("long")), "skew", "kurtosis")


_C = "c AS (SELECT *, product(1 + ret) OVER (PARTITION BY bucket ORDER BY month_end) AS growth FROM ts), dd AS (SELECT *, growth / max(growth) OVER (PARTITION BY bucket ORDER BY month_end) - 1 AS drawdown FROM c)"


@query("bucket_cumulative", ROLES, f"WITH {_P}, {_MONTHS}, {_C} SELECT month_end, bucket, {q6('CASE WHEN ret IS NOT NULL THEN growth END')} AS growth, {q6('CASE WHEN ret IS NOT NULL THEN drawdown END')} AS drawdown FROM dd")
def bucket_cumulative(r):
    return rounded(B.cumulative(months(r), "month_end").select("month_end", "bucket", "growth", "drawdown"), "growth", "drawdown")


@query("worst_drawdown", ROLES, f"WITH {_P}, {_MONTHS}, {_C}, x AS (SELECT *, {q6('drawdown')} AS r FROM dd WHERE ret IS NOT NULL) SELECT bucket, min(r) AS drawdown, arg_min(month_end, (r, month_end)) AS month_end FROM x GROUP BY bucket")
def worst_drawdown(r):
    d = rounded(B.cumulative(months(r), "month_end"), "drawdown").where("drawdown is not null")
    return d.groupBy("bucket").agg(F.min("drawdown").alias("drawdown"), F.min_by("month_end", F.struct("drawdown", "month_end")).alias("month_end"))


_STD, _DOWN = "stddev_samp(ret) * sqrt(12)", "stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(12)"
_PERF = {
    "ann_return": "avg(ret) * 12", "ann_vol": _STD, "sharpe": f"CASE WHEN {_STD} > 0 THEN avg(ret) * 12 / ({_STD}) ELSE 0 END", "sortino": f"CASE WHEN {_DOWN} > 0 THEN avg(ret) * 12 / ({_DOWN}) ELSE 0 END",
    "max_drawdown": "min(drawdown)", "cagr": "pow(max(CASE WHEN month_end = (SELECT max(month_end) FROM ts) AND ret IS NOT NULL THEN growth END), 365.25 / datediff('day', min(month_end), max(month_end))) - 1", "win_rate": "avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END)",
}
PERF_COLUMNS = ", ".join(f"{q6(e)} AS {n}" for n, e in _PERF.items())


@query("performance_table", ROLES, f"WITH {_P}, {_MONTHS}, {_C} SELECT bucket, {PERF_COLUMNS} FROM dd GROUP BY bucket")
def performance_table(r):
    return rounded(B.performance(months(r), "month_end"), *_PERF)


_SPREAD = f"sp AS (SELECT month_end, 0::BIGINT AS bucket, max(CASE WHEN bucket = 1 THEN ret END) - max(CASE WHEN bucket = {N} THEN ret END) AS ret FROM ts GROUP BY month_end)"


@query("long_short_stats", ROLES, f"WITH {_P}, {_MONTHS}, {_SPREAD}, {_C.replace('FROM ts)', 'FROM sp)')} SELECT bucket, {PERF_COLUMNS} FROM dd GROUP BY bucket")
def long_short_stats(r):
    return rounded(B.performance(B.spread(months(r), 1, N, "month_end"), "month_end").withColumn("bucket", F.col("bucket").cast("long")), *_PERF)


@query("bucket_spread", ROLES, f"WITH {_P}, m AS (SELECT bucket, {q4('avg(fwd_ret)')} AS ret FROM a GROUP BY bucket) SELECT {q6(f'max(CASE WHEN bucket = 1 THEN ret END) - max(CASE WHEN bucket = {N} THEN ret END)')} AS monthly, {q6(f'12 * (max(CASE WHEN bucket = 1 THEN ret END) - max(CASE WHEN bucket = {N} THEN ret END))')} AS annual, bool_and(coalesce(down, true)) AS monotone FROM (SELECT *, ret >= lead(ret) OVER (ORDER BY bucket) AS down FROM m)")
def bucket_spread(r):
    """From the pooled mean of each bucket, rounded to four decimals as in the summary."""
    m = B.summary(assigned(r), "ret_3m").select("bucket", r4("mean_ret").alias("ret"))
    m = m.withColumn("down", F.col("ret") >= F.lead("ret").over(Window.orderBy("bucket")))
    gap = F.max(F.when(F.col("bucket") == 1, F.col("ret"))) - F.max(F.when(F.col("bucket") == N, F.col("ret")))
    return m.agg(r6(gap).alias("monthly"), r6(12 * gap).alias("annual"), F.bool_and(F.coalesce("down", F.lit(True))).alias("monotone"))


_ROLL = "(PARTITION BY bucket ORDER BY month_end ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)"
_ROLLING = f"roll AS (SELECT month_end, bucket, CASE WHEN count(ret) OVER {_ROLL} = 36 THEN avg(ret) OVER {_ROLL} * 12 / nullif(stddev_samp(ret) OVER {_ROLL} * sqrt(12), 0) END AS sharpe FROM ts)"


@query("rolling_sharpe", ROLES, f"WITH {_P}, {_MONTHS}, {_ROLLING} SELECT month_end, bucket, {q6('sharpe')} AS sharpe FROM roll")
def rolling_sharpe(r):
    return rounded(B.rolling_sharpe(months(r)), "sharpe")


_ROLL_STATS = {"mean": F.avg, "lowest": F.min, "highest": F.max, "std": F.stddev_samp}


@query("rolling_sharpe_summary", ROLES, f"WITH {_P}, {_MONTHS}, {_ROLLING} SELECT bucket, count(sharpe) AS windows, {', '.join(f'{q6(f'{e}(sharpe)')} AS {k}' for k, e in (('mean', 'avg'), ('lowest', 'min'), ('highest', 'max'), ('std', 'stddev_samp')))} FROM roll GROUP BY bucket")
def rolling_sharpe_summary(r):
    d = B.rolling_sharpe(months(r)).groupBy("bucket").agg(F.count("sharpe").alias("windows"), *[f("sharpe").alias(k) for k, f in _ROLL_STATS.items()])
    return rounded(d, *_ROLL_STATS)


#: Fixed periods that are compared.
PERIODS = (("1995-01-01", "1998-12-31"), ("1999-01-01", "2001-12-31"))
_SHARPE = f"CASE WHEN {_STD} > 0 THEN avg(ret) * 12 / ({_STD}) ELSE 0 END"


@query("split_sample_sharpe", ROLES, f"WITH {_P}, {_MONTHS}, k AS ({' UNION ALL '.join(f'SELECT bucket, {k} AS period, CASE WHEN month_end BETWEEN DATE {a!r} AND DATE {b!r} THEN ret END AS ret FROM ts' for k, (a, b) in enumerate(PERIODS))}) SELECT bucket, period, {q6(_SHARPE)} AS sharpe FROM k GROUP BY bucket, period")
def split_sample_sharpe(r):
    return rounded(sharpe_by_period(months(r), ["bucket"], PERIODS), "sharpe")


@query("yearly_consistency", ROLES, f"WITH {_P}, {_MONTHS}, y AS (SELECT year(month_end) AS year, bucket, coalesce(product(1 + ret), 1) - 1 AS ret FROM ts GROUP BY ALL), ends AS (SELECT year, max(CASE WHEN bucket = 1 THEN ret END) AS a, max(CASE WHEN bucket = {N} THEN ret END) AS z FROM y GROUP BY year) SELECT year, {q6('a')} AS first_ret, {q6('z')} AS last_ret, a > z AS first_beats_last, {q6('avg(CASE WHEN a > z THEN 1.0 ELSE 0.0 END) OVER ()')} AS win_rate, {q6('product(1 + a) OVER (ORDER BY year) - 1')} AS first_to_date FROM ends")
def yearly_consistency(r):
    """Compounded return of the first and last bucket by year, which is higher, in what share of years the first is, and the first's total up to each year."""
    d = years(months(r).withColumn("strategy", F.lit("one")), r.spark.range(1).select(F.lit("one").alias("strategy"), F.lit(N).alias("buckets")))
    w = Window.partitionBy("strategy")
    to_date = F.product(1 + F.col("first")).over(w.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)) - 1
    rate = F.avg(F.col("first_wins").cast("double")).over(w)
    return d.select("year", r6("first").alias("first_ret"), r6("last").alias("last_ret"), F.col("first_wins").alias("first_beats_last"), r6(rate).alias("win_rate"), r6(to_date).alias("first_to_date"))


@query("bucket_turnover", ROLES, f"WITH {_P}, d AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM a)), t AS (SELECT a.date, a.bucket, avg(CASE WHEN o.ticker IS NULL THEN 1.0 ELSE 0.0 END) AS t FROM a JOIN d ON a.date = d.date LEFT JOIN a o ON o.date = d.before AND o.bucket = a.bucket AND o.ticker = a.ticker WHERE before IS NOT NULL GROUP BY ALL) SELECT bucket, {q6('avg(t)')} AS turnover FROM t GROUP BY bucket")
def bucket_turnover(r):
    return rounded(B.turnover(assigned(r)).withColumn("bucket", F.col("bucket").cast("long")), "turnover")


@query("benchmark_cumulative", "bars benchmark_bars", f"WITH me AS (SELECT max(date) AS date FROM bars GROUP BY date_trunc('month', date)), b AS (SELECT me.date, coalesce(closeadj / lag(closeadj) OVER (ORDER BY me.date) - 1, 0) AS ret FROM me LEFT JOIN benchmark_bars x ON me.date = x.date) SELECT date, {q6('product(1 + ret) OVER (ORDER BY date)')} AS growth FROM b")
def benchmark_cumulative(r):
    d = B.month_ends(r.bars).join(r.benchmark_bars, "date", "left").withColumn("bucket", F.lit(0))
    d = d.withColumn("ret", F.coalesce(F.try_divide("closeadj", F.lag("closeadj").over(Window.partitionBy("bucket").orderBy("date"))) - 1, F.lit(0.0)))
    return B.cumulative(d).select("date", r6("growth").alias("growth"))


@query("run_summary", ROLES, f"WITH {_P} SELECT min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS rebalances, count(*) AS n, count(DISTINCT ticker) AS tickers FROM a")
def run_summary(r):
    return assigned(r).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("rebalances"), F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("tickers"))
