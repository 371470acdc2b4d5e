"""Queries: the month-end panel and the published strategies on it."""

from pyspark.sql import functions as F

from ..functions.columns import q4, q6, r4, r6
from ..operators import buckets as B
from ..operators import fundamentals as FU
from ..operators import series as S
from ..operators import strategies as ST
from ..operators import universe as U
from ..registry import query
from ..sources.stages import written
from .q_features import PIT
from .q_quality import metrics
from .q_universe import CORE, LABELS, UNIVERSE

ROLES = "bars instruments actions vendor art arq ary series"
COLUMNS = ("sector", "marketcap", "pe", "pcf", "fcf_r2_10y", "fcf_pct_positive", "vix", "fwd_ret_21td", "fwd_holding_days_21td", "fwd_delisted_21td")
PANEL = f"""WITH {CORE}, {UNIVERSE}{LABELS}, {PIT}, ends AS (SELECT max(date) AS date FROM universe GROUP BY date_trunc('month', date)),
mp AS MATERIALIZED (SELECT u.ticker, u.date, u.sector, u.marketcap_daily AS marketcap, pit.pe, pit.pcf, fcf_r2_10y, fcf_pct_positive, x.value AS vix, fwd_ret_21td, fwd_holding_days_21td, fwd_delisted_21td
FROM universe u JOIN ends ON u.date = ends.date JOIN pit ON pit.ticker = u.ticker AND pit.date = u.date LEFT JOIN labels l ON l.ticker = u.ticker AND l.date = u.date ASOF LEFT JOIN series x ON u.date >= x.date)"""


def month_panel(r):
    """The universe at month ends with what strategies ask for. Bars are made once, from lines dealt by entity, and only each entity's last bar
    of a month is written, with its capitalisation and labels; filings are looked up for the rows of month ends, which are one date a month."""
    quality = metrics(r).select("ticker", "vintage", "fcf_r2_10y", "fcf_pct_positive")
    r.put("spans", written(r.lines.groupBy("ticker").agg(F.min("date").alias("firstpricedate"), F.max("date").alias("lastpricedate"))))
    r.put("marked", written(r.marked))
    terminal = written(U.terminal_events(U.clean_actions(r.actions)))
    last = r.keep().write("last", U.month_last(r.dealt("bars"), r.instruments, U.removals(terminal), 21))
    grid = last.join(F.broadcast(B.month_ends(last)), "date", "left_semi").withColumn("marketcap", F.bround("marketcap").cast("long"))
    grid = U.labelled(grid, terminal, (21,)).select("ticker", "date", "closeadj", "sector", "marketcap", *[c for c in COLUMNS if c.startswith("fwd_")])
    d = FU.fundamental_pit(grid, r.art, quality)
    days = d.select("date").distinct().withColumn("series", F.lit("vix"))
    vix = S.carried(days, r.series.withColumn("series", F.lit("vix"))).select("date", F.col("value").alias("vix"))
    d = d.join(F.broadcast(vix), "date", "left")
    return d.select("ticker", "date", *[r6(c).alias(c) if c in ("pe", "pcf", "fcf_r2_10y", "fcf_pct_positive", "fwd_ret_21td") else c for c in COLUMNS])


@query("month_end_panel", ROLES, f"{PANEL} SELECT * FROM mp")
def month_end_panel(r):
    return month_panel(r)


def _where(s):
    out = [f"{s.metric} > 0", "marketcap IS NOT NULL", "fwd_ret IS NOT NULL"]
    out += [f"date >= DATE '{s.start}'"] * bool(s.start)
    out += [f"sector NOT IN ({', '.join(repr(x) for x in s.exclude_sectors)})"] * bool(s.exclude_sectors)
    out += [f"{c} >= {lo}" for c, (lo, _) in s.bands.items() if lo is not None] + [f"{c} < {hi}" for c, (_, hi) in s.bands.items() if hi is not None]
    return " AND ".join(out + [f"{c} > {lo}" for c, lo in s.above.items()])


def _assigned_sql(s):
    return f"""SELECT '{s.name}' AS strategy, {s.buckets} AS buckets, ticker, date, sector, marketcap, fwd_ret, delisted, metric, cap_rank, ntile({s.buckets}) OVER (PARTITION BY date ORDER BY metric, ticker) AS bucket
FROM (SELECT *, {s.metric} AS metric, row_number() OVER (PARTITION BY date ORDER BY marketcap DESC, ticker) AS cap_rank FROM damped WHERE {_where(s)}) WHERE cap_rank <= {s.most}"""


#: Forward returns count a fiftieth here, since prices of the synthetic tables jump; the published quality screen leaves few of their rows.
DAMP = 0.02
ASSIGNED = f"""{PANEL}, damped AS (SELECT * EXCLUDE (fwd_ret_21td, fwd_delisted_21td), {q6(f'{DAMP} * fwd_ret_21td')} AS fwd_ret, fwd_delisted_21td AS delisted FROM mp),
a AS MATERIALIZED ({' UNION ALL '.join(_assigned_sql(s) for s in ST.PUBLISHED)}),
s AS (SELECT strategy, buckets, date, bucket, {q6('avg(fwd_ret)')} AS ret FROM a GROUP BY ALL),
span AS (SELECT strategy, unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS m FROM s GROUP BY strategy),
months AS (SELECT g.strategy, g.buckets, g.bucket, last_day(CAST(m AS DATE)) AS month_end, CASE WHEN exists(SELECT 1 FROM s t WHERE t.strategy = g.strategy AND last_day(t.date) = last_day(CAST(m AS DATE))) THEN s.ret ELSE 0.0 END AS ret
  FROM (SELECT DISTINCT strategy, buckets, bucket FROM s) g JOIN span USING (strategy) LEFT JOIN s ON s.strategy = g.strategy AND s.bucket = g.bucket AND last_day(s.date) = last_day(CAST(m AS DATE)))"""


def assigned(r):
    """The sorted rows of all strategies as a written table, which the statistics of a run share."""
    d = month_panel(r).withColumns({"fwd_ret": r6(DAMP * F.col("fwd_ret_21td")), "delisted": F.col("fwd_delisted_21td")})
    return r.keep().write("assigned", ST.assign(d, ST.PUBLISHED))


def months(a):
    """(strategy, month_end, bucket, ret) on the calendar."""
    return B.returns_by_month(B.returns(a, ST.KEYS).withColumn("ret", r6("ret")), ST.KEYS)


def sizes(a):
    return a.select("strategy", "buckets").distinct()


@query("strategy_assign", ROLES, f"{ASSIGNED} SELECT strategy, ticker, date, metric, cap_rank, bucket, fwd_ret FROM a")
def strategy_assign(r):
    return assigned(r).select("strategy", "ticker", "date", "metric", "cap_rank", "bucket", "fwd_ret")


_SUMMARY = {"mean_metric": "avg(metric)", "median_metric": "median(metric)", "mean_ret": "avg(fwd_ret)", "median_ret": "median(fwd_ret)", "std_ret": "stddev_samp(fwd_ret)", "share_up": "avg(CASE WHEN fwd_ret > 0 THEN 1.0 ELSE 0.0 END)", "mean_cap": "avg(marketcap)", "share_delisted": "avg(CASE WHEN delisted THEN 1.0 WHEN NOT delisted THEN 0.0 END)"}
SUMMARY_SQL = f"summary AS (SELECT strategy, bucket, count(fwd_ret) AS n, {', '.join(f'{q4(e)} AS {k}' for k, e in _SUMMARY.items())} FROM a GROUP BY strategy, bucket)"


def summary(a):
    """Rounded to four decimals, as the published tables are; differences of buckets are taken from these."""
    return B.summary(a, "metric", ST.KEYS).withColumns({c: r4(c) for c in _SUMMARY})


@query("strategy_summary", ROLES, f"{ASSIGNED}, {SUMMARY_SQL} SELECT * FROM summary")
def strategy_summary(r):
    return summary(assigned(r))


def _performance_sql(source, by):
    """Statistics of series with (month_end, ret) by some columns, the time from a strategy's first month to its last."""
    w = f"(PARTITION BY {by} ORDER BY month_end)"
    down = "stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(12)"
    cols = {
        "ann_return": "avg(ret) * 12", "ann_vol": "stddev_samp(ret) * sqrt(12)", "sharpe": "CASE WHEN stddev_samp(ret) * sqrt(12) > 0 THEN avg(ret) * 12 / (stddev_samp(ret) * sqrt(12)) ELSE 0 END", "sortino": f"CASE WHEN {down} > 0 THEN avg(ret) * 12 / ({down}) ELSE 0 END",
        "max_drawdown": "min(drawdown)", "cagr": "CASE WHEN max(span) > 0 THEN pow(max(CASE WHEN month_end = last_month THEN growth END), 1 / max(span)) - 1 ELSE 0 END", "win_rate": "avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END)",
    }
    return f"""(SELECT {by}, {', '.join(f'{q6(e)} AS {k}' for k, e in cols.items())} FROM (SELECT *, growth / max(growth) OVER {w} - 1 AS drawdown, max(month_end) OVER (PARTITION BY {by}) AS last_month FROM (
  SELECT *, CASE WHEN ret IS NOT NULL THEN product(1 + ret) OVER {w} END AS growth FROM {source} JOIN (SELECT strategy, datediff('day', min(month_end), max(month_end)) / 365.25 AS span FROM months GROUP BY strategy) USING (strategy))) GROUP BY {by})"""


STATS = ("ann_return", "ann_vol", "sharpe", "sortino", "max_drawdown", "cagr", "win_rate")


@query("strategy_performance", ROLES, f"{ASSIGNED} SELECT * FROM {_performance_sql('months', 'strategy, bucket')}")
def strategy_performance(r):
    d = B.performance(months(assigned(r)), "month_end", ("strategy", "bucket"))
    return d.withColumns({c: r6(c) for c in STATS})


SPREADS = """sp AS (SELECT strategy, buckets, month_end, max(CASE WHEN bucket = 1 THEN ret END) - max(CASE WHEN bucket = buckets THEN ret END) AS a, max(CASE WHEN bucket = 4 THEN ret END) - max(CASE WHEN bucket = buckets THEN ret END) AS b FROM months GROUP BY ALL),
spread AS (SELECT strategy, month_end, 'first_last' AS spread, a AS ret FROM sp WHERE a IS NOT NULL UNION ALL SELECT strategy, month_end, 'fourth_last', b FROM sp WHERE buckets >= 7 AND b IS NOT NULL)"""


def spread_stats(m, size):
    """Over the months that have the difference; the time is the strategy's whole calendar."""
    span = m.groupBy("strategy").agg((F.datediff(F.max("month_end"), F.min("month_end")) / 365.25).alias("span"))
    d = ST.spreads(m, size).where("ret is not null").join(F.broadcast(span), "strategy")
    return B.performance(d, "month_end", ("strategy", "spread"), F.col("span")).withColumns({c: r6(c) for c in STATS})


@query("strategy_spreads", ROLES, f"{ASSIGNED}, {SPREADS} SELECT * FROM {_performance_sql('spread', 'strategy, spread')}")
def strategy_spreads(r):
    a = assigned(r)
    return spread_stats(months(a), sizes(a))


#: The two halves that are compared; the published ones (2010 to 2017, 2018 to 2024) lie after these tables.
PERIODS = (("1995-01-01", "1998-12-31"), ("1999-01-01", "2001-12-31"))
_SHARPE = "CASE WHEN stddev_samp(ret) * sqrt(12) > 0 THEN avg(ret) * 12 / (stddev_samp(ret) * sqrt(12)) ELSE 0 END"
_HALVES = " UNION ALL ".join(f"SELECT strategy, series, {k} AS period, CASE WHEN month_end BETWEEN DATE '{a}' AND DATE '{b}' THEN ret END AS ret FROM x" for k, (a, b) in enumerate(PERIODS))


@query("strategy_split_sharpe", ROLES, f"{ASSIGNED}, {SPREADS}, x AS (SELECT strategy, 'bucket_' || bucket AS series, month_end, ret FROM months WHERE bucket IN (1, 4) UNION ALL SELECT strategy, spread, month_end, ret FROM spread) SELECT strategy, series, period, {q6(_SHARPE)} AS sharpe FROM ({_HALVES}) GROUP BY ALL")
def strategy_split_sharpe(r):
    """Sharpe ratios of the first and fourth bucket and of the differences in two fixed periods."""
    a = assigned(r)
    m = months(a)
    one = m.where("bucket in (1, 4)").select("strategy", F.concat(F.lit("bucket_"), F.col("bucket").cast("string")).alias("series"), "month_end", "ret")
    both = one.unionByName(ST.spreads(m, sizes(a)).where("ret is not null").withColumnRenamed("spread", "series"))
    return ST.sharpe_by_period(both, ["strategy", "series"], PERIODS).withColumn("sharpe", r6("sharpe"))


_YEAR = "coalesce(product(CASE WHEN bucket = {0} THEN 1 + ret END), 1) - 1"
YEARS = f'years_of AS (SELECT strategy, year(month_end) AS year, {_YEAR.format(1)} AS "first", {_YEAR.format("buckets")} AS "last" FROM months GROUP BY ALL)'


@query("strategy_years", ROLES, f'{ASSIGNED}, {YEARS} SELECT strategy, year, {q6(chr(34) + "first" + chr(34))} AS "first", {q6(chr(34) + "last" + chr(34))} AS "last", {q6(chr(34) + "first" + chr(34) + " - " + chr(34) + "last" + chr(34))} AS spread, "first" > "last" AS first_wins FROM years_of')
def strategy_years(r):
    a = assigned(r)
    return ST.years(months(a), sizes(a)).withColumns({c: r6(c) for c in ("first", "last", "spread")})


@query("strategy_sector_mix", ROLES, f"{ASSIGNED} SELECT strategy, date, bucket, sector, {q6('count(*) / sum(count(*)) OVER (PARTITION BY strategy, date, bucket)')} AS share FROM a GROUP BY strategy, date, bucket, sector")
def strategy_sector_mix(r):
    return B.sector_mix(assigned(r), ("strategy", "date")).withColumn("share", r6("share"))


@query("strategy_runs", ROLES, f"""{ASSIGNED}, {SUMMARY_SQL}, {SPREADS}, {YEARS},
own AS (SELECT strategy, buckets, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS rebalances, count(*) AS n FROM a GROUP BY strategy, buckets),
fall AS (SELECT *, mean_ret >= lead(mean_ret) OVER (PARTITION BY strategy ORDER BY bucket) AS falls FROM summary JOIN own USING (strategy)),
r AS (SELECT strategy, max(CASE WHEN bucket = 1 THEN mean_ret END) AS first_ret, max(CASE WHEN bucket = buckets THEN mean_ret END) AS last_ret, bool_and(coalesce(falls, true)) AS monotone FROM fall GROUP BY strategy)
SELECT own.*, CAST(floor(n / rebalances / buckets) AS BIGINT) AS per_bucket, {q6('first_ret')} AS first_ret, {q6('last_ret')} AS last_ret, {q6('first_ret - last_ret')} AS spread_monthly, {q6('12 * (first_ret - last_ret)')} AS spread_annual, monotone, {q6('win_rate')} AS win_rate, spread_sharpe
FROM own JOIN r USING (strategy) LEFT JOIN (SELECT strategy, avg(CASE WHEN "first" > "last" THEN 1.0 ELSE 0.0 END) AS win_rate FROM years_of GROUP BY strategy) USING (strategy)
LEFT JOIN (SELECT strategy, sharpe AS spread_sharpe FROM {_performance_sql('spread', 'strategy, spread')} WHERE spread = 'first_last') USING (strategy)""")
def strategy_runs(r):
    """What a run's metadata says of each strategy."""
    a = assigned(r)
    m, size = months(a), sizes(a)
    d = ST.run_summary(a, summary(a), spread_stats(m, size), ST.years(m, size))
    return d.withColumns({c: r6(c) for c in ("first_ret", "last_ret", "spread_monthly", "spread_annual", "win_rate")})
