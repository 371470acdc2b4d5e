"""Queries: price windows."""

from pyspark.sql import functions as F

from ..functions.columns import q6, r6
from ..operators import prices as P
from ..registry import query

_RET = "closeadj / nullif(lag(closeadj, {n}) OVER (PARTITION BY ticker ORDER BY date), 0) - 1"
_W = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def w(n):
    return _W.format(n=n - 1)


@query("ret_multi_horizon", "bars", "SELECT ticker, date, " + ", ".join(f"{q6(_RET.format(n=n))} AS ret_{k}" for k, n in P.HORIZONS.items()) + " FROM bars")
def ret_multi_horizon(r):
    d = P.with_returns(r.bars)
    return d.select("ticker", "date", *[r6(f"ret_{k}").alias(f"ret_{k}") for k in P.HORIZONS])


_D = f"WITH d AS (SELECT *, {_RET.format(n=1)} AS ret, lag(closeadj) OVER (PARTITION BY ticker ORDER BY date) AS pc FROM bars)"
_VOL = {n: f"stddev_samp(ret) {w(n)} * sqrt(252)" for n in (20, 60)}
_SQL = {
    "vol_20d": _VOL[20], "vol_60d": _VOL[60], "vol_ratio": f"({_VOL[20]}) / nullif({_VOL[60]}, 0)",
    "volume_ratio_1m": f"avg(volume) {w(20)} / nullif(avg(volume) {w(60)}, 0)",
    "pct_52w_range": f"(closeadj - min(closeadj) {w(252)}) / nullif(max(closeadj) {w(252)} - min(closeadj) {w(252)}, 0)",
    "atr_14d": f"avg(greatest(high - low, abs(high - pc), abs(low - pc))) {w(14)} / nullif(closeadj, 0)",
    "ma50_cross": f"(closeadj - avg(closeadj) {w(50)}) / avg(closeadj) {w(50)}", "ma200_cross": f"(closeadj - avg(closeadj) {w(200)}) / avg(closeadj) {w(200)}",
    "momentum_skew_60d": f"CASE WHEN count(ret) {w(60)} > 2 THEN skewness(ret) {w(60)} END",
}


def _part(key, names, steps):
    @query(key, "bars", f"{_D} SELECT ticker, date, " + ", ".join(f"{q6(_SQL[n])} AS {n}" for n in names) + " FROM d")
    def f(r):
        d = r.bars
        for s in steps:
            d = s(d)
        return d.select("ticker", "date", *[r6(n).alias(n) for n in names])


_part("rolling_vol", ("vol_20d", "vol_60d", "vol_ratio"), (P.with_returns, P.with_volatility))
_part("volume_ratio", ("volume_ratio_1m",), (P.with_volume_ratio,))
_part("range_position_52w", ("pct_52w_range",), (P.with_range_position,))
_part("ma_cross", ("ma50_cross", "ma200_cross"), (P.with_moving_averages,))
_part("atr_14", ("atr_14d",), (P.with_true_range,))
_part("rolling_skew", ("momentum_skew_60d",), (P.with_returns, P.with_skew))

PRICE_SQL = f"SELECT ticker, date, {', '.join(f'{q6(_RET.format(n=n))} AS ret_{k}' for k, n in P.HORIZONS.items())}, {', '.join(f'{q6(e)} AS {n}' for n, e in _SQL.items())} FROM (SELECT *, {_RET.format(n=1)} AS ret, lag(closeadj) OVER (PARTITION BY ticker ORDER BY date) AS pc FROM bars)"


@query("price_features", "bars", PRICE_SQL)
def price_features(r):
    return P.price_features(r.bars).select("ticker", "date", *[r6(n).alias(n) for n in P.FEATURES])


@query("price_current", "bars", f"SELECT * FROM ({PRICE_SQL}) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1")
def price_current(r):
    d = P.price_features(r.bars).withColumn("_n", F.lead("date").over(P.W())).where("_n is null")
    return d.select("ticker", "date", *[r6(n).alias(n) for n in P.FEATURES])


@query("trading_dates", "bars", "SELECT DISTINCT date FROM bars")
def trading_dates(r):
    return r.bars.select("date").distinct()


@query("bars_in_range", "bars", "SELECT ticker, date, closeadj FROM bars WHERE date BETWEEN DATE '1999-01-01' - 252 AND DATE '2000-06-30'")
def bars_in_range(r):
    return r.bars.where(F.col("date").between(F.date_sub(F.lit("1999-01-01").cast("date"), 252), F.lit("2000-06-30").cast("date"))).select("ticker", "date", "closeadj")


@query("entity_subset", "bars", "SELECT * FROM bars WHERE ticker IN (1, 3, 5, 8)")
def entity_subset(r):
    return r.bars.where(F.col("ticker").isin(1, 3, 5, 8))


@query("trading_ordinal", "bars", "SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rank, count(*) OVER (PARTITION BY ticker) AS last_rank FROM bars WHERE closeadj > 0")
def trading_ordinal(r):
    from pyspark.sql import Window

    d = r.bars.where("closeadj > 0")
    return d.select("ticker", "date", F.row_number().over(P.W()).cast("long").alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("last_rank"))


@query("last_price", "bars", "SELECT ticker, max(date) AS date, arg_max(closeadj, date) AS closeadj FROM bars GROUP BY ticker")
def last_price(r):
    return r.bars.groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("closeadj", "date").alias("closeadj"))


@query("as_of_date", "bars", "SELECT max(date) AS last_date, max(date) FILTER (date < date_trunc('month', (SELECT max(date) FROM bars))) AS last_month_end FROM bars")
def as_of_date(r):
    last = r.bars.agg(F.max("date").alias("m"))
    months = r.bars.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date"))
    return months.crossJoin(F.broadcast(last)).agg(F.max("m").alias("last_date"), F.max(F.when(F.col("month") < F.trunc("m", "month"), F.col("date"))).alias("last_month_end"))


@query("join_daily_ratios", "bars vendor", "SELECT b.ticker, b.date, closeadj, marketcap, pe FROM bars b LEFT JOIN vendor v ON b.ticker = v.ticker AND b.date = v.date")
def join_daily_ratios(r):
    return r.bars.join(r.vendor, ["ticker", "date"], "left").select("ticker", "date", "closeadj", "marketcap", "pe")


@query("coalesce_sources", "bars vendor", "SELECT b.ticker, b.date, coalesce(pe, closeadj / 120) AS pe FROM bars b JOIN vendor v ON b.ticker = v.ticker AND b.date = v.date".replace("coalesce(pe, closeadj / 120)", q6("coalesce(pe, closeadj / 120)")))
def coalesce_sources(r):
    return r.bars.join(r.vendor, ["ticker", "date"]).select("ticker", "date", r6(F.coalesce("pe", F.col("closeadj") / 120)).alias("pe"))


@query("size_tier", "vendor", "SELECT ticker, date, CASE WHEN marketcap IS NULL THEN NULL WHEN marketcap < 1e6 THEN 1 WHEN marketcap < 3e6 THEN 2 WHEN marketcap < 6e6 THEN 3 WHEN marketcap < 1e7 THEN 4 WHEN marketcap < 2e7 THEN 5 ELSE 6 END AS tier FROM vendor")
def size_tier(r):
    from ..functions.columns import size_tier as tier

    return r.vendor.select("ticker", "date", tier("marketcap", (1e6, 3e6, 6e6, 1e7, 2e7)).alias("tier"))
