"""Rolling price features: windows of rows per ticker, all over one shuffle by ticker and one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import by, ratio, rows
from . import sliding as S


def W() -> WindowSpec:
    return by("ticker")


HORIZONS = {"1m": 21, "3m": 63, "6m": 126, "12m": 252}

#: What is put together row by row, and over how many rows.
CHAINS = {
    "ret": S.Chain(S.MOMENTS, "daily_ret", (5, 20, 60)),
    "traded": S.Chain(S.TOTAL, "volume", (5, 20, 60)),
    "close": S.Chain(S.TOTAL, "closeadj", (5, 25, 50, 200)),
    "range": S.Chain(S.EXTREMES, "closeadj", (5, 25, 100, 252)),
}


def with_returns(bars: DataFrame) -> DataFrame:
    """daily_ret and the returns over 21, 63, 126 and 252 rows."""
    lagged = lambda n: ratio(F.col("closeadj"), F.lag("closeadj", n).over(W())) - 1
    return bars.withColumns({"daily_ret": lagged(1)} | {f"ret_{k}": lagged(n) for k, n in HORIZONS.items()})


def _volatility() -> dict[str, Column]:
    vol = {n: S.deviation("ret", n) * F.sqrt(F.lit(252.0)) for n in (20, 60)}
    return {"vol_20d": vol[20], "vol_60d": vol[60], "vol_ratio": ratio(vol[20], vol[60])}


def _volume_ratio() -> dict[str, Column]:
    return {"volume_ratio_1m": ratio(S.mean("traded", 20), S.mean("traded", 60))}


def _range_position() -> dict[str, Column]:
    lo, hi = (S.field("range", 252, f) for f in ("lo", "hi"))
    return {"pct_52w_range": ratio(F.col("closeadj") - lo, hi - lo)}


def _moving_averages() -> dict[str, Column]:
    return {f"ma{n}_cross": ratio(F.col("closeadj") - S.mean("close", n), S.mean("close", n)) for n in (50, 200)}


def _skew() -> dict[str, Column]:
    return {"momentum_skew_60d": S.skewness("ret", 60)}


def _with(d: DataFrame, chains: tuple[str, ...], features: dict[str, Column]) -> DataFrame:
    kept = d.columns
    return S.slide(d, W(), {k: CHAINS[k] for k in chains}).withColumns(features).select(*kept, *features)


def with_volatility(bars: DataFrame) -> DataFrame:
    """vol_20d, vol_60d and their ratio, from daily_ret."""
    return _with(bars, ("ret",), _volatility())


def with_volume_ratio(bars: DataFrame) -> DataFrame:
    """Mean volume of 20 rows over that of 60."""
    return _with(bars, ("traded",), _volume_ratio())


def with_range_position(bars: DataFrame) -> DataFrame:
    """Where the close stands between the least and the greatest of 252 rows."""
    return _with(bars, ("range",), _range_position())


def with_moving_averages(bars: DataFrame) -> DataFrame:
    """Distance of the close from its mean of 50 and of 200 rows."""
    return _with(bars, ("close",), _moving_averages())


def with_skew(bars: DataFrame) -> DataFrame:
    """Bias-corrected skewness of 60 daily returns."""
    return _with(bars, ("ret",), _skew())


def with_true_range(bars: DataFrame) -> DataFrame:
    """Mean true range of 14 rows over the close."""
    kept = bars.columns
    d = bars.withColumn("_before", F.lag("closeadj").over(W()))
    before = F.col("_before")
    d = d.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return d.withColumn("_mean", F.avg("_tr").over(rows(W(), 14))).select(*kept, ratio("_mean", "closeadj").alias("atr_14d"))


FEATURES = ("ret_1m", "ret_3m", "ret_6m", "ret_12m", "vol_20d", "vol_60d", "vol_ratio", "volume_ratio_1m", "pct_52w_range", "atr_14d", "ma50_cross", "ma200_cross", "momentum_skew_60d")


def price_features(bars: DataFrame) -> DataFrame:
    """All features of each bar; one exchange by ticker and one sort serve every window."""
    d = with_true_range(with_returns(bars))
    return _with(d, tuple(CHAINS), _volatility() | _volume_ratio() | _range_position() | _moving_averages() | _skew())
