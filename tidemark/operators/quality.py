"""Quality metrics of filing histories as they were known at each vintage.

A vintage is a day on which an entity filed. What was known then of a period is the version filed last up to that
day, so each version is valid from its filing to the next one's, and the state of a vintage is an interval join
within the entity. Metrics are conditional aggregates over the years of a vintage: no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import r_squared


def stacked(*tables: DataFrame) -> DataFrame:
    """The rows of all tables. The entity has a name of its own in each, so Spark knows the union to be dealt by it if the tables are."""
    named = [t.select(F.col("ticker").alias("k"), *[c for c in t.columns if c != "ticker"]) for t in tables]
    d = named[0]
    for t in named[1:]:
        d = d.unionByName(t, allowMissingColumns=True)
    return d.select(F.col("k").alias("ticker"), *[c for c in d.columns if c != "k"])


def vintages(*filings: DataFrame) -> DataFrame:
    """(ticker, vintage): every day on which any of the tables has a filing of the entity."""
    return stacked(*[f.select("ticker", F.col("datekey").alias("vintage")) for f in filings]).distinct()


def state(spine: DataFrame, filings: DataFrame) -> DataFrame:
    """Each vintage with the version known of every period filed by then."""
    w = Window.partitionBy("ticker", "reportperiod").orderBy("datekey")
    f = filings.withColumn("until", F.lead("datekey").over(w))
    return spine.join(f, "ticker").where((F.col("datekey") <= F.col("vintage")) & (F.col("until").isNull() | (F.col("vintage") < F.col("until")))).drop("until")


def annual(known: DataFrame) -> DataFrame:
    """(ticker, vintage, fy, ncfo, fcf, roic, shares) of annual filings: cash flow may be null, in free cash flow nulls are 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return known.select("ticker", "vintage", F.year("reportperiod").alias("fy"), "ncfo", (zero("ncfo") + zero("capex")).alias("fcf"), "roic", F.col("sharesbas").alias("shares"))


def annual_from_quarters(known: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """The same from quarters, for vintages of entities that have no annual state: years of at least three quarters, nulls 0."""
    d = known
    if without is not None:
        d = d.join(without.select("ticker", "vintage").distinct(), ["ticker", "vintage"], "left_anti")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    y = d.groupBy("ticker", "vintage", F.year("reportperiod").alias("fy")).agg(
        F.count(F.lit(1)).alias("q"), F.sum(zero("ncfo")).alias("ncfo"), F.sum(zero("ncfo") + zero("capex")).alias("fcf"), F.avg("roic").alias("roic"), F.max("sharesbas").alias("shares")
    )
    return y.where("q >= 3").drop("q")


#: What a metric needs: named conditions that are counted back from a group's last row, and aggregates that read these places.
Part = tuple[dict[str, Column], list[Column]]


def measure(d: DataFrame, keys: list[str], order: str, *parts: Part) -> DataFrame:
    """All metrics of each group from one window and one aggregate. A place is the number of rows, from the last one back, that met the
    condition; the last n known values are thus those with a place of at most n, and r2 is the same for places counted back as forth."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    places = {k: F.count(F.when(c, 1)).over(w) for p, _ in parts for k, c in p.items()}
    return d.withColumns(places).groupBy(*keys).agg(*[m for _, ms in parts for m in ms])


#: Values below which a trend is not measured.
LEAST = 3


def _tail(c: str, n: int) -> Column:
    """The column in the last n rows; what is null there stays null and is not made up for by older rows."""
    return F.when(F.col("_year") <= n, F.col(c))


def _slope(x: Column, c: str) -> Column:
    """Slope of x, whose place is counted back."""
    return F.regr_slope(x, F.when(x.isNotNull(), -F.col(f"_{c}").cast("double")))


def _places(c: str) -> dict[str, Column]:
    return {"_year": F.lit(True), f"_{c}": F.col(c).isNotNull(), f"_{c}_up": F.col(c) > 0}


def _positive_share(c: str, n: int) -> Column:
    x = _tail(c, n)
    return F.when(F.count(x) >= LEAST, F.count_if(x > 0) / F.count(x))


def log_trend_part(c: str, n: int, least: int = LEAST, share: str | None = None) -> Part:
    x = _tail(c, n)
    up = F.when(x > 0, x)
    at = F.when(up.isNotNull(), F.col(f"_{c}_up").cast("double"))
    r2 = F.when((F.count(x) >= least) & (F.count(up) >= least), r_squared(F.log(up), at))
    return _places(c), [r2.alias(f"{c}_r2_{n}y"), _positive_share(c, n).alias(share or f"{c}_positive_{n}y")]


def log_trend(years: DataFrame, column: str, n: int, keys: list[str], least: int = LEAST) -> DataFrame:
    """r2 of ln(x) on the place among the positive values of the last n years (``least`` of them at least), and the positives' share of the known values."""
    return measure(years, keys, "fy", log_trend_part(column, n, least))


def _asinh(x: Column) -> Column:
    """Inverse hyperbolic sine, as exact for large negative values as for positive ones."""
    return F.signum(x) * F.log(F.abs(x) + F.sqrt(x * x + 1))


def asinh_trend_part(c: str, n: int) -> Part:
    x = _tail(c, n)
    r2 = r_squared(_asinh(x), F.when(x.isNotNull(), F.col(f"_{c}").cast("double")))
    return _places(c), [F.when(F.count(x) >= LEAST, r2 * _positive_share(c, n)).alias(f"{c}_asinh_r2_{n}y")]


def asinh_trend(years: DataFrame, column: str, n: int, keys: list[str]) -> DataFrame:
    """r2 of arcsinh(x) on the place among the known values of the last n years, times the share of positive ones."""
    return measure(years, keys, "fy", asinh_trend_part(column, n))


def strict_growth_part(c: str, n: int) -> Part:
    inside = F.col("_year") <= n + 1
    x, at = F.when(inside, F.col(c)), F.when(inside, F.col("fy"))
    a, b = F.min_by(x, at), F.max_by(x, at)
    ok = (F.count(at) == n + 1) & (F.count(x) == n + 1) & (a > 0) & (b > 0)
    return {"_year": F.lit(True)}, [F.when(ok, F.pow(b / a, F.lit(1.0 / n)) - 1).alias(f"{c}_cagr_{n}y")]


def strict_growth(years: DataFrame, column: str, n: int, keys: list[str]) -> DataFrame:
    """Yearly growth over n years: all n + 1 last values known, both ends positive."""
    return measure(years, keys, "fy", strict_growth_part(column, n))


def roic_part() -> Part:
    x = _tail("roic", 3)
    last = F.max(F.when(F.col("_year") == 1, F.col("roic")))
    return _places("roic"), [last.alias("roic_level"), F.when(F.count(x) >= 2, _slope(x, "roic")).alias("roic_slope_3y")]


def roic_trend(years: DataFrame, keys: list[str]) -> DataFrame:
    """The last year's value, null if that is, and the slope of the known ones of the last three years (at least two)."""
    return measure(years, keys, "fy", roic_part())


#: What the slopes of the quarterly columns are called.
_TREND_NAMES = {"grossmargin": "grossmargin_slope", "net_debt": "net_debt_trend"}


def quarterly_trends(known: DataFrame) -> DataFrame:
    """Slopes of gross margin and net debt over the last 8 known quarters, at least 4 values each."""
    places, out = {"_back": F.lit(True)}, []
    for c in ("grossmargin", "net_debt"):
        places[f"_{c}"] = F.col(c).isNotNull()
        x = F.when(F.col("_back") <= 8, F.col(c))
        out.append(F.when(F.count(x) >= 4, _slope(x, c)).alias(_TREND_NAMES[c]))
    return measure(known.withColumn("net_debt", F.col("debt") - F.col("cashnequsd")), ["ticker", "vintage"], "reportperiod", (places, out))


def dilution_part() -> Part:
    up = F.col("shares") > 0
    x, at = F.when(up, F.col("shares")), F.when(up, F.col("fy"))
    growth = F.pow(F.max_by(x, at) / F.min_by(x, at), 1 / (F.count(x) - 1)) - 1
    return {}, [F.when(F.count(x) >= 2, growth).alias("dilution_rate")]


def dilution(years: DataFrame, keys: list[str]) -> DataFrame:
    """Growth a step of the positive share counts, from the first to the last."""
    return years.groupBy(*keys).agg(*dilution_part()[1])


def known_years(arq: DataFrame, ary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(years of each vintage, quarterly state): annual filings where a vintage has any, else quarters summed.

    A vintage has annual filings from the entity's first one on, so quarters are looked up and summed for those before it only."""
    spine = vintages(arq, ary)
    since = ary.groupBy("ticker").agg(F.min("datekey").alias("_since"))
    before = spine.join(since, "ticker", "left").where("_since is null or vintage < _since").drop("_since")
    return stacked(annual(state(spine, ary)), annual_from_quarters(state(before, arq))), state(spine, arq)


#: The metrics of `quality_metrics`, in order.
METRICS = tuple(f"{c}_{m}" for c in ("ncfo", "fcf") for m in ("r2_5y", "r2_10y", "cagr_5y", "cagr_10y", "pct_positive", "r2_adjusted", "r2_adjusted_arcsinh")) + (
    "fcf_ncfo_r2_delta", "roic_level", "roic_slope_3y", "grossmargin_slope", "net_debt_trend", "dilution_rate",
)


def of_years(years: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics of annual series, one row a group: one window and one aggregate."""
    parts = [p for c in ("ncfo", "fcf") for p in (log_trend_part(c, 5), log_trend_part(c, 10, share=f"{c}_pct_positive"), asinh_trend_part(c, 10), strict_growth_part(c, 5), strict_growth_part(c, 10))]
    d = measure(years, keys, "fy", *parts, roic_part(), dilution_part())
    adjusted = {f"{c}_r2_adjusted": F.col(f"{c}_r2_10y") * F.col(f"{c}_pct_positive") for c in ("ncfo", "fcf")} | {f"{c}_r2_adjusted_arcsinh": F.col(f"{c}_asinh_r2_10y") for c in ("ncfo", "fcf")}
    return d.withColumns(adjusted).withColumn("fcf_ncfo_r2_delta", F.round(F.col("ncfo_r2_adjusted") - F.col("fcf_r2_adjusted"), 4))


def quality_metrics(arq: DataFrame, ary: DataFrame) -> DataFrame:
    """One row a vintage with all metrics: one aggregate of years, one of quarters. They meet as rows of a group and not in joins, so what is dealt by entity stays so."""
    years, quarters = known_years(arq, ary)
    keys = ["ticker", "vintage"]
    known = [m.where("ticker is not null and vintage is not null") for m in (of_years(years, keys), quarterly_trends(quarters))]
    return stacked(vintages(arq, ary), *known).groupBy(*keys).agg(*[F.max(c).alias(c) for c in METRICS])
