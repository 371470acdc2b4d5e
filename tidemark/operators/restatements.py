"""What restatements change: filings as first filed, as last filed, or as known on a date, and what follows from each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import r_squared

FIRST, LAST = "first_filed", "last_filed"
#: Positive years that a trend needs here.
LEAST = 4


def versions(filings: DataFrame, spine: DataFrame | None = None) -> DataFrame:
    """Every period of ``filings`` (ticker, reportperiod, datekey, ...) in each version asked for, with the trace of its filings so far.

    ``spine`` (ticker, version, known_on) says by which day: of what was filed by then, ``version`` names the first filed, the last filed, or what
    was known (the last, too). None takes both versions of everything. Adds filings_known (how many by then), first_datekey and datekey."""
    own = ["ticker", "reportperiod"]
    if spine is None:
        d = filings.select("*", F.explode(F.array(F.lit(FIRST), F.lit(LAST))).alias("version"), F.lit(None).cast("date").alias("known_on"))
    else:
        d = filings.join(spine, "ticker").where(F.col("datekey") <= F.col("known_on"))
    rest = [c for c in filings.columns if c not in (*own, "datekey")]
    group = d.groupBy(*own, "version", "known_on")
    x = F.struct("datekey", *rest)
    out = group.agg(F.count(F.lit(1)).alias("filings_known"), F.min("datekey").alias("first_datekey"), F.min_by(x, "datekey").alias("a"), F.max_by(x, "datekey").alias("b"))
    return out.select(*own, "version", "known_on", "filings_known", "first_datekey", F.when(F.col("version") == FIRST, F.col("a")).otherwise(F.col("b")).alias("x")).select(*own, "version", "known_on", "filings_known", "first_datekey", "x.*")


def annual(known: DataFrame, value: str, least_quarters: int = 3) -> DataFrame:
    """(ticker, version, known_on, fy, value): quarters summed by year, nulls left out, years of too few quarters dropped."""
    keys = ["ticker", "version", "known_on"]
    y = known.groupBy(*keys, F.year("reportperiod").alias("fy")).agg(F.count(F.lit(1)).alias("_q"), F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
    return y.where(F.col("_q") >= least_quarters).drop("_q")


def trend(years: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """R2 of the logarithms of the positive years and the growth a year that their slope says, to four decimals; null for fewer than `LEAST`."""
    w = Window.partitionBy(*keys).orderBy("fy")
    d = years.withColumn("_up", F.when(F.col(value) > 0, F.log(value)))
    d = d.withColumn("_at", F.when(F.col("_up").isNotNull(), F.count("_up").over(w).cast("double")))
    enough = F.count("_up") >= LEAST
    return d.groupBy(*keys).agg(F.when(enough, F.floor(r_squared(F.col("_up"), F.col("_at")) * 1e4 + 0.5) / 1e4).alias("r2"), F.when(enough, F.round(F.exp(F.regr_slope("_up", "_at")) - 1, 4)).alias("growth"))


def magnitudes(filings: DataFrame, values: list[str], material: float) -> DataFrame:
    """(ticker, reportperiod, metric, original, restated, pct_change, material, original_date, restated_date) of periods filed more than
    once; a metric that is null in either version or 0 in the first has no row."""
    v = versions(filings)
    one = lambda ver: v.where(F.col("version") == ver).select("ticker", "reportperiod", "filings_known", F.col("datekey").alias(f"_{ver}"), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias(ver)) for c in values])).alias("x")).select("ticker", "reportperiod", "filings_known", f"_{ver}", "x.*")
    d = one(FIRST).where("filings_known > 1").drop("filings_known").join(one(LAST).drop("filings_known"), ["ticker", "reportperiod", "metric"]).where(f"{FIRST} <> 0 and {LAST} is not null")
    change = (F.col(LAST) - F.col(FIRST)) / F.abs(FIRST)
    return d.select("ticker", "reportperiod", "metric", F.col(FIRST).alias("original"), F.col(LAST).alias("restated"), (100 * change).alias("pct_change"), (F.abs(change) >= material).alias("material"), F.col(f"_{FIRST}").alias("original_date"), F.col(f"_{LAST}").alias("restated_date"))


def effect_on_trend(filings: DataFrame, value: str, known_on: str) -> DataFrame:
    """(ticker, r2_original, r2_restated, delta, effect): the trend of first-filed against last-filed values, of what was filed by a day. All years count, whatever
    their quarters; entities without both trends have no row."""
    spine = filings.select("ticker").distinct().select("ticker", F.explode(F.array(F.lit(FIRST), F.lit(LAST))).alias("version"), F.lit(known_on).cast("date").alias("known_on"))
    t = trend(annual(versions(filings, spine), value, 1), value, ["ticker", "version"])
    r2 = lambda ver: F.max(F.when(F.col("version") == ver, F.col("r2")))
    d = t.groupBy("ticker").agg(r2(FIRST).alias("r2_original"), r2(LAST).alias("r2_restated")).where("r2_original is not null and r2_restated is not null")
    delta = F.round(F.col("r2_restated") - F.col("r2_original"), 6)
    effect = F.when(F.abs("delta") < 0.01, "negligible").when(F.abs("delta") < 0.05, "minor").when(F.col("delta") < 0, "lower").otherwise("higher")
    return d.withColumn("delta", delta).withColumn("effect", effect)


def trace(filings: DataFrame, value: str, dates: DataFrame) -> DataFrame:
    """What each of ``dates`` (date) sees of an entity: the last filing, its age in days, the sum of the last four known quarters (null for
    fewer) and the age of the oldest of their filings, and the trend. Entities without a filing by then have no row."""
    spine = filings.select("ticker").distinct().crossJoin(F.broadcast(dates.select(F.col("date").alias("known_on")))).withColumn("version", F.lit("known"))
    v = versions(filings, spine)
    keys = ["ticker", "version", "known_on"]
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("reportperiod")))
    four = F.col("_k") <= 4
    d = v.withColumn("_k", back).groupBy(*keys).agg(
        F.max("datekey").alias("last_filing"), F.when(F.count(F.lit(1)) >= 4, F.coalesce(F.sum(F.when(four, F.col(value))), F.lit(0.0))).alias(f"{value}_ttm"), F.min(F.when(four, F.col("datekey"))).alias("oldest"), F.sum("filings_known").alias("filings_known"),
    )
    d = d.join(trend(annual(v, value), value, keys), keys, "left")
    age = lambda c: F.datediff("known_on", c).cast("long")
    return d.select("ticker", F.col("known_on").alias("date"), "last_filing", age("last_filing").alias("days_stale"), f"{value}_ttm", age("oldest").alias("oldest_age"), "filings_known", "r2", "growth")
