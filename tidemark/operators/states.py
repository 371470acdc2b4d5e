"""Rule-based labels of market states, as a table of dates that any statistic can be split by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join


@dataclass(frozen=True)
class Rule:
    """A label for the dates on which an SQL condition over the columns of `indicators` holds; unknown values do not meet it."""

    label: str
    condition: str
    family: str


#: The rules by family, in order of precedence within it (fixed values).
RULES = (
    Rule("recession", "recession = 1", "recession"),
    Rule("bear", "drawdown < -0.2", "drawdown"),
    Rule("correction", "drawdown < -0.1", "drawdown"),
    Rule("stress", "vix > 30", "volatility"),
    Rule("complacent", "vix < 15", "volatility"),
    Rule("inverted", "curve_days >= 63", "curve"),
    Rule("systemic", "hy_spread > 6", "credit"),
    Rule("bull", "hy_spread < 3.5", "credit"),
)
OTHERWISE = "normal"


def indicators(market: DataFrame, macro: DataFrame) -> DataFrame:
    """``macro`` (date, vix, yield_curve, hy_spread, recession; absent columns are unknown) with the market's fall from its running maximum
    and for how many rows in a row the yield curve has been below 0. ``market`` has date and closeadj."""
    w = Window.partitionBy("_one").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    m = market.withColumn("_one", F.lit(1)).select("date", (F.col("closeadj") / F.max("closeadj").over(w) - 1).alias("drawdown"))
    d = macro.withColumn("_one", F.lit(1))
    for c in ("vix", "yield_curve", "hy_spread", "recession"):
        if c not in macro.columns:
            d = d.withColumn(c, F.lit(None).cast("double"))
    low = F.coalesce(F.col("yield_curve") < 0, F.lit(False))
    d = d.withColumn("_run", F.sum(F.when(low, 0).otherwise(1)).over(w))
    d = d.withColumn("curve_days", F.sum(F.when(low, 1).otherwise(0)).over(Window.partitionBy("_one", "_run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    return d.join(m, "date", "left").select("date", "drawdown", "vix", "curve_days", "hy_spread", "recession")


def labels(days: DataFrame, rules: tuple[Rule, ...] = RULES, otherwise: str = OTHERWISE) -> DataFrame:
    """(date, family, label): the first rule of each family that holds on a date of `indicators`."""
    families = list(dict.fromkeys(r.family for r in rules))
    out = []
    for f in families:
        label = F.lit(otherwise)
        for r in reversed([r for r in rules if r.family == f]):
            label = F.when(F.expr(r.condition), r.label).otherwise(label)
        out.append(F.struct(F.lit(f).alias("family"), label.alias("label")))
    return days.select("date", F.explode(F.array(*out)).alias("x")).select("date", "x.*")


def with_labels(rows: DataFrame, labelled: DataFrame, date: str = "date") -> DataFrame:
    """``rows`` once for each family, with the label of the last labelled date on or before their own. Labels are one row a date and family.

    What is looked up by family are the distinct dates, and rows meet these by date. Both tables are read twice: give them as written tables where they take work."""
    families = labelled.select("family").distinct()
    days = rows.select(F.col(date).alias("_on")).distinct().crossJoin(F.broadcast(families))
    named = asof_join(days, labelled.select("family", F.col("date").alias("_day"), "label"), "family", "_on", "_day", ["label"])
    return rows.join(named, F.col(date).eqNullSafe(F.col("_on"))).drop("_on")
