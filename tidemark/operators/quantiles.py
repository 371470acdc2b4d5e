"""Exact percentiles of whole columns without sorting them in one task.

The wanted ranks are found by counting. A value's cell is a monotone function of it (sign and logarithm, cells about 1.6 % wide); cells are
counted with partial aggregation, and only rows in a cell that holds a wanted rank are looked at again, in 4,096 parts of the
cell, and those in a wanted part by distinct value. What moves between tasks are counts; a task of the last step holds the distinct values of one part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import shared_dir

CELLS, PARTS = 64, 4096


def _cell(v: Column) -> Column:
    """Monotone in v: the sign, then the logarithm in steps of 1 / CELLS. Logarithms of doubles lie between -745 and 710."""
    size = F.floor(F.log(F.abs(v)) * CELLS) + 800 * CELLS
    return F.when(v == 0, F.lit(0).cast("long")).otherwise((F.signum(v) * size).cast("long"))


def _ranked(counts: DataFrame, keys: list[str], order: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``counts`` (keys, order, n) that hold a wanted place (keys, p, end, place), with the place within the row."""
    w = Window.partitionBy(*keys).orderBy(order)
    c = counts.withColumn("_before", F.sum("n").over(w) - F.col("n"))
    d = c.join(F.broadcast(wanted), keys)  # two places a column and share
    d = d.where((F.col("place") >= F.col("_before")) & (F.col("place") < F.col("_before") + F.col("n")))
    return d.withColumn("place", F.col("place") - F.col("_before")).drop("_before", "n")


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(subject, p, value): the interpolated percentiles of each column's known values, as SQL's PERCENTILE_CONT. A column without values has no row.

    ``df`` is computed once: its columns are written in long form to the session's shared folder."""
    spark = df.sparkSession
    cells = F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).cast("double").alias("v")) for c in columns])
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.select(F.explode(cells).alias("x")).select("x.*").where("v is not null").withColumn("cell", _cell(F.col("v"))).write.parquet(path)
    long = spark.read.parquet(path)

    counts = long.groupBy("subject", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    h = (F.sum("n") - 1) * F.col("p")
    ends = F.array(F.struct(F.lit(0).alias("end"), F.floor("h").alias("place")), F.struct(F.lit(1).alias("end"), F.ceil("h").alias("place")))
    wanted = counts.crossJoin(F.broadcast(spark.createDataFrame([(float(p),) for p in shares], "p double"))).groupBy("subject", "p").agg(h.alias("h"))
    places = wanted.select("subject", "p", F.explode(ends).alias("x")).select("subject", "p", "x.*")
    first = _ranked(counts, ["subject"], "cell", places)

    # at most two cells, and then two parts, a column and share: broadcast
    inside = long.join(F.broadcast(first.select("subject", "cell", "a", "b").distinct()), ["subject", "cell"])
    part = F.when(F.col("a") == F.col("b"), 0).otherwise(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * (PARTS - 1))).cast("long")
    inside = inside.select("subject", "cell", "v", part.alias("part"))
    keys = ["subject", "cell"]
    second = _ranked(inside.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n")), keys, "part", first.select(*keys, "p", "end", "place"))
    keys = ["subject", "cell", "part"]
    values = inside.join(F.broadcast(second.select(*keys).distinct()), keys).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    found = _ranked(values, keys, "v", second)
    at = lambda e: F.max(F.when(F.col("end") == e, F.col("v")))
    d = found.groupBy("subject", "p").agg(at(0).alias("low"), at(1).alias("high")).join(wanted, ["subject", "p"])
    return d.select("subject", "p", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("h") - F.floor("h"))).alias("value"))


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with a column for each name: the (column, share) it stands for; null where a column has no value."""
    d = exact_quantiles(df, sorted({c for c, _ in wanted.values()}), sorted({p for _, p in wanted.values()}))
    return d.agg(*[F.max(F.when((F.col("subject") == c) & (F.col("p") == p), F.col("value"))).alias(k) for k, (c, p) in wanted.items()])
