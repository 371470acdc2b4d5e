"""As-of joins: union both sides, then the last fact per entity. One shuffle, no row blow-up."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _grid(grid: DataFrame, key: str, time: str | None = None) -> list[Column]:
    """The grid's columns after a window by ``k``, its key taken from ``k`` itself: so Spark knows the rows to be dealt by the key still, and the next step by it needs no exchange.
    With ``time``, which is ``t`` of the window's order, rows are known to be sorted by it within the key too, and the next window or join needs no sort."""
    return [F.col("k").alias(key) if c == key else F.col("t").alias(time) if c == time else F.col(f"g.{c}") for c in grid.columns]


def asof_join(grid: DataFrame, facts: DataFrame, key: str, grid_time: str, fact_time: str, payload: list[str], tie: list[str] | None = None, shift: Column | None = None) -> DataFrame:
    """``grid`` with the ``payload`` of the latest fact of its key at or before its time.

    ``tie`` orders facts of equal time, the largest wins. ``shift`` replaces the grid's time in the
    comparison, for instance the date a year before. Grid rows without a fact get nulls."""
    time = shift if shift is not None else F.col(grid_time)
    order = [F.col(c).alias(f"_{k}") for k, c in enumerate(tie or [])]
    g = grid.select(F.struct(*grid.columns).alias("g"), F.col(key).alias("k"), time.alias("t"), F.lit(1).alias("side"))
    f = facts.groupBy(F.col(key).alias("k"), F.col(fact_time).alias("t")).agg(F.max(F.struct(*order, *payload)).alias("f")) if order else facts.select(F.col(key).alias("k"), F.col(fact_time).alias("t"), F.struct(*payload).alias("f"))
    f = f.where("t is not null").withColumn("side", F.lit(0))
    w = Window.partitionBy("k").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = g.unionByName(f, allowMissingColumns=True)
    d = both.withColumn("x", F.last("f", ignorenulls=True).over(w)).where("side = 1")
    return d.select(*_grid(grid, key, None if shift is not None else grid_time), *[F.col(f"x.{c}").alias(c) for c in payload])


class Facts(NamedTuple):
    """A table for `asof_joins`: its time may be a name or an expression, ``tie`` orders rows of equal time, the largest wins."""

    table: DataFrame
    time: str | Column
    payload: list[str]
    tie: list[str] = []


class Sums(NamedTuple):
    """A table for `asof_joins`: ``sums`` of its rows in the ``days`` days up to and including the grid's date, null where there is none."""

    table: DataFrame
    time: str
    days: int
    sums: dict[str, Column]


class Event(NamedTuple):
    """A table for `asof_joins`: whether one of its rows lies in the ``days`` days after the grid's date, as ``name``."""

    table: DataFrame
    time: str
    days: int
    name: str


def dealt(table: DataFrame, key: str, parts: int) -> DataFrame:
    """A small table for `asof_joins`, dealt as a grid of so many buckets is: what is all dealt alike meets without an exchange of the grid."""
    return table.repartition(parts, key)


def asof_joins(grid: DataFrame, key: str, grid_time: str, facts: list[Facts], sums: list[Sums] | None = None, events: list[Event] | None = None) -> DataFrame:
    """``grid`` with the payloads of the latest row at or before its time of each of several tables: one union, one exchange and one sort for all.

    Trailing sums and following events are found in the same rows; with them the grid's time is a date. If all tables and the grid are dealt by the key, no row is exchanged."""
    both = grid.select(F.struct(*grid.columns).alias("g"), F.col(key).alias("k"), F.col(grid_time).alias("t"), F.lit(1).alias("side"))
    for n, (table, time, payload, tie) in enumerate(facts):
        t = (F.col(time) if isinstance(time, str) else time).alias("t")
        value = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(tie)], *payload)
        f = table.groupBy(F.col(key).alias("k"), t).agg(F.max(value).alias(f"f{n}")) if tie else table.select(F.col(key).alias("k"), t, value.alias(f"f{n}"))
        both = both.unionByName(f.where("t is not null").withColumn("side", F.lit(0)), allowMissingColumns=True)
    found = {}
    for n, s in enumerate(sums or []):
        daily = s.table.groupBy(F.col(key).alias("k"), F.col(s.time).alias("t")).agg(*[F.sum(c).alias(name) for name, c in s.sums.items()])
        both = both.unionByName(daily.where("t is not null").select("k", "t", F.struct(*s.sums).alias(f"s{n}"), F.lit(0).alias("side")), allowMissingColumns=True)
        found |= {name: F.expr(f"sum(s{n}.{name}) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN {s.days} PRECEDING AND CURRENT ROW)") for name in s.sums}
    for n, e in enumerate(events or []):
        day = e.table.select(F.col(key).alias("k"), F.col(e.time).alias("t"), F.col(e.time).alias(f"e{n}"), F.lit(0).alias("side"))
        both = both.unionByName(day.where("t is not null"), allowMissingColumns=True)
        found[e.name] = F.expr(f"min(e{n}) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN 1 FOLLOWING AND {e.days} FOLLOWING) IS NOT NULL")
    w = Window.partitionBy("k").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    d = both.withColumns({f"x{n}": F.last(f"f{n}", ignorenulls=True).over(w) for n in range(len(facts))}).withColumns(found).where("side = 1")
    return d.select(*_grid(grid, key, grid_time), *[F.col(f"x{n}.{c}").alias(c) for n, f in enumerate(facts) for c in f.payload], *found)


def asof_next(grid: DataFrame, facts: DataFrame, key: str, grid_time: str, fact_time: str, payload: list[str], tie: list[str] | None = None) -> DataFrame:
    """``grid`` with the ``payload`` of the first fact of its key at or after its time; of equal times the smallest ``tie`` wins.

    The mirror of `asof_join`: facts stand behind the grid rows of their time, and the window looks at the rows that follow."""
    order = [F.col(c).alias(f"_{k}") for k, c in enumerate(tie or [])]
    g = grid.select(F.struct(*grid.columns).alias("g"), F.col(key).alias("k"), F.col(grid_time).alias("t"), F.lit(0).alias("side"))
    value = F.struct(*order, *payload)
    f = facts.where(F.col(fact_time).isNotNull()).groupBy(F.col(key).alias("k"), F.col(fact_time).alias("t")).agg(F.min(value).alias("f")).withColumn("side", F.lit(1))
    w = Window.partitionBy("k").orderBy("t", "side").rowsBetween(0, Window.unboundedFollowing)
    d = g.unionByName(f, allowMissingColumns=True).withColumn("x", F.first("f", ignorenulls=True).over(w)).where("side = 0")
    return d.select(*_grid(grid, key), *[F.col(f"x.{c}").alias(c) for c in payload])


def year_after(day: str | Column) -> Column:
    """The first date whose day one year before is on or after ``day``: what was filed on ``day`` is a year old from then on."""
    d = F.col(day) if isinstance(day, str) else day
    leap = (F.month(d) == 2) & (F.dayofmonth(d) == 29)
    return F.when(leap, F.date_add(F.add_months(d, 12), 1)).otherwise(F.add_months(d, 12))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, time: str, first: str, last: str, days: int, how: str = "inner") -> DataFrame:
    """``intervals`` with the ``points`` of their key from ``first`` to ``last``, both included; ``how`` is inner or left (of the intervals).

    Both sides are joined by key and cell of ``days`` days: a point is in one cell, an interval in each one that it touches, so a pair meets
    once and an entity's points meet only the intervals near them. ``days`` of about an interval's length keep the rows that
    are compared and dropped within a small multiple of the result. Names must be distinct but for the key."""
    cell = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / days)
    p = points.withColumn("_cell", cell(F.col(time)))
    i = intervals.withColumn("_id", F.monotonically_increasing_id()) if how == "left" else intervals
    cells = i.where(F.col(first) <= F.col(last)).withColumn("_cell", F.explode(F.sequence(cell(F.col(first)), cell(F.col(last)))))
    met = cells.join(p, [key, "_cell"]).where(F.col(time).between(F.col(first), F.col(last))).drop("_cell")
    if how == "inner":
        return met
    found = met.select("_id", *[c for c in points.columns if c != key])
    return i.join(found, "_id", "left").drop("_id")


def next_event_within(grid: DataFrame, events: DataFrame, key: str, grid_time: str, event_time: str, days: int, name: str) -> DataFrame:
    """``grid`` with whether an event of its key lies in the ``days`` days after its date."""
    g = grid.select(F.struct(*grid.columns).alias("g"), F.col(key).alias("k"), F.col(grid_time).alias("t"), F.lit(None).cast("date").alias("e"))
    e = events.select(F.lit(None).cast(g.schema["g"].dataType).alias("g"), F.col(key).alias("k"), F.col(event_time).alias("t"), F.col(event_time).alias("e")).distinct()
    d = g.unionByName(e).withColumn("n", F.datediff("t", F.lit("1970-01-01")))
    w = Window.partitionBy("k").orderBy("n").rangeBetween(1, days)
    return d.withColumn(name, F.min("e").over(w).isNotNull()).where("g is not null").select(*_grid(grid, key), name)


def trailing_sums(grid: DataFrame, facts: DataFrame, key: str, grid_time: str, fact_time: str, days: int, sums: dict[str, Column]) -> DataFrame:
    """``grid`` with sums of facts in the ``days`` days up to and including its date; null where there is none.

    Facts are summed per key and day first, so a busy day is one row."""
    daily = facts.groupBy(F.col(key).alias("k"), F.col(fact_time).alias("t")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    g = grid.select(F.struct(*grid.columns).alias("g"), F.col(key).alias("k"), F.col(grid_time).alias("t"))
    d = g.unionByName(daily, allowMissingColumns=True).withColumn("n", F.datediff("t", F.lit("1970-01-01")))
    w = Window.partitionBy("k").orderBy("n").rangeBetween(-days, 0)
    return d.withColumns({n: F.sum(n).over(w) for n in sums}).where("g is not null").select(*_grid(grid, key), *sums)
