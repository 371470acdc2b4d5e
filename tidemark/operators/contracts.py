"""Declared contracts of tables, compiled into one aggregate a table and one co-partitioned full join for parity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """What a table must be. ``optional`` tables may be absent; the rules of an absent one are UNKNOWN, and its absence fails unless it is optional."""

    name: str
    #: Column -> type, or None for any.
    columns: dict[str, str | None]
    key: tuple[str, ...] = ()
    #: Columns without nulls.
    required: tuple[str, ...] = ()
    #: (column, first, last) dates, both included.
    dates: tuple[str, str, str] | None = None
    #: Keys that must be those of another table: (its name, a condition on it or None).
    same_keys: tuple[str, str | None] | None = None
    optional: bool = False
    least_rows: int = 1


RESULT = "contract string, rule string, subject string, value double, status string"


def _result(contract: str, rule: str, subject: str, value: Column, status: Column) -> Column:
    return F.struct(F.lit(contract).alias("contract"), F.lit(rule).alias("rule"), F.lit(subject).alias("subject"), value.cast("double").alias("value"), status.alias("status"))


def _judged(ok: Column) -> Column:
    return F.when(ok.isNull(), "UNKNOWN").when(ok, "PASS").otherwise("FAIL")


def check(spark: SparkSession, tables: dict[str, DataFrame | None], contracts: list[Contract]) -> DataFrame:
    """(contract, rule, subject, value, status) of every rule: exists, column, rows, duplicates, nulls, dates, keys (in one table only, either way).

    PASS or FAIL, UNKNOWN where the table or a column it needs is absent. Each table is aggregated once by its key; tables with equal keys meet
    in one full join, which bucketed tables need no exchange for."""
    fixed: list[tuple] = []
    frames: list[DataFrame] = []
    for c in contracts:
        df = tables.get(c.name)
        there = df is not None
        fixed.append((c.name, "exists", c.name, float(there), "PASS" if there else "UNKNOWN" if c.optional else "FAIL"))
        have = dict(df.dtypes) if there else {}
        for name, kind in c.columns.items():
            ok = name in have and (kind is None or have[name] == kind)
            fixed.append((c.name, "column", name, float(name in have), "UNKNOWN" if not there else "PASS" if ok else "FAIL"))
        unknown = [("rows", c.name), *([("duplicates", ",".join(c.key))] if c.key else []), *[("nulls", x) for x in c.required], *([("dates", c.dates[0])] if c.dates else [])]
        if not there:
            fixed += [(c.name, rule, subject, None, "UNKNOWN") for rule, subject in unknown]
            fixed += [(c.name, "keys", f"{c.name} - {c.same_keys[0]}", None, "UNKNOWN"), (c.name, "keys", f"{c.same_keys[0]} - {c.name}", None, "UNKNOWN")] if c.same_keys else []
            continue
        usable = all(k in have for k in c.key)
        d = df
        sums = {"n": F.count(F.lit(1))} | {f"null_{x}": F.count_if(F.col(x).isNull()) for x in c.required if x in have}
        if c.dates and c.dates[0] in have:
            sums |= {"first": F.min(F.col(c.dates[0]).cast("date")), "last": F.max(F.col(c.dates[0]).cast("date"))}
        if c.key and usable:  # a key is counted at its second row, in a sort by key: keys that are all different fill no hash table
            d = d.withColumn("_row", F.row_number().over(Window.partitionBy(*c.key).orderBy(F.lit(0))))
            sums["dup"] = F.count_if(F.col("_row") == 2)
        d = d.agg(*[x.alias("rows" if k == "n" else k) for k, x in sums.items()])
        rows = F.coalesce("rows", F.lit(0))
        out = [_result(c.name, "rows", c.name, rows, _judged(rows >= c.least_rows))]
        if c.key:
            dup = F.col("dup") if usable else F.lit(None)
            out.append(_result(c.name, "duplicates", ",".join(c.key), dup, _judged(dup == 0)))
        for x in c.required:
            v = F.coalesce(f"null_{x}", F.lit(0)) if x in have else F.lit(None)
            out.append(_result(c.name, "nulls", x, v, _judged(v == 0)))
        if c.dates:
            known = c.dates[0] in have
            first, last = (F.col("first"), F.col("last")) if known else (F.lit(None).cast("date"), F.lit(None).cast("date"))
            away = F.greatest(F.datediff(F.lit(c.dates[1]).cast("date"), first), F.datediff(last, F.lit(c.dates[2]).cast("date")), F.lit(0))
            away = F.when(first.isNotNull(), away)
            out.append(_result(c.name, "dates", c.dates[0], away, _judged(away == 0)))
        frames.append(d.select(F.explode(F.array(*out)).alias("x")).select("x.*"))
        if c.same_keys:
            other, condition = tables.get(c.same_keys[0]), c.same_keys[1]
            if other is None or not usable:
                fixed += [(c.name, "keys", f"{c.name} - {c.same_keys[0]}", None, "UNKNOWN"), (c.name, "keys", f"{c.same_keys[0]} - {c.name}", None, "UNKNOWN")]
                continue
            a = df.groupBy(*c.key).agg(F.lit(True).alias("_a"))
            b = (other.where(condition) if condition else other).groupBy(*c.key).agg(F.lit(True).alias("_b"))
            v = a.join(b, list(c.key), "full").agg(F.count_if(F.col("_b").isNull()).alias("x"), F.count_if(F.col("_a").isNull()).alias("y"))
            both = [_result(c.name, "keys", f"{c.name} - {c.same_keys[0]}", F.col("x"), _judged(F.col("x") == 0)), _result(c.name, "keys", f"{c.same_keys[0]} - {c.name}", F.col("y"), _judged(F.col("y") == 0))]
            frames.append(v.select(F.explode(F.array(*both)).alias("x")).select("x.*"))
    result = spark.createDataFrame(fixed, RESULT)
    for f in frames:
        result = result.unionByName(f)
    return result


class ContractError(AssertionError):
    """A table breaks its contract."""


def require(result: DataFrame) -> None:
    """Raise `ContractError` naming the rules that fail, if any does; the result is one row a rule."""
    failed = [f"{r['contract']}: {r['rule']} {r['subject']} ({r['value']})" for r in result.where("status = 'FAIL'").toLocalIterator()]
    if failed:
        raise ContractError("; ".join(failed))
