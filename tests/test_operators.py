"""Edge rules on small hand-built frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import r6, sample_skewness, size_tier
from tidemark.operators import asof, buckets, checks, holdings, quality, series, universe

D = dt.date


def days(n, start=D(2020, 1, 1)):
    return [start + dt.timedelta(k) for k in range(n)]


def test_asof_takes_the_latest_and_breaks_ties(spark):
    grid = spark.createDataFrame([(1, D(2020, 1, 1)), (1, D(2020, 1, 5)), (2, D(2020, 1, 5))], "k long, date date")
    facts = spark.createDataFrame([(1, D(2020, 1, 2), 1, "a"), (1, D(2020, 1, 2), 2, "b"), (1, D(2020, 1, 6), 3, "c")], "k long, at date, rank int, v string")
    got = {(r["k"], r["date"]): r["v"] for r in asof.asof_join(grid, facts, "k", "date", "at", ["v"], tie=["rank"]).collect()}
    assert got == {(1, D(2020, 1, 1)): None, (1, D(2020, 1, 5)): "b", (2, D(2020, 1, 5)): None}


def test_asof_ignores_later_facts(spark):
    grid = spark.createDataFrame([(1, d) for d in days(5)], "k long, date date")
    facts = spark.createDataFrame([(1, D(2020, 1, 2), "a")], "k long, at date, v string")
    more = facts.unionByName(spark.createDataFrame([(1, D(2020, 1, 9), "z")], "k long, at date, v string"))
    read = lambda f: sorted(tuple(r) for r in asof.asof_join(grid, f, "k", "date", "at", ["v"]).collect())
    key = lambda rows: [(a, b, c or "") for a, b, c in rows]
    assert key(read(facts)) == key(read(more))


def test_next_event_excludes_the_day_itself(spark):
    grid = spark.createDataFrame([(1, d) for d in days(4)], "k long, date date")
    event = spark.createDataFrame([(1, D(2020, 1, 3))], "k long, e date")
    got = {r["date"].day: r["hit"] for r in asof.next_event_within(grid, event, "k", "date", "e", 1, "hit").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


@pytest.mark.parametrize(("reason", "flag"), [("bankruptcyliquidation", True), ("mergerfrom", False), (None, None)])
def test_labels_at_the_end_of_a_series(spark, reason, flag):
    bars = spark.createDataFrame([(1, d, 10.0 + k) for k, d in enumerate(days(4))], "ticker long, date date, closeadj double")
    events = spark.createDataFrame([(1, D(2020, 1, 4), reason)] if reason else [], "ticker long, date date, reason string")
    got = {r["date"].day: r for r in universe.forward_labels(bars, events, (2,)).collect()}
    assert got[1]["fwd_ret_2td"] == pytest.approx(0.2) and got[1]["fwd_delisted_2td"] is False
    assert got[3]["fwd_ret_2td"] == pytest.approx(13 / 12 - 1) and got[3]["fwd_holding_days_2td"] == 1 and got[3]["fwd_delisted_2td"] is flag
    assert got[4]["fwd_ret_2td"] is None and got[4]["fwd_delisted_2td"] is None and got[4]["fwd_delist_type_2td"] == (None if reason == "mergerfrom" else reason)


def test_ten_year_growth_needs_eleven_positive_ends(spark):
    rows = [("a", 2000 + k, 100.0 * 1.1**k) for k in range(12)] + [("b", 2000 + k, 1.0) for k in range(10)] + [("c", 2000 + k, -1.0 + k) for k in range(11)]
    d = spark.createDataFrame(rows, "ticker string, fy int, ncfo double")
    got = {r["ticker"]: r["ncfo_cagr_10y"] for r in quality.strict_growth(d, "ncfo", 10, ["ticker"]).collect()}
    assert got["a"] == pytest.approx(0.1) and got["b"] is None and got["c"] is None


def test_log_trend_numbers_positives_anew(spark):
    d = spark.createDataFrame([("a", 2000, 1.0), ("a", 2001, -5.0), ("a", 2002, 2.0), ("a", 2003, 4.0), ("b", 2000, 3.0), ("b", 2001, 3.0), ("b", 2002, 3.0)], "ticker string, fy int, x double")
    got = {r["ticker"]: r for r in quality.log_trend(d, "x", 5, ["ticker"]).collect()}
    assert got["a"]["x_r2_5y"] == pytest.approx(1.0) and got["a"]["x_positive_5y"] == 0.75
    assert got["b"]["x_r2_5y"] == 0.0


def test_state_prefers_amendments_once_filed(spark):
    f = spark.createDataFrame([(1, D(2020, 3, 31), D(2020, 5, 1), 1.0), (1, D(2020, 3, 31), D(2020, 6, 1), 2.0)], "ticker long, reportperiod date, datekey date, v double")
    got = {r["vintage"]: r["v"] for r in quality.state(quality.vintages(f), f).collect()}
    assert got == {D(2020, 5, 1): 1.0, D(2020, 6, 1): 2.0}


def test_insider_nulls_and_zeros(spark):
    grid = spark.createDataFrame([(1, D(2020, 1, 1))], "ticker long, date date")
    trades = spark.createDataFrame([(2, D(2020, 1, 1), "P", " y", 5.0, 10.0)], "ticker long, filingdate date, transactioncode string, isofficer string, transactionshares double, sharesownedbeforetransaction double")
    r = holdings.insider_features(grid, trades).first()
    assert r["insider_buys"] == 0 and r["officer_buy_shares"] == 0 and r["insider_net_shares"] is None and r["insider_net_ratio"] is None


def test_absent_months_are_zero_and_absent_buckets_null(spark):
    s = spark.createDataFrame([(D(2020, 1, 31), 1, 0.1), (D(2020, 1, 31), 2, 0.2), (D(2020, 3, 31), 1, 0.3)], "date date, bucket int, ret double")
    got = {(r["month_end"].month, r["bucket"]): r["ret"] for r in buckets.returns_by_month(s).collect()}
    assert got == {(1, 1): 0.1, (1, 2): 0.2, (2, 1): 0.0, (2, 2): 0.0, (3, 1): 0.3, (3, 2): None}


def test_series_clean_keeps_the_last_readable(spark):
    raw = spark.createDataFrame([("2020-01-01", "1", 1), ("2020-01-01", "2", 2), ("2020-01-02", ".", 1), ("bad", "3", 1)], "date string, value string, at int")
    assert [tuple(r) for r in series.clean(raw).collect()] == [(D(2020, 1, 1), 2.0)]


def test_small_column_rules(spark):
    d = spark.createDataFrame([(1.0, None), (2.0, 40e6), (4.0, 3e9)], "x double, cap double")
    assert [r[0] for r in d.select(size_tier("cap")).collect()] == [None, 1, 4]
    assert d.agg(sample_skewness("x")).first()[0] == pytest.approx(0.9352195)
    assert d.limit(2).agg(sample_skewness("x")).first()[0] is None
    assert spark.range(1).select(r6(F.lit(0.1234565))).first()[0] == 0.123457


def test_report_states(spark):
    d = spark.createDataFrame([(1.0, 5.0, None)], "a double, b double, c double")
    got = {r["subject"]: r["status"] for r in checks.report(d, {"a": ("x", 0, 2), "b": ("x", 0, 2), "c": ("x", 0, 2)}).collect()}
    assert got == {"a": "PASS", "b": "FAIL", "c": "UNKNOWN"}


def test_optional_table(spark, tmp_path):
    from tidemark.sources.inputs import first_available, optional_table

    schema = "ticker long, date date, value double"
    none = optional_table(spark, f"{tmp_path}/absent", schema)
    assert none.count() == 0 and none.dtypes == [("ticker", "bigint"), ("date", "date"), ("value", "double")]
    spark.createDataFrame([(1, "x")], "ticker int, extra string").write.parquet(f"{tmp_path}/there")
    some = optional_table(spark, f"{tmp_path}/there", schema)
    assert some.dtypes == none.dtypes and [tuple(r) for r in some.collect()] == [(1, None, None)]
    d = spark.createDataFrame([(6.0, 3.0)], "gp double, revenue double")
    choices = ((("grossmargin",), F.col("grossmargin")), (("gp", "revenue"), F.col("gp") / F.col("revenue")))
    assert d.select(first_available(d, *choices).alias("m")).first()["m"] == 2.0
    assert d.select(first_available(d.drop("gp"), *choices).alias("m")).first()["m"] is None


def test_roles_leave_no_views(spark):
    from tidemark.sources.roles import Roles

    before = {t.name for t in spark.catalog.listTables()}
    assert Roles(spark, "/root/testdata/sf0.001").vendor.count() > 0
    assert {t.name for t in spark.catalog.listTables()} == before
