"""Rules of values, hand-worked, and operators against plain re-implementations."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, buckets, contracts, correlation, fundamentals, holding, quality, quantiles, restatements, series, snapshot, states, strategies, universe
from tidemark.sources import stages

D = dt.date


def years(spark, values, name="x"):
    return spark.createDataFrame([("a", 2010 + k, None if v is None else float(v)) for k, v in enumerate(values)], f"ticker string, fy int, {name} double")


def test_trends_take_the_last_years_and_not_older_ones_for_nulls(spark):
    r = quality.log_trend(years(spark, [900, 1, 2, None, 4, 8]), "x", 5, ["ticker"]).first()
    assert r["x_r2_5y"] == pytest.approx(1.0) and r["x_positive_5y"] == 1.0
    r = quality.log_trend(years(spark, [5, 7, None, None, None, 8]), "x", 5, ["ticker"]).first()
    assert r["x_r2_5y"] is None and r["x_positive_5y"] is None  # two values known


def test_arcsinh_trend_is_times_the_share_of_positives(spark):
    x = [-1.0, 2.0, 5.0, 11.0]
    r = quality.asinh_trend(years(spark, x), "x", 10, ["ticker"]).first()
    assert r["x_asinh_r2_10y"] == pytest.approx(np.corrcoef(range(4), np.arcsinh(x))[0, 1] ** 2 * 0.75)


def test_roic_level_is_the_last_years_even_if_null(spark):
    r = quality.roic_trend(years(spark, [0.9, 0.1, 0.3, None], "roic"), ["ticker"]).first()
    assert r["roic_level"] is None and r["roic_slope_3y"] == pytest.approx(0.2)


def test_dilution_is_a_year(spark):
    r = quality.dilution(years(spark, [100, 0, 110, 121], "shares"), ["ticker"]).first()
    assert r["dilution_rate"] == pytest.approx(0.1)


def test_metrics_of_steady_growth(spark):
    rows = [("a", 2012 + k, math.exp(0.1 * k), math.exp(0.08 * k), 0.12, 1e9) for k in range(12)]
    r = quality.of_years(spark.createDataFrame(rows, "ticker string, fy int, ncfo double, fcf double, roic double, shares double"), ["ticker"]).first()
    assert r["ncfo_cagr_5y"] == pytest.approx(math.exp(0.1) - 1) and r["fcf_cagr_10y"] == pytest.approx(math.exp(0.08) - 1)
    assert r["ncfo_r2_adjusted"] == pytest.approx(1) and r["fcf_ncfo_r2_delta"] == 0 and r["dilution_rate"] == 0


def filing(**more):
    base = {c: 1.0 for c in fundamentals.FILED} | {"revenueusd": None, "roe": None, "divyield": None, "datekey": D(2020, 1, 1), "reportperiod": D(2019, 12, 31), "ticker": 1}
    return base | more


def test_ratios_with_negative_revenue(spark):
    schema = "ticker long, reportperiod date, datekey date, " + ", ".join(f"{c} double" for c in fundamentals.FILED)
    row = filing(revenue=-4.0, capex=-2.0, ncfo=3.0, ebt=2.0, shareswa=10.0)
    art = spark.createDataFrame([tuple(row[c] for c in ("ticker", "reportperiod", "datekey", *fundamentals.FILED))], schema)
    r = fundamentals.with_ratios(spark.createDataFrame([(1, D(2020, 2, 1), 2.0)], "ticker long, date date, closeadj double"), art).first()
    assert (r["capex_intensity"], r["ncfo_to_revenue"], r["fcf_to_revenue"], r["ps"], r["pretax_margin"]) == (-0.5, -0.75, -0.25, -5.0, -0.5)
    assert r["sbc_pct"] is None
    assert snapshot.valuation(spark.createDataFrame([(1, D(2020, 2, 1), 2.0)], "ticker long, date date, closeadj double"), art.withColumn("netinccmn", F.lit(-1.0))).first()["pe"] == -20.0


def test_only_changes_from_a_name_cancel_a_delisting(spark):
    rows = [(1, D(2020, 1, 5), "delisted"), (1, D(2020, 1, 3), "tickerchangeto"), (2, D(2020, 1, 5), "delisted"), (2, D(2020, 1, 3), "tickerchangefrom")]
    assert [r["ticker"] for r in universe.terminal_events(spark.createDataFrame(rows, "ticker long, date date, action string")).collect()] == [1]


def test_real_rate_is_null_until_inflation_is_known(spark):
    d = spark.createDataFrame([(4.0, 1.5), (4.0, None)], "rate double, cpi double")
    assert [r[0] for r in d.select(series.real_rate("rate", "cpi")).collect()] == [2.5, None]
    assert [r[0] for r in d.select(series.real_rate("rate", None)).collect()] == [4.0, 4.0]
    assert d.select(series.real_rate(None, "cpi")).first()[0] is None


def test_ages_of_two_filings(spark):
    d = spark.createDataFrame([(D(2020, 5, 1), D(2020, 4, 1), D(2020, 4, 21)), (D(2020, 5, 1), None, D(2020, 4, 1)), (D(2020, 5, 1), None, None)], "date date, art_datekey date, arq_datekey date")
    got = [tuple(r)[3:] for r in fundamentals.staleness(d).collect()]
    assert got[0] == (D(2020, 4, 21), 10, 10 / 91.0, 30, 10, 30) and got[1] == (D(2020, 4, 1), 30, 30 / 91.0, None, 30, 30) and got[2] == (None,) * 6


def test_a_year_after(spark):
    days = spark.sql("select explode(sequence(date'2019-01-01', date'2021-12-31')) as d")
    pairs = days.crossJoin(days.select(F.col("d").alias("at"))).where("at between add_months(d, 12) - 3 and add_months(d, 12) + 3")
    assert pairs.where((F.expr("cast(at - interval 1 year as date)") >= F.col("d")) != (F.col("at") >= asof.year_after("d"))).count() == 0


def test_several_as_of_joins_in_one(spark):
    rng = np.random.default_rng(1)
    day = lambda: D(2020, 1, 1) + dt.timedelta(int(rng.integers(0, 60)))
    grid = spark.createDataFrame([(int(rng.integers(0, 4)), day()) for _ in range(200)], "k long, date date")
    one = spark.createDataFrame([(int(rng.integers(0, 4)), day(), i, float(i)) for i in range(80)], "k long, at date, rank int, v double")
    two = one.select("k", F.col("at").alias("seen"), F.col("rank").alias("w")).dropDuplicates(["k", "seen"])
    got = asof.asof_joins(grid, "k", "date", [asof.Facts(one, "at", ["v"], ["rank"]), asof.Facts(two, F.date_add("seen", 7), ["w"])])
    want = asof.asof_join(asof.asof_join(grid, one, "k", "date", "at", ["v"], tie=["rank"]), two.withColumn("t", F.date_add("seen", 7)), "k", "date", "t", ["w"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_the_next_fact_is_on_or_after(spark):
    grid = spark.createDataFrame([(1, D(2020, 1, 1)), (1, D(2020, 1, 3)), (1, D(2020, 1, 9)), (2, D(2020, 1, 1))], "k long, date date")
    facts = spark.createDataFrame([(1, D(2020, 1, 3), 2, "b"), (1, D(2020, 1, 3), 1, "a"), (1, D(2020, 1, 8), 1, "c"), (1, None, 1, "n")], "k long, at date, rank int, v string")
    got = {(r["k"], r["date"].day): r["v"] for r in asof.asof_next(grid, facts, "k", "date", "at", ["v"], tie=["rank"]).collect()}
    assert got == {(1, 1): "a", (1, 3): "a", (1, 9): None, (2, 1): None}


def test_interval_joins_compare_little_more_than_they_find(spark):
    start = D(1990, 1, 1)
    bars = spark.range(10_000).select(F.lit(1).alias("k"), F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))
    events = spark.range(1_000).select(F.lit(1).alias("k"), F.date_add(F.lit(start), (F.col("id") * 10).cast("int")).alias("first")).withColumn("last", F.date_add("first", 10))
    found = asof.interval_join(bars, events, "k", "date", "first", "last", 11)
    want = bars.join(events, "k").where("date between first and last")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))
    cell = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / 11)
    met = events.withColumn("c", F.explode(F.sequence(cell(F.col("first")), cell(F.col("last"))))).join(bars.withColumn("c", cell(F.col("date"))), ["k", "c"]).count()
    assert met <= 3 * found.count()
    odd = spark.createDataFrame([(1, D(1980, 1, 1), D(1980, 2, 1)), (2, D(2000, 1, 1), D(2000, 1, 2)), (1, D(2000, 1, 2), D(2000, 1, 1))], "k long, first date, last date")
    assert asof.interval_join(bars, odd, "k", "date", "first", "last", 11, "left").where("date is null").count() == 3


def test_exact_percentiles(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_cauchy(500) * 10.0 ** rng.integers(-20, 20, 500), np.zeros(40), np.full(60, -3.25), [1e300, -1e300, 5e-324]])
    y = rng.integers(0, 3, len(x)).astype(float)
    d = spark.createDataFrame([(float(a), None if k % 5 == 0 else float(b), None) for k, (a, b) in enumerate(zip(x, y))], "x double, y double, z double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    got = {(r["subject"], r["p"]): r["value"] for r in quantiles.exact_quantiles(d, ["x", "y", "z"], shares).collect()}
    assert set(got) == {(c, p) for c in "xy" for p in shares}
    for p in shares:
        assert got["x", p] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=0)
        assert got["y", p] == np.quantile([b for k, b in enumerate(y) if k % 5], p)
    assert quantiles.quantile_row(d, {"m": ("x", 0.5), "n": ("z", 0.5)}).first()["n"] is None


def test_correlations_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1, (400, 5))
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=400)
    x[:, 3] = 7.5
    x[rng.random((400, 5)) < 0.2] = np.nan
    names = list("abcde")
    d = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in names)).repartition(3)
    for r in correlation.matrix(d, names).collect():
        i, j = names.index(r["a"]), names.index(r["b"])
        ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert i < j and r["n"] == ok.sum()
        assert r["corr"] is None if 3 in (i, j) else r["corr"] == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs=1e-9)


def test_correlations_take_one_pass(spark):
    rows = [(1e9 + k % 7, float(k % 5), 3.0 if k % 2 else float(k), None) for k in range(400)]
    d = spark.createDataFrame(rows, "a double, b double, c double, e double").withColumn("e", F.when(F.col("c") == 3.0, F.col("a"))).repartition(3)
    m = correlation.matrix(d, ["a", "b", "c", "e"])
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in m.collect()}
    x = np.array([[r[0], r[1], r[2]] for r in rows])
    want = np.corrcoef(x.T)
    assert got["a", "b"] == (400, pytest.approx(want[0, 1], abs=1e-9)) and got["b", "c"] == (400, pytest.approx(want[1, 2], abs=1e-9))
    assert got["c", "e"] == (sum(r[2] == 3.0 for r in rows), None)  # c is the same wherever e is known, far from its own mean


def test_correlations_run_no_job_when_built(spark):
    d = spark.range(5).select(F.assert_true(F.col("id") < 0, F.lit("read")).cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    assert correlation.matrix(d, ["a", "b"]).columns == ["a", "b", "n", "corr"]


def test_contracts(spark):
    t = spark.createDataFrame([(1, D(2020, 1, 1), 1.0), (1, D(2020, 1, 1), None), (2, D(2020, 6, 1), 2.0)], "k long, date date, v double")
    other = spark.createDataFrame([(1, D(2020, 1, 1), True), (3, D(2020, 1, 1), True), (4, D(2020, 1, 1), False)], "k long, date date, inside boolean")
    rules = [contracts.Contract("t", {"k": "bigint", "v": "int", "w": None}, ("k", "date"), ("v", "w"), ("date", "2020-01-01", "2020-03-31"), ("other", "inside")), contracts.Contract("gone", {"k": None}, ("k",), same_keys=("t", None)), contracts.Contract("may", {}, optional=True)]
    result = contracts.check(spark, {"t": t, "other": other}, rules)
    got = {(r["contract"], r["rule"], r["subject"]): (r["value"], r["status"]) for r in result.collect()}
    assert got["t", "exists", "t"] == (1.0, "PASS") and got["t", "column", "k"][1] == "PASS" and got["t", "column", "v"][1] == "FAIL" and got["t", "column", "w"] == (0.0, "FAIL")
    assert got["t", "rows", "t"] == (3.0, "PASS") and got["t", "duplicates", "k,date"] == (1.0, "FAIL") and got["t", "nulls", "v"] == (1.0, "FAIL") and got["t", "nulls", "w"] == (None, "UNKNOWN")
    assert got["t", "dates", "date"] == (62.0, "FAIL") and got["t", "keys", "t - other"] == (1.0, "FAIL") and got["t", "keys", "other - t"] == (1.0, "FAIL")
    assert got["gone", "exists", "gone"] == (0.0, "FAIL") and got["gone", "rows", "gone"] == (None, "UNKNOWN") and got["gone", "keys", "gone - t"][1] == "UNKNOWN" and got["may", "exists", "may"][1] == "UNKNOWN"
    with pytest.raises(contracts.ContractError, match="duplicates"):
        contracts.require(result)
    none = contracts.check(spark, {"t": t.limit(0)}, [contracts.Contract("t", {}, ("k",), ("v",), ("date", "2020-01-01", "2020-03-31"))])
    assert {r["rule"]: r["status"] for r in none.collect()} == {"exists": "PASS", "rows": "FAIL", "duplicates": "PASS", "nulls": "PASS", "dates": "UNKNOWN"}


def test_state_rules(spark):
    market = spark.createDataFrame([(D(2020, 1, 1), 100.0), (D(2020, 1, 2), 89.0), (D(2020, 1, 3), 79.0), (D(2020, 1, 4), 95.0)], "date date, closeadj double")
    macro = spark.createDataFrame([(D(2020, 1, 1), 14.0, 1.0, 3.0), (D(2020, 1, 2), 31.0, -1.0, 7.0), (D(2020, 1, 3), None, -1.0, None), (D(2020, 1, 4), 20.0, 0.0, 5.0)], "date date, vix double, yield_curve double, hy_spread double")
    rules = (*states.RULES[:5], states.Rule("inverted", "curve_days >= 2", "curve"), *states.RULES[6:])
    found = states.labels(states.indicators(market, macro), rules)
    got = {}
    for r in found.collect():
        got.setdefault(r["family"], {})[r["date"].day] = r["label"]
    assert got["drawdown"] == {1: "normal", 2: "correction", 3: "bear", 4: "normal"} and got["volatility"] == {1: "complacent", 2: "stress", 3: "normal", 4: "normal"}
    assert got["curve"] == {1: "normal", 2: "normal", 3: "inverted", 4: "normal"} and got["credit"] == {1: "bull", 2: "systemic", 3: "normal", 4: "normal"} and set(got["recession"].values()) == {"normal"}
    rows = spark.createDataFrame([(D(2020, 1, 10), 1.0), (D(2019, 1, 1), 2.0)], "day date, ret double")
    of = {(r["day"].year, r["family"]): r["label"] for r in states.with_labels(rows, found, "day").collect()}
    assert of[2020, "drawdown"] == "normal" and of[2019, "drawdown"] is None and len(of) == 10


def test_tiles_are_sqls(spark):
    d = spark.range(1, 60).select(F.col("id").alias("count")).withColumn("place", F.explode(F.sequence(F.lit(1), "count")))
    for n in (1, 3, 5, 10):
        w = Window.partitionBy("count").orderBy("place")
        assert d.withColumns({"a": F.ntile(n).over(w), "b": strategies.tile(F.col("place"), F.col("count"), F.lit(n))}).where("a <> b").count() == 0


def test_strategies_screen_rank_and_sort(spark):
    rows = [(k, D(2020, 1, 31), "x" if k % 2 else "Real Estate", float(k), 0.1, None, float(k % 4) or None, 20.0) for k in range(1, 13)]
    panel = spark.createDataFrame(rows, "ticker long, date date, sector string, marketcap double, fwd_ret double, delisted boolean, pe double, vix double")
    two = (strategies.Strategy("all", "pe", 2, 6), strategies.Strategy("some", "pe", 3, 6, exclude_sectors=("Real Estate",), bands={"vix": (20, None)}))
    got = strategies.assign(panel, two).collect()
    assert sorted(r["ticker"] for r in got if r["strategy"] == "all") == [5, 6, 7, 9, 10, 11] and sorted(r["ticker"] for r in got if r["strategy"] == "some") == [1, 3, 5, 7, 9, 11]
    assert [(r["ticker"], r["bucket"]) for r in sorted(got, key=lambda r: (r["metric"], r["ticker"])) if r["strategy"] == "all"] == [(5, 1), (9, 1), (6, 1), (10, 2), (7, 2), (11, 2)]


def test_statistics_use_the_calendar(spark):
    s = spark.createDataFrame([(D(2020, 1, 31), 1, 0.10), (D(2020, 3, 31), 1, -0.05), (D(2020, 4, 30), 1, -0.02)], "date date, bucket int, ret double")
    r = buckets.performance(buckets.returns_by_month(s), "month_end").first()
    x = np.array([0.1, 0.0, -0.05, -0.02])
    assert r["ann_return"] == pytest.approx(x.mean() * 12) and r["sharpe"] == pytest.approx(x.mean() * 12 / (x.std(ddof=1) * 12**0.5))
    assert r["sortino"] == pytest.approx(x.mean() * 12 / (x[x < 0].std(ddof=1) * 12**0.5)) and r["cagr"] == pytest.approx(np.prod(1 + x) ** (365.25 / 90) - 1) and r["max_drawdown"] == pytest.approx(0.95 * 0.98 - 1)


def test_holding_periods_between_days_without_trading(spark):
    bars = spark.createDataFrame([(1, D(2020, 1, 2), 10.0), (1, D(2020, 1, 30), 12.0), (1, D(2020, 2, 3), 15.0), (2, D(2020, 1, 5), 4.0)], "ticker long, date date, closeadj double")
    held = spark.createDataFrame([(1, D(2020, 1, 1), D(2020, 2, 1)), (1, D(2020, 1, 31), D(2020, 2, 29)), (2, D(2020, 1, 6), D(2020, 2, 1)), (2, D(2020, 1, 1), D(2020, 3, 1))], "ticker long, day date, until date")
    got = {(r["ticker"], r["day"]): (r["entry"], r["exit"]) for r in holding.returns(held, bars).collect()}
    assert got == {(1, D(2020, 1, 1)): (10.0, 12.0), (1, D(2020, 1, 31)): (15.0, 15.0), (2, D(2020, 1, 1)): (4.0, 4.0)}


def test_rebalance_calendar(spark):
    ends = spark.createDataFrame([(D(2020, 2, 10), D(2020, 7, 3))], "a date, b date")
    got = {}
    for r in holding.calendar(ends).orderBy("day").collect():
        got.setdefault(r["frequency"], []).append((r["day"].month, r["next_day"] and r["next_day"].month))
    assert got["quarterly"] == [(3, 6), (6, None)] and got["monthly"] == [(k, k + 1 if k < 7 else None) for k in range(2, 8)] and "annually" not in got


def test_restatements(spark):
    rows = [(1, D(2019, 3, 31), D(2019, 5, 1), 100.0), (1, D(2019, 3, 31), D(2019, 8, 1), 94.0), (1, D(2019, 6, 30), D(2019, 8, 1), 0.0), (1, D(2019, 6, 30), D(2019, 9, 1), 5.0), (1, D(2019, 9, 30), D(2019, 11, 1), 7.0), (1, D(2019, 12, 31), D(2020, 2, 1), 8.0)]
    f = spark.createDataFrame(rows, "ticker long, reportperiod date, datekey date, ncfo double")
    m = restatements.magnitudes(f, ["ncfo"], 0.05).collect()
    assert len(m) == 1 and m[0]["pct_change"] == pytest.approx(-6) and m[0]["material"] and (m[0]["original_date"], m[0]["restated_date"]) == (D(2019, 5, 1), D(2019, 8, 1))
    dates = spark.createDataFrame([(D(2019, 6, 1),), (D(2020, 3, 1),)], "date date")
    t = {r["date"]: r for r in restatements.trace(f, "ncfo", dates).collect()}
    assert t[D(2019, 6, 1)]["days_stale"] == 31 and t[D(2019, 6, 1)]["ncfo_ttm"] is None and t[D(2019, 6, 1)]["r2"] is None
    assert t[D(2020, 3, 1)]["ncfo_ttm"] == 94 + 5 + 7 + 8 and t[D(2020, 3, 1)]["oldest_age"] == (D(2020, 3, 1) - D(2019, 8, 1)).days and t[D(2020, 3, 1)]["filings_known"] == 6
    early = {(r["version"], r["reportperiod"].month): r["ncfo"] for r in restatements.versions(f).collect()}
    assert early[restatements.FIRST, 3] == 100 and early[restatements.LAST, 3] == 94


def test_trends_of_restatements_need_four_years(spark):
    y = spark.createDataFrame([("a", 2000 + k, v) for k, v in enumerate([1.0, -1.0, 2.0, 4.0, 8.0])] + [("b", 2000 + k, v) for k, v in enumerate([1.0, 2.0, 4.0])], "ticker string, fy int, v double")
    got = {r["ticker"]: (r["r2"], r["growth"]) for r in restatements.trend(y, "v", ["ticker"]).collect()}
    assert got == {"a": (1.0, 1.0), "b": (None, None)}


def test_stage_tables_join_without_an_exchange(spark, tmp_path):
    st = stages.Stages(spark, buckets=3, root=f"file://{tmp_path}")
    base = spark.range(300).select((F.col("id") % 7).alias("ticker"), F.date_add(F.lit(D(2019, 12, 1)), (F.col("id") / 7).cast("int")).alias("date"), F.col("id").alias("v"))
    a, b = st.write("a", base), st.write("b", base.withColumnRenamed("v", "w"))
    with stages.dealt_by_entity(spark):
        d = a.join(b, ["ticker", "date"]).hint("merge").groupBy("ticker", "date").agg(F.sum("v"))
        assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "") and d.count() == 300
    by_year = st.write("c", base, by_year=True)
    assert {r["year"] for r in by_year.select("year").distinct().collect()} == {2019, 2020}
    with pytest.raises(stages.StageError, match="nothing there"):
        st.write("none", base.where("v < 0"), profile={"n": F.count(F.lit(1))}, expect={"n": ("nothing there", 1, None)})
    assert st.profiles["none"] == {"n": 0}


def test_ordered_output(spark, tmp_path):
    d = spark.range(100).select((F.col("id") * 37 % 100).alias("x")).repartition(4)
    stages.write_ordered(d, f"{tmp_path}/o", "x")
    assert sorted(r["x"] for r in spark.read.parquet(f"{tmp_path}/o").collect()) == list(range(100))
