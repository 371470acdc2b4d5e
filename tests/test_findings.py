"""What findings of reviews asked for: whole jobs, one exchange where one is enough, no large task."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import plans, registry  # noqa: F401
from tidemark.functions.columns import by
from tidemark.operators import asof, buckets, contracts, holding, peers, quality, states, universe
from tidemark.plans import q_buckets, q_checks, q_panel, q_quality, q_strategies
from tidemark.sources.roles import Roles

D = dt.date


def test_terminal_returns_reads_all_bars(spark):
    assert "rn <=" not in registry.ORACLES["terminal_returns"].lower()
    plan = registry.QUERIES["terminal_returns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "<= 252" not in plan and "WindowGroupLimit" not in plan


def plan_of(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_contract_counts_keys_without_a_hash_table_of_them(spark):
    rows = [("a", D(2020, 1, 1), 1.0), ("a", D(2020, 1, 1), None), ("a", D(2020, 1, 1), 2.0), ("b", D(2020, 1, 1), None), (None, D(2020, 1, 1), 1.0), (None, D(2020, 1, 1), 1.0)]
    d = spark.createDataFrame(rows, "ticker string, date date, v double")
    got = contracts.check(spark, {"t": d}, [contracts.Contract("t", {}, ("ticker", "date"), ("v",))])
    assert "keys=[ticker" not in plan_of(got)
    assert {r["rule"]: r["value"] for r in got.collect()} == {"exists": 1.0, "rows": 6.0, "duplicates": 2.0, "nulls": 2.0}


def test_filings_are_read_from_tables(spark):
    r = Roles(spark, "/root/testdata/sf0.001")
    years, quarters = q_quality._fixed(r)
    assert "lineitem" not in plan_of(years) and "lineitem" not in plan_of(quarters)
    assert r.keep("quarters") is r.keep() and r.arq.count() == Roles(spark, "/root/testdata/sf0.001").arq.count()


def test_what_follows_an_asof_join_by_entity_needs_no_exchange(spark):
    g = spark.createDataFrame([("a", D(2020, 1, 2)), ("b", D(2020, 1, 1))], "ticker string, date date")
    f = spark.createDataFrame([("a", D(2020, 1, 1), 7.0)], "ticker string, day date, v double")
    one = asof.asof_join(g, f, "ticker", "date", "day", ["v"])
    many = asof.asof_joins(g, "ticker", "date", [asof.Facts(f, "day", ["v"])])
    sums = asof.trailing_sums(g, f, "ticker", "date", "day", 3, {"v": F.col("v")})
    for d in (one, many, sums):
        assert plan_of(d.groupBy("ticker").agg(F.max("v"))).count("Exchange hash") == plan_of(d).count("Exchange hash")
        assert {(r["ticker"], r["v"]) for r in d.collect()} == {("a", 7.0), ("b", None)}


def test_peers_are_exchanged_once(spark):
    d = spark.createDataFrame([(k, 1, float(k), float(k), None if k == 3 else float(k)) for k in range(1, 7)] + [(9, 2, 1.0, 1.0, 1.0)], "ticker long, g long, a double, b double, c double")
    got = peers.relative(d, ["g"], ["a"], ["b"], "c")
    assert plan_of(got).count("Exchange hash") == 1
    rows = {r["ticker"]: r for r in got.collect()}
    assert rows[6]["a_vs_peers"] == pytest.approx(6 / 3.5) and rows[6]["b_minus_peers"] == 2.5 and rows[3]["c_peer_rank"] == 1.0
    assert rows[9]["a_vs_peers"] is None and rows[9]["b_minus_peers"] is None and rows[9]["c_peer_rank"] == 0.0


def test_the_merge_stores_no_wide_side(spark):
    r = Roles(spark, "/root/testdata/sf0.001")
    written, make = [], r.keep().write
    r.keep().write = lambda name, df, *a, **k: (written.append((name, len(df.columns))), make(name, df, *a, **k))[1]
    q_panel.master(r)
    assert [n for n, _ in written] == ["bars", "quarters", "arq", "ary", "peers", "master"] and max(n for k, n in written if k != "master") <= 13


def test_coverage_joins_nothing_by_entity_and_date(spark):
    assert "Join" not in plan_of(q_checks.features(Roles(spark, "/root/testdata/sf0.001")).groupBy("ticker").agg(F.count("pe"), F.count("ret_12m")))


def test_month_ends_are_picked_before_bars_and_vendor_meet(spark):
    plan = q_buckets.assigned(Roles(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    outer = next(k for k, line in enumerate(plan) if "Join LeftOuter" in line)
    assert sum("Join LeftSemi" in line for line in plan[outer:]) == 2 and not any("Join" in line for line in plan[:outer])


def test_holding_periods_sort_only_bars_of_what_is_held(spark):
    bars = spark.createDataFrame([("a", D(2020, 2, 3), 10.0), ("a", D(2020, 2, 27), 12.0), ("b", D(2020, 2, 3), 1.0), (None, D(2020, 2, 3), 1.0)], "ticker string, date date, closeadj double")
    held = spark.createDataFrame([("a", D(2020, 1, 31), D(2020, 2, 29)), ("c", D(2020, 1, 31), D(2020, 2, 29)), (None, D(2020, 1, 31), D(2020, 2, 29))], "ticker string, day date, until date")
    d = holding.returns(held, bars)
    assert "LeftSemi" in plan_of(d)
    assert [(r["ticker"], r["entry"], r["exit"], round(r["ret"], 6)) for r in d.collect()] == [("a", 10.0, 12.0, 0.2)]


def test_rows_are_not_dealt_by_family_of_labels(spark):
    labelled = spark.createDataFrame([(D(2020, 1, 1), "f", "x"), (D(2020, 1, 1), "g", "y")], "date date, family string, label string")
    rows = spark.createDataFrame([(1, D(2020, 1, 2), 0.5), (2, None, 0.5), (3, D(2019, 1, 1), 0.5)], "k int, day date, ret double")
    d = states.with_labels(rows, labelled, "day")
    assert d.columns == ["k", "day", "ret", "family", "label"]
    assert not any("ret#" in line for line in plan_of(d).splitlines() if "Window" in line)
    assert {(r["k"], r["family"], r["label"]) for r in d.collect()} == {(1, "f", "x"), (1, "g", "y"), (2, "f", None), (2, "g", None), (3, "f", None), (3, "g", None)}


def written_by(r, step):
    written, make = [], r.keep().write
    r.keep().write = lambda name, df, *a, **k: (written.append(name), make(name, df, *a, **k))[1]
    return step(r), written


def test_change_frequency_writes_no_daily_table(spark):
    d, written = written_by(Roles(spark, "/root/testdata/sf0.001"), q_checks.check_change_frequency)
    assert written == ["quarters", "arq", "ary"]
    assert plan_of(d).count("FileScan") == plan_of(d).count("FileScan parquet spark_catalog") + 1  # lines are read once, all else is a table


def test_quarters_are_summed_only_before_the_first_annual_filing(spark):
    arq = [("a", D(2019, 3 * q, 28), D(2019, 3 * q, 28) + dt.timedelta(30), 1.0, -0.5, 0.1, 10.0) for q in (1, 2, 3, 4)]
    filed = "ticker string, reportperiod date, datekey date, ncfo double, capex double, roic double, sharesbas double"
    ary = [("a", D(2019, 12, 31), D(2020, 1, 15), 9.0, -1.0, 0.2, 10.0), ("b", D(2019, 12, 31), None, 9.0, -1.0, 0.2, 10.0)]
    years, _ = quality.known_years(spark.createDataFrame(arq, filed), spark.createDataFrame(ary, filed))
    assert "min(_from" not in plan_of(years)
    assert sorted((str(r["vintage"]), r["ncfo"]) for r in years.collect()) == [("2019-10-28", 3.0), ("2020-01-15", 9.0), ("2020-01-27", 9.0)]


def test_month_panel_reads_no_table_of_bars(spark):
    plan = plan_of(q_strategies.month_panel(Roles(spark, "/root/testdata/sf0.001")))
    assert "bars_" not in plan and "lineitem" not in plan and "last_" in plan


def test_last_bars_of_months_are_those_of_the_daily_tables(spark):
    def day(k):
        return D(2020, 1, 1) + dt.timedelta(days=k)

    # entity 1 has closes of 0 and null, 2 is removed within a month, 3 ends early, 4 is no common stock, 5 has one bar, 6 has gaps of months
    rows = [(1, day(k), 10.0 + k, 1.0) for k in range(70)] + [(2, day(k), 5.0 + k % 7, 2.0) for k in range(80)] + [(3, day(k), 3.0 + k, 3.0) for k in range(40)] + [(4, day(k), 9.0, 1.0) for k in range(90)]
    rows += [(5, day(30), 1.0, 1.0)] + [(6, day(k), 2.0 + k, None if k == 0 else 1.0) for k in range(0, 300, 37)]
    rows = [(t, d, {day(30): 0.0, day(59): None, day(60): 0.0}.get(d, c) if t == 1 else c, v) for t, d, c, v in rows] + [(None, day(1), 1.0, 1.0), (1, None, 7.0, 5.0)]
    bars = spark.createDataFrame(rows, "ticker long, date date, closeadj double, volume double")
    spans = {t: [d for x, d, _, _ in rows if x == t and d] for t in range(1, 7)}
    inst = spark.createDataFrame([(t, f"s{t}", "NYSE", "ETF" if t == 4 else "Domestic Common Stock", "usd", "a", "b", min(v), max(v)) for t, v in spans.items()],
        "ticker long, symbol string, exchange string, category string, currency string, sector string, famaindustry string, firstpricedate date, lastpricedate date")
    events = spark.createDataFrame([(2, day(50), "acquisitionby"), (3, day(39), "bankruptcyliquidation"), (1, day(69), "mergerfrom")], "ticker long, date date, reason string")
    removed = universe.removals(events)

    core = universe.core(bars, inst, removed).select("ticker", "date", "closeadj", "sector")
    cap = bars.select("ticker", "date", (F.col("closeadj") * F.sum("volume").over(by("ticker").rowsBetween(Window.unboundedPreceding, 0))).alias("marketcap"))
    daily = core.join(cap, ["ticker", "date"]).join(universe.forward_labels(bars, events, (21,)), ["ticker", "date"], "left")
    want = daily.join(buckets.month_ends(core), "date").select("ticker", "date", "closeadj", "sector", "marketcap", *[f"{c}_21td" for c in universe.LABELS])
    last = universe.month_last(bars, inst, removed, 21)
    got = universe.labelled(last, events, (21,)).join(buckets.month_ends(last), "date").select(*want.columns)
    rows = sorted(map(str, want.collect()))
    assert len(rows) > 10 and any("closeadj=0.0" in x or "closeadj=None" in x for x in rows) and sorted(map(str, got.collect())) == rows


def test_the_panel_is_not_stored(spark):
    d, written = written_by(Roles(spark, "/root/testdata/sf0.001"), q_panel.master_features)
    assert written == ["bars", "quarters", "arq", "ary", "peers"]
    wide = [line for line in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "ticker" in line and "looked" in line]
    assert not wide and "Exchange hashpartitioning(k#" not in plan_of(d)  # the union of all that is looked up is dealt by entity already


def test_what_is_looked_up_in_one_sort_is_what_each_operator_finds(spark):
    g = spark.createDataFrame([("a", D(2020, 1, k), float(k)) for k in (1, 3, 5, 20)] + [("b", D(2020, 1, 4), 9.0), ("c", D(2020, 1, 4), 9.0)], "ticker string, date date, v double")
    filed = spark.createDataFrame([("a", D(2020, 1, 3), 7.0), ("a", D(2020, 1, 10), 8.0), ("b", D(2020, 1, 5), 1.0), ("b", None, 3.0)], "ticker string, day date, w double")
    trades = spark.createDataFrame([("a", D(2020, 1, 2), 1.0), ("a", D(2020, 1, 2), 2.0), ("a", D(2020, 1, 5), 4.0), ("b", D(2020, 1, 1), 8.0), (None, D(2020, 1, 4), 1.0)], "ticker string, at date, n double")
    out = spark.createDataFrame([("a", D(2020, 1, 5)), ("b", D(2020, 1, 4)), ("c", D(2020, 1, 6)), ("c", None)], "ticker string, out date")
    got = asof.asof_joins(g, "ticker", "date", [asof.Facts(filed, "day", ["w"])], [asof.Sums(trades, "at", 3, {"total": F.col("n")})], [asof.Event(out, "out", 2, "soon")])
    want = asof.trailing_sums(asof.asof_join(g, filed, "ticker", "date", "day", ["w"]), trades, "ticker", "date", "at", 3, {"total": F.col("n")})
    want = asof.next_event_within(want, out, "ticker", "date", "out", 2, "soon")
    w = Window.partitionBy("ticker").orderBy("date")
    assert plan_of(got).count("Sort [") == 1 and plan_of(got.withColumn("x", F.lag("v").over(w))).count("Sort [") == 1
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stage_tables_leave_no_exchanged_rows_behind(spark):
    kept = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, r = kept(), Roles(spark, "/root/testdata/sf0.001")
    r.keep("bars", "quarters")
    assert kept() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_ranks_and_medians_give_what_is_relative_to_peers(spark):
    rows = [(k, 1, 1, float(k), float(k), None if k == 3 else float(k)) for k in range(1, 7)] + [(9, 1, 2, 1.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "ticker long, date int, g int, a double, b double, c double")
    ranks = peers.ranked(d.withColumn("kept", F.col("ticker") != 2), ["date", "g"], ["a", "b"], "c", "kept").localCheckpoint()
    assert ranks.where("medians is not null").count() == 1 and ranks.where("ticker = 2").count() == 0
    got = d.join(ranks.select("ticker", F.col("rank").alias("c_peer_rank")), "ticker").join(ranks.where("medians is not null").select("medians.*"), ["date", "g"], "left").withColumns(peers.compared(["a"], ["b"]))
    cols = ["ticker", "a_vs_peers", "b_minus_peers", "c_peer_rank"]
    want = peers.relative(d, ["date", "g"], ["a"], ["b"], "c").where("ticker <> 2")
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_correlations_of_the_panel_are_taken_without_storing_it(spark):
    d, written = written_by(Roles(spark, "/root/testdata/sf0.001"), q_panel.feature_corr_matrix)
    assert written == ["bars", "quarters", "arq", "ary", "peers"] and plan_of(d).count("MapInArrow") == 1


def test_a_few_columns_of_the_merge_take_only_their_sides(spark):
    d, written = written_by(Roles(spark, "/root/testdata/sf0.001"), q_panel.merge_master)
    assert written == ["bars", "quarters"] and "arq_" not in plan_of(d)


def test_the_profile_of_the_panel_takes_only_its_sides(spark):
    d, written = written_by(Roles(spark, "/root/testdata/sf0.001"), q_panel.panel_profile)
    assert written == ["bars", "quarters"] and "arq_" not in plan_of(d)


def test_null_rates_by_year_take_only_their_sides(spark):
    d, written = written_by(Roles(spark, "/root/testdata/sf0.001"), q_panel.check_null_by_year)
    assert written == ["bars", "quarters", "arq", "ary"] and "peers_" not in plan_of(d)
