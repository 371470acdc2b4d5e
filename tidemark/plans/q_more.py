"""Queries: snapshots, further checks and holding-period analytics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import q6, r6, size_tier
from ..operators import checks as C
from ..operators import contracts as CT
from ..operators import fundamentals as FU
from ..operators import holding as HD
from ..operators import holdings as H
from ..operators import prices as PR
from ..operators import quality as Q
from ..operators import restatements as RS
from ..operators import series as S
from ..operators import states as SL
from ..operators import universe as U
from ..operators.asof import interval_join
from ..operators.peers import medians
from ..operators.quantiles import quantile_row
from ..registry import query
from ..sources.stages import written
from .q_buckets import N, ROLES, _P, assigned, panel
from .q_checks import _report, _row
from .q_features import _ASOF, INSIDER
from .q_prices import PRICE_SQL
from .q_quality import log_sql
from .q_universe import CORE, LABELS, TERMINAL, UNIVERSE


_RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_ONE_DAY = "{0} AS (SELECT d.date, s.value FROM days d ASOF LEFT JOIN (SELECT * FROM {1}) s ON d.date >= s.date)"
STATES = f"""WITH days AS (SELECT DISTINCT date FROM bars), {_ONE_DAY.format("v", "series")}, {_ONE_DAY.format("yc", "rates WHERE series = 'yield_curve'")}, {_ONE_DAY.format("hy", "rates WHERE series = 'hy_spread'")},
fall AS (SELECT date, closeadj / max(closeadj) OVER (ORDER BY date {_RUN}) - 1 AS drawdown FROM benchmark_bars),
run AS (SELECT v.date, v.value AS vix, hy.value AS hy_spread, coalesce(yc.value < 0, false) AS low, sum(CASE WHEN coalesce(yc.value < 0, false) THEN 0 ELSE 1 END) OVER (ORDER BY v.date {_RUN}) AS k FROM v JOIN yc USING (date) JOIN hy USING (date)),
ind AS (SELECT run.*, drawdown, sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY date {_RUN}) AS curve_days FROM run LEFT JOIN fall USING (date)),
labelled AS MATERIALIZED (SELECT date, 'recession' AS family, 'normal' AS label FROM ind UNION ALL
SELECT date, 'drawdown', CASE WHEN drawdown < -0.2 THEN 'bear' WHEN drawdown < -0.1 THEN 'correction' ELSE 'normal' END FROM ind UNION ALL SELECT date, 'volatility', CASE WHEN vix > 30 THEN 'stress' WHEN vix < 15 THEN 'complacent' ELSE 'normal' END FROM ind UNION ALL
SELECT date, 'curve', CASE WHEN curve_days >= 63 THEN 'inverted' ELSE 'normal' END FROM ind UNION ALL SELECT date, 'credit', CASE WHEN hy_spread > 6 THEN 'systemic' WHEN hy_spread < 3.5 THEN 'bull' ELSE 'normal' END FROM ind)"""


def states(r):
    """The labels of every trading day; the tables have no recession series, so that family is normal throughout."""
    names = ("yield_curve", "hy_spread", "vix")
    observed = r.rates.select("date", "series", "value").unionByName(r.series.select("date", F.lit("vix").alias("series"), "value"))
    days = r.bars.select("date").distinct().withColumn("series", F.explode(F.array(*map(F.lit, names))))
    wide = S.carried(days, observed).groupBy("date").agg(*[F.max(F.when(F.col("series") == k, F.col("value"))).alias(k) for k in names])
    return SL.labels(SL.indicators(r.benchmark_bars, wide))


_DATES = ("1999-06-30", "2000-06-30", "2001-06-30")
#: R2 and yearly growth of the positive years in order, at least four, to four decimals.
_TREND = "CASE WHEN count(up) >= 4 THEN floor((CASE WHEN var_pop(up) = 0 THEN 0 ELSE regr_r2(up, i) END) * 1e4 + 0.5) / 1e4 END AS r2, CASE WHEN count(up) >= 4 THEN round(exp(regr_slope(up, i)) - 1, 4) END AS growth"
_UP = "(SELECT *, CASE WHEN v > 0 THEN ln(v) END AS up, row_number() OVER (PARTITION BY {0}, v > 0 ORDER BY fy) AS i FROM {1})"
_KNOWN = """asked AS (SELECT DISTINCT ticker, CAST(v AS DATE) AS date FROM arq CROSS JOIN (SELECT unnest({0}) AS v)),
known AS (SELECT a.date, f.* FROM asked a JOIN arq f ON f.ticker = a.ticker AND f.datekey <= a.date),
latest AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY ticker, date, reportperiod ORDER BY datekey DESC) = 1),
ky AS (SELECT ticker, date, year(reportperiod) AS fy, coalesce(sum(ncfo), 0) AS v FROM latest GROUP BY ALL HAVING count(*) >= 3),
kt AS (SELECT ticker, date, {1} FROM {2} GROUP BY ticker, date)"""
_KNOWN = _KNOWN.format(list(_DATES), _TREND, _UP.format("ticker, date", "ky"))


@query("r2_at_dates", "arq", f"WITH {_KNOWN} SELECT ticker, date, r2, growth FROM kt")
def r2_at_dates(r):
    """The trend of operating cash flow as known on some dates."""
    dates = r.spark.createDataFrame([(d,) for d in _DATES], "date string").select(F.col("date").cast("date").alias("known_on"))
    spine = r.arq.select("ticker").distinct().crossJoin(F.broadcast(dates)).withColumn("version", F.lit("known"))
    t = RS.trend(RS.annual(RS.versions(r.arq, spine), "ncfo"), "ncfo", ["ticker", "known_on"])
    return t.select("ticker", F.col("known_on").alias("date"), "r2", "growth")


@query("restatement_impact", "arq", f"""WITH v AS (SELECT ticker, reportperiod, k, x, count(*) OVER w AS n, row_number() OVER (PARTITION BY ticker, reportperiod, k ORDER BY datekey) AS i, datekey FROM ({' UNION ALL '.join(f"SELECT ticker, reportperiod, datekey, '{c}' AS k, {c} AS x FROM arq" for c in ('ncfo', 'revenue', 'netinccmn'))}) WINDOW w AS (PARTITION BY ticker, reportperiod, k))
SELECT a.ticker, a.reportperiod, a.k AS metric, {q6('a.x')} AS original, {q6('b.x')} AS restated, {q6('100 * (b.x - a.x) / abs(a.x)')} AS pct_change, abs((b.x - a.x) / a.x) >= 0.05 AS material, a.datekey AS original_date, b.datekey AS restated_date
FROM v a JOIN v b ON a.ticker = b.ticker AND a.reportperiod = b.reportperiod AND a.k = b.k AND a.i = 1 AND b.i = b.n WHERE a.n > 1 AND a.x <> 0 AND b.x IS NOT NULL""")
def restatement_impact(r):
    """First against last filed values of three metrics; a change of 5 % is material."""
    d = RS.magnitudes(r.arq, ["ncfo", "revenue", "netinccmn"], 0.05)
    return d.withColumns({c: r6(c) for c in ("original", "restated", "pct_change")})


_VERSION = "(SELECT ticker, year(reportperiod) AS fy, coalesce(sum(ncfo), 0) AS v FROM (SELECT * FROM arq WHERE datekey <= DATE '2001-06-15' QUALIFY row_number() OVER (PARTITION BY ticker, reportperiod ORDER BY datekey {0}) = 1) GROUP BY 1, 2)"


@query("restatement_r2", "arq", f"""WITH o AS (SELECT ticker, {_TREND} FROM {_UP.format('ticker', _VERSION.format('ASC'))} GROUP BY ticker), n AS (SELECT ticker, {_TREND} FROM {_UP.format('ticker', _VERSION.format('DESC'))} GROUP BY ticker)
SELECT *, CASE WHEN abs(delta) < 0.01 THEN 'negligible' WHEN abs(delta) < 0.05 THEN 'minor' WHEN delta < 0 THEN 'lower' ELSE 'higher' END AS effect FROM (SELECT ticker, o.r2 AS r2_original, n.r2 AS r2_restated, round(n.r2 - o.r2, 6) AS delta FROM o JOIN n USING (ticker) WHERE o.r2 IS NOT NULL AND n.r2 IS NOT NULL)""")
def restatement_r2(r):
    """What the trend of operating cash flow owes to restatements."""
    return RS.effect_on_trend(r.arq, "ncfo", "2001-06-15")


@query("restatement_trace", "arq", f"""WITH {_KNOWN}, back AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY reportperiod DESC) AS k FROM latest),
t AS (SELECT ticker, date, max(datekey) AS last_filing, CASE WHEN count(*) >= 4 THEN coalesce(sum(CASE WHEN k <= 4 THEN ncfo END), 0) END AS ttm, min(CASE WHEN k <= 4 THEN datekey END) AS oldest FROM back GROUP BY ticker, date)
SELECT t.ticker, t.date, last_filing, datediff('day', last_filing, t.date) AS days_stale, {q6('ttm')} AS ncfo_ttm, datediff('day', oldest, t.date) AS oldest_age, (SELECT count(*) FROM known k WHERE k.ticker = t.ticker AND k.date = t.date) AS filings_known, r2, growth FROM t LEFT JOIN kt USING (ticker, date)""")
def restatement_trace(r):
    """What an as-of join sees on some dates: last filing and its age, the trailing year and the age of its oldest part, the trend."""
    dates = r.spark.createDataFrame([(d,) for d in _DATES], "date string").select(F.col("date").cast("date").alias("date"))
    return RS.trace(r.arq, "ncfo", dates).withColumn("ncfo_ttm", r6("ncfo_ttm"))


@query("r2_cagr_log", "quarters", f"WITH i AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY reportperiod) - 1 AS i FROM quarters WHERE revenue > 0) SELECT ticker, {q6('CASE WHEN count(*) >= 5 THEN regr_r2(ln(revenue), i) END')} AS r2, {q6('CASE WHEN count(*) >= 5 THEN exp(regr_slope(ln(revenue), i)) - 1 END')} AS growth FROM i GROUP BY ticker")
def r2_cagr_log(r):
    d = r.quarters.where("revenue > 0").withColumn("i", (F.row_number().over(Window.partitionBy("ticker").orderBy("reportperiod")) - 1).cast("double")).withColumn("y", F.log("revenue"))
    enough = F.count(F.lit(1)) >= 5
    return d.groupBy("ticker").agg(r6(F.when(enough, F.regr_r2("y", "i"))).alias("r2"), r6(F.when(enough, F.exp(F.regr_slope("y", "i")) - 1)).alias("growth"))


@query("check_vendor_agreement", "bars art vendor", f"WITH j AS (SELECT {q6('CASE WHEN f.netinccmn > 0 THEN CASE WHEN f.shareswa > 0 THEN b.closeadj * f.shareswa END / f.netinccmn END')} AS own, v.pe FROM bars b {_ASOF} JOIN vendor v ON b.ticker = v.ticker AND b.date = v.date), k AS (SELECT * FROM j WHERE own IS NOT NULL AND pe > 0) " + _report([_row("vendor", "correlation", f"SELECT {q6('corr(own, pe)')} FROM k", 0.95, None), _row("vendor", "median_ratio", f"SELECT {q6('median(own / pe)')} FROM k", 0.9, 1.1)]))
def check_vendor_agreement(r):
    """The P/E from the filings against the vendor's: correlation, and the median of their ratio (by counting, in no single task)."""
    d = FU.with_ratios(r.bars.select("ticker", "date", "closeadj"), r.art).select("ticker", "date", r6("pe").alias("own"))
    j = d.join(r.vendor.select("ticker", "date", "pe"), ["ticker", "date"]).where("own is not null and pe > 0").withColumn("ratio", F.try_divide("own", "pe"))
    v = j.agg(r6(F.corr("own", "pe")).alias("correlation")).crossJoin(F.broadcast(quantile_row(j, {"median_ratio": ("ratio", 0.5)}).select(r6("median_ratio").alias("median_ratio"))))
    return C.report(v, {"correlation": ("vendor", 0.95, None), "median_ratio": ("vendor", 0.9, 1.1)})


_PERIOD = "avg(CASE WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN value END)"
_A, _B = _PERIOD.format(a="1999-01-01", b="1999-12-31"), _PERIOD.format(a="1996-01-01", b="1996-12-31")


def _mean(a, b):
    return F.avg(F.when(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.col("value")))


@query("check_period_spike", "series", f"SELECT {q6(f'({_A}) / ({_B})')} AS ratio, ({_A}) > 2 * ({_B}) AS spike FROM series")
def check_period_spike(r):
    a, b = _mean("1999-01-01", "1999-12-31"), _mean("1996-01-01", "1996-12-31")
    return r.series.agg(r6(a / b).alias("ratio"), (a > 2 * b).alias("spike"))


_TIER = "CASE WHEN marketcap IS NULL THEN NULL WHEN marketcap < 1e6 THEN 1 WHEN marketcap < 3e6 THEN 2 WHEN marketcap < 6e6 THEN 3 WHEN marketcap < 1e7 THEN 4 WHEN marketcap < 2e7 THEN 5 ELSE 6 END"


@query("check_insider_by_tier", "bars insider vendor", f"WITH i AS ({INSIDER}), t AS (SELECT {_TIER} AS tier, avg(CASE WHEN insider_buys > 0 THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM i LEFT JOIN vendor v ON i.ticker = v.ticker AND i.date = v.date GROUP BY 1) SELECT tier, n, {q6('share')} AS buy_share, share > 0.01 AS active, count(tier) OVER () <= 6 AS few_tiers FROM t")
def check_insider_by_tier(r):
    """The share of rows with purchases by size tier, whether it is over 1 %, and whether there are no more than six tiers."""
    d = H.insider_features(r.bars.select("ticker", "date"), r.insider).join(r.vendor.select("ticker", "date", "marketcap"), ["ticker", "date"], "left")
    share = C.share(F.col("insider_buys") > 0)
    d = d.groupBy(size_tier("marketcap", (1e6, 3e6, 6e6, 1e7, 2e7)).alias("tier")).agg(F.count(F.lit(1)).alias("n"), r6(share).alias("buy_share"), (share > 0.01).alias("active"))
    few = d.agg((F.count("tier") <= 6).alias("few_tiers"))
    return d.crossJoin(F.broadcast(few))


@query("check_delisted_sequence", "bars instruments actions", f"WITH {CORE} SELECT r.ticker, removed, count(*) FILTER (c.date < removed) AS before, count(*) FILTER (c.date >= removed) AS after FROM removed r LEFT JOIN core c ON r.ticker = c.ticker GROUP BY ALL")
def check_delisted_sequence(r):
    gone = U.removals(U.terminal_events(U.clean_actions(r.actions)))
    core = U.core(r.bars, r.instruments, gone).select("ticker", "date")
    return gone.join(core, "ticker", "left").groupBy("ticker", "removed").agg(F.count_if(F.col("date") < F.col("removed")).alias("before"), F.count_if(F.col("date") >= F.col("removed")).alias("after"))


#: The contracts of the stages: the master has the universe's keys; the table of exchange rates is not there, the one of corrections need not be.
CONTRACTS = [
    CT.Contract("universe", {"ticker": "bigint", "date": "date", "in_universe": "boolean", "days_listed": "bigint", "sector": None, "famaindustry": None}, ("ticker", "date"), ("ticker", "date", "in_universe"), ("date", "1995-01-01", "2001-12-31")),
    CT.Contract("panel", {"ticker": "bigint", "date": "date", "closeadj": "double", "ret_12m": "double", "pcf": "double", "roic_level": "double"}, ("ticker", "date"), ("closeadj",), ("date", "1995-01-01", "2001-06-30"), ("universe", "in_universe")),
    CT.Contract("bars", {"ticker": "bigint", "date": "date", "high": "double", "low": "double", "volume": "double", "closeadj": "double", "open": "double"}, ("ticker", "date"), ("closeadj",)),
    CT.Contract("lines", {"ticker": None}, ("ticker", "date")),
    CT.Contract("exchange_rates", {"date": "date"}, ("date",), ("date",)),
    CT.Contract("corrections", {"ticker": "bigint"}, ("ticker",), optional=True, same_keys=("bars", None)),
]


def contract_results(r, names):
    """The rules of some contracts; the panel here is the universe joined to price and fundamental columns."""
    universe = U.daily_universe(r.bars, r.instruments, r.actions, r.vendor)
    panel_ = universe.join(PR.with_returns(r.bars).select("ticker", "date", "ret_12m"), ["ticker", "date"]).withColumns({"pcf": F.lit(None).cast("double"), "roic_level": F.lit(None).cast("double")}) if "panel" in names else None
    tables = {"universe": universe, "panel": panel_, "bars": r.bars, "lines": r.lines}
    return CT.check(r.spark, tables, [c for c in CONTRACTS if c.name in names])


def _columns_sql(c, have):
    """The rules on existence and columns, from the list of columns that a table is known to have."""
    out = [f"SELECT '{c.name}' AS contract, 'exists' AS rule, '{c.name}' AS subject, {float(have is not None)}::DOUBLE AS value, '{'PASS' if have is not None else 'UNKNOWN' if c.optional else 'FAIL'}' AS status"]
    return out + [f"SELECT '{c.name}', 'column', '{k}', {float(have is not None and k in have)}, '{'UNKNOWN' if have is None else 'PASS' if k in have else 'FAIL'}'" for k in c.columns]


def _rules_sql(c, table):
    """The rules on values, one query each; UNKNOWN for an absent table."""
    key = ", ".join(c.key)
    rules = [("rows", c.name, f"SELECT count(*) FROM {table}", f"v >= {c.least_rows}"), ("duplicates", ",".join(c.key), f"SELECT count(*) FROM (SELECT 1 FROM {table} GROUP BY {key} HAVING count(*) > 1)", "v = 0")]
    rules += [("nulls", x, f"SELECT count(*) FROM {table} WHERE {x} IS NULL", "v = 0") for x in c.required]
    if c.dates:
        day, a, b = c.dates
        rules.append(("dates", day, f"SELECT greatest(datediff('day', min({day}), DATE '{a}'), datediff('day', DATE '{b}', max({day})), 0) FROM {table}", "v = 0"))
    if c.same_keys:
        other = f"(SELECT {key} FROM {c.same_keys[0]}{f' WHERE {c.same_keys[1]}' if c.same_keys[1] else ''})"
        rules += [("keys", f"{c.name} - {c.same_keys[0]}", f"SELECT count(*) FROM (SELECT {key} FROM {table} EXCEPT FROM {other})", "v = 0"), ("keys", f"{c.same_keys[0]} - {c.name}", f"SELECT count(*) FROM (FROM {other} EXCEPT SELECT {key} FROM {table})", "v = 0")]
    if table is None:
        return [f"SELECT '{c.name}', '{rule}', '{subject}', NULL, 'UNKNOWN'" for rule, subject, _, _ in rules]
    return [f"SELECT '{c.name}', '{rule}', '{subject}', v::DOUBLE, CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END FROM (SELECT ({sql}) AS v)" for rule, subject, sql, ok in rules]


_HAVE = {"universe": {"ticker", "date", "in_universe", "days_listed", "sector", "famaindustry"}, "panel": {"ticker", "date", "closeadj", "ret_12m", "pcf", "roic_level"}, "bars": {"ticker", "date", "high", "low", "volume", "closeadj"}, "lines": {"ticker"}, "exchange_rates": None, "corrections": None}


def _contracts_sql(names):
    return " UNION ALL ".join(x for c in CONTRACTS if c.name in names for x in _columns_sql(c, _HAVE[c.name]) + _rules_sql(c, c.name if _HAVE[c.name] is not None else None))


@query("check_schema", "bars instruments actions vendor", _contracts_sql(("bars", "exchange_rates")))
def check_schema(r):
    """Columns and types of the bars, which lack one of their contract, and a table that is not there at all."""
    return contract_results(r, ("bars", "exchange_rates"))


@query("check_contract", "bars instruments actions vendor", f"WITH {CORE}, {UNIVERSE}, panel AS (SELECT * FROM universe) {_contracts_sql([c.name for c in CONTRACTS])}")
def check_contract(r):
    """All contracts: existence, columns, rows, keys, nulls, date ranges, and the panel's keys against the universe's."""
    return contract_results(r, [c.name for c in CONTRACTS])


_ART = "(SELECT * FROM art QUALIFY row_number() OVER (PARTITION BY ticker, datekey ORDER BY reportperiod DESC) = 1)"


@query("check_rederive", "bars art spans", f"""WITH pf AS MATERIALIZED (SELECT ticker, date, {q6('closeadj / nullif(lag(closeadj, 252) OVER (PARTITION BY ticker ORDER BY date), 0) - 1')} AS ret_12m FROM bars),
k AS MATERIALIZED (SELECT ticker, date, closeadj, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM bars),
pit AS MATERIALIZED (SELECT b.ticker, b.date, {q6('CASE WHEN f.netinccmn > 0 THEN CASE WHEN f.shareswa > 0 THEN b.closeadj * f.shareswa END / f.netinccmn END')} AS pe FROM bars b {_ASOF}),
own AS MATERIALIZED (SELECT b.ticker, b.date, CASE WHEN f.shareswa > 0 THEN b.closeadj * f.shareswa END / nullif(f.netinccmn, 0) AS pe FROM bars b ASOF LEFT JOIN {_ART} f ON b.ticker = f.ticker AND b.date >= f.datekey)
SELECT a.ticker, a.date, abs(p.ret_12m - (a.closeadj / nullif(b.closeadj, 0) - 1)) <= 0.000002 AS ret_agrees, abs(t.pe - o.pe) <= 0.05 * abs(t.pe) + 0.000002 AS pe_agrees
FROM k a JOIN pf p ON p.ticker = a.ticker AND p.date = a.date JOIN pit t ON t.ticker = a.ticker AND t.date = a.date JOIN own o ON o.ticker = a.ticker AND o.date = a.date LEFT JOIN k b ON a.ticker = b.ticker AND a.k = b.k + 252""")
def check_rederive(r):
    """The 12-month return and the P/E of every row, worked out a second way: by row numbers, and by the days for which a filing is the latest."""
    k = r.bars.withColumn("k", F.row_number().over(PR.W())).select("ticker", "date", "closeadj", "k")
    old = k.select("ticker", (F.col("k") + 252).alias("k"), F.col("closeadj").alias("before"))
    until = F.lead("datekey").over(Window.partitionBy("ticker").orderBy("datekey"))
    f = r.art.groupBy("ticker", "datekey").agg(F.max_by(F.struct("shareswa", "netinccmn"), "reportperiod").alias("x"))
    f = f.withColumn("until", until).join(r.spans.select("ticker", "lastpricedate"), "ticker")
    f = f.select("ticker", "datekey", F.coalesce(F.date_sub("until", 1), "lastpricedate").alias("last"), "x.*")
    known = interval_join(r.bars.select("ticker", "date", "closeadj"), f, "ticker", "date", "datekey", "last", 90)
    pe = F.try_divide(F.when(F.col("shareswa") > 0, F.col("closeadj") * F.col("shareswa")), "netinccmn")
    own = known.select("ticker", "date", pe.alias("own_pe"))
    p = PR.with_returns(r.bars).select("ticker", "date", r6("ret_12m").alias("ret_12m"))
    pit = FU.with_ratios(r.bars.select("ticker", "date", "closeadj"), r.art).select("ticker", "date", r6("pe").alias("pe"))
    d = k.join(old, ["ticker", "k"], "left").join(p, ["ticker", "date"]).join(pit, ["ticker", "date"]).join(own, ["ticker", "date"], "left")
    return d.select("ticker", "date", (F.abs(F.col("ret_12m") - (F.try_divide("closeadj", "before") - 1)) <= 0.000002).alias("ret_agrees"), (F.abs(F.col("pe") - F.col("own_pe")) <= 0.05 * F.abs("pe") + 0.000002).alias("pe_agrees"))


@query("check_expected_values", "instruments", "SELECT e.ticker, i.exchange = e.exchange AS ok FROM (VALUES (8, 'NASDAQ'), (9, 'NYSEMKT'), (7, 'NYSE')) AS e(ticker, exchange) JOIN instruments i ON i.ticker = e.ticker")
def check_expected_values(r):
    e = F.array(*[F.struct(F.lit(t).cast("long").alias("ticker"), F.lit(x).alias("expected")) for t, x in ((8, "NASDAQ"), (9, "NYSEMKT"), (7, "NYSE"))])
    want = r.spark.range(1).select(F.explode(e).alias("x")).select("x.*")
    return r.instruments.join(want, "ticker").select("ticker", (F.col("exchange") == F.col("expected")).alias("ok"))


@query("check_labels", "bars instruments actions", f"""WITH {CORE}{LABELS}, f AS (SELECT ticker, count(*) FILTER (fwd_delisted_21td) AS flagged_21, count(*) FILTER (fwd_delisted_63td) AS flagged_63 FROM labels GROUP BY ticker),
e AS (SELECT ticker, bool_or(reason <> 'mergerfrom' AND date = last_date) AS ended FROM terminal JOIN (SELECT ticker, max(date) AS last_date FROM bars GROUP BY ticker) USING (ticker) GROUP BY ticker), u AS (SELECT c.ticker, count(*) FILTER (c.date >= removed) AS after FROM core c JOIN removed USING (ticker) GROUP BY c.ticker)
SELECT f.*, coalesce(ended, false) AS ended, coalesce(after, 0) AS universe_after, CASE WHEN coalesce(after, 0) > 0 THEN 'FAIL' WHEN coalesce(ended, false) THEN CASE WHEN flagged_21 > 0 AND flagged_63 > 0 THEN 'PASS' ELSE 'FAIL' END WHEN flagged_21 = 0 AND flagged_63 = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM f LEFT JOIN e USING (ticker) LEFT JOIN u USING (ticker)""")
def check_labels(r):
    """Entities that ended on their last bar carry the flags before it, others never do, and none is in the universe from its removal on."""
    t = U.terminal_events(U.clean_actions(r.actions))
    flags = U.forward_labels(r.bars, t, (21, 63)).groupBy("ticker").agg(*[F.count_if(f"fwd_delisted_{n}td").alias(f"flagged_{n}") for n in (21, 63)])
    last = r.bars.groupBy("ticker").agg(F.max("date").alias("last_date"))
    ended = t.join(last, "ticker").groupBy("ticker").agg(F.bool_or((F.col("reason") != "mergerfrom") & (F.col("date") == F.col("last_date"))).alias("ended"))
    gone = U.removals(t)
    after = U.core(r.bars, r.instruments, gone).join(gone, "ticker").groupBy("ticker").agg(F.count_if(F.col("date") >= F.col("removed")).alias("universe_after"))
    d = flags.join(ended, "ticker", "left").join(after, "ticker", "left").withColumns({"ended": F.coalesce("ended", F.lit(False)), "universe_after": F.coalesce("universe_after", F.lit(0).cast("long"))})
    both, none = (F.col("flagged_21") > 0) & (F.col("flagged_63") > 0), (F.col("flagged_21") == 0) & (F.col("flagged_63") == 0)
    fine = (F.col("universe_after") == 0) & F.when(F.col("ended"), both).otherwise(none)
    return d.withColumn("status", F.when(fine, "PASS").otherwise("FAIL"))


@query("check_median_order", "bars", "SELECT (SELECT median(closeadj) FROM bars WHERE ticker = 1) > (SELECT median(closeadj) FROM bars WHERE ticker = 2) AS first_higher")
def check_median_order(r):
    one = lambda t: F.median(F.when(F.col("ticker") == t, F.col("closeadj")))
    return r.bars.where(F.col("ticker").isin(1, 2)).agg((one(1) > one(2)).alias("first_higher"))


@query("check_peer_centring", "bars instruments vendor", f"WITH {_P}, m AS (SELECT date, sector, median(pe) AS pm FROM p GROUP BY date, sector HAVING count(*) >= 5), x AS MATERIALIZED (SELECT pe / pm AS ratio FROM p JOIN m ON p.date = m.date AND p.sector = m.sector WHERE pm > 0) " + _report([_row("peers", "median_ratio", f"SELECT {q6('median(ratio)')} FROM x", 0.8, 1.2), _row("peers", "mean_ratio", f"SELECT {q6('avg(ratio)')} FROM x", 0.5, 2)]))
def check_peer_centring(r):
    """Ratios to the peers' median lie around 1: their median and mean."""
    d = panel(r)
    d = d.join(medians(d, ["date", "sector"], ["pe"]).where("pe_median > 0"), ["date", "sector"]).select((F.col("pe") / F.col("pe_median")).alias("ratio"))
    v = d.agg(r6(F.avg("ratio")).alias("mean_ratio")).crossJoin(F.broadcast(quantile_row(d, {"median_ratio": ("ratio", 0.5)}).select(r6("median_ratio").alias("median_ratio"))))
    return C.report(v, {"median_ratio": ("peers", 0.8, 1.2), "mean_ratio": ("peers", 0.5, 2)})


# --- holding periods: from one calendar month end, traded on or not, to the next

_HOLD = f"""{_P}, h AS (SELECT a.ticker, a.bucket, a.sector, last_day(a.date) AS day, last_day(CAST(a.date + INTERVAL 1 MONTH AS DATE)) AS until FROM a),
x AS (SELECT h.*, e.closeadj AS entry, q.closeadj AS exit FROM h ASOF JOIN bars e ON e.ticker = h.ticker AND h.day <= e.date ASOF JOIN bars q ON q.ticker = h.ticker AND h.until >= q.date),
hr AS (SELECT ticker, day, until, bucket, sector, entry, exit, {q6('0.02 * (exit / nullif(entry, 0) - 1)')} AS ret FROM x)"""


def holding(r):
    """Assignments held from the end of their month to the end of the next, in calendar days; returns damped like the others here."""
    d = assigned(r).select("ticker", "bucket", "sector", F.last_day("date").alias("day"), F.last_day(F.add_months("date", 1)).alias("until"))
    return HD.returns(written(d), r.bars).withColumns({"bucket": F.col("bucket").cast("long"), "ret": r6(0.02 * F.col("ret"))})


@query("holding_period_returns", ROLES, f"WITH {_HOLD} SELECT ticker, day, entry, exit, ret FROM hr")
def holding_period_returns(r):
    return holding(r).select("ticker", "day", "entry", "exit", "ret")


_STD = "stddev_samp(ret) * sqrt(12)"
_HOLD_STATS = {
    "mean": "avg(ret)", "ann_return": "pow(1 + avg(ret), 12) - 1", "ann_std": _STD, "sharpe": f"CASE WHEN {_STD} > 0 THEN (pow(1 + avg(ret), 12) - 1) / ({_STD}) ELSE 0 END", "win_rate": "avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END)",
    "median": "median(ret)", "p05": "quantile_cont(ret, 0.05)", "p95": "quantile_cont(ret, 0.95)",
}


@query("holding_bucket_stats", ROLES, f"WITH {_HOLD} SELECT bucket, count(ret) AS n, {', '.join(f'{q6(e)} AS {k}' for k, e in _HOLD_STATS.items())} FROM hr GROUP BY bucket")
def holding_bucket_stats(r):
    return HD.statistics(holding(r), ["bucket"], 12).withColumns({k: r6(k) for k in _HOLD_STATS})


@query("bucket_t_stat", ROLES, f"WITH {_HOLD}, g AS (SELECT bucket, count(ret) AS n, avg(ret) AS m, var_samp(ret) AS v FROM hr WHERE bucket IN (1, {N}) GROUP BY bucket) SELECT {q6('(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n))')} AS t FROM g a, g b WHERE a.bucket = 1 AND b.bucket = {N}")
def bucket_t_stat(r):
    x = lambda k: F.when(F.col("bucket") == k, F.col("ret"))
    g = holding(r).agg(*[f(x(k)).alias(f"{n}{k}") for k in (1, N) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n, k = F.col("n1"), F.col(f"n{N}")
    pooled = ((n - 1) * F.col("v1") + (k - 1) * F.col(f"v{N}")) / (n + k - 2)
    return g.select(r6((F.col("m1") - F.col(f"m{N}")) / F.sqrt(pooled * (1 / n + 1 / k))).alias("t"))


@query("holding_cumulative", ROLES, f"WITH {_HOLD}, m AS (SELECT day, bucket, {q6('avg(ret)')} AS ret FROM hr GROUP BY day, bucket) SELECT day, bucket, {q6('product(1 + ret) OVER (PARTITION BY bucket ORDER BY day) - 1')} AS total FROM m WHERE ret IS NOT NULL")
def holding_cumulative(r):
    m = holding(r).groupBy("day", "bucket").agg(r6(F.avg("ret")).alias("ret")).where("ret is not null")
    return m.select("day", "bucket", r6(F.product(1 + F.col("ret")).over(Window.partitionBy("bucket").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("total"))


_STATES_ROLES = f"{ROLES} series rates benchmark_bars"


@query("market_state_labels", "bars series rates benchmark_bars", f"{STATES} SELECT * FROM labelled")
def market_state_labels(r):
    """Every trading day with a label of each family of rules: fall of the market, volatility, yield curve, credit spread."""
    return states(r)


@query("stats_by_label", _STATES_ROLES, f"""{STATES}, {_HOLD}, k AS (SELECT hr.bucket, hr.ret, f.family, l.label FROM hr CROSS JOIN (SELECT DISTINCT family FROM labelled) f ASOF LEFT JOIN labelled l ON l.family = f.family AND hr.day >= l.date)
SELECT bucket, family, label, count(ret) AS n, {q6('avg(ret)')} AS mean, {q6('stddev_samp(ret)')} AS std, {q6('avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END)')} AS win_rate FROM k GROUP BY ALL""")
def stats_by_label(r):
    """Holding returns by bucket and state of the market on the day they began."""
    d = written(holding(r).select("bucket", "day", "ret"))
    d = SL.with_labels(d, written(states(r)), "day").groupBy("bucket", "family", "label")
    return d.agg(F.count("ret").alias("n"), r6(F.avg("ret")).alias("mean"), r6(F.stddev_samp("ret")).alias("std"), r6(F.avg((F.col("ret") > 0).cast("double"))).alias("win_rate"))
