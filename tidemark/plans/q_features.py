"""Queries: fundamentals, macro series, holdings and peers."""

from pyspark.sql import functions as F

from ..functions.columns import q6, r6
from ..operators import fundamentals as FU
from ..operators import holdings as H
from ..operators import peers as P
from ..operators import prices as PR
from ..operators import quality as Q
from ..operators import series as S
from ..operators.asof import Facts, asof_join, asof_joins
from ..registry import query
from .q_quality import METRICS, SPINE, YEARS, metrics

GRID = ["ticker", "date", "closeadj"]


@query("latest_version", "arq", "SELECT * FROM arq QUALIFY row_number() OVER (PARTITION BY ticker, reportperiod ORDER BY datekey DESC) = 1")
def latest_version(r):
    return FU.latest_versions(r.arq)


_ASOF = "ASOF LEFT JOIN (SELECT * FROM art QUALIFY row_number() OVER (PARTITION BY ticker, datekey ORDER BY reportperiod DESC) = 1) f ON b.ticker = f.ticker AND b.date >= f.datekey"


@query("asof_filing", "bars art", f"SELECT b.ticker, b.date, f.datekey, f.reportperiod, f.ncfo FROM bars b {_ASOF}")
def asof_filing(r):
    return asof_join(r.bars.select("ticker", "date"), r.art.withColumn("known", F.col("datekey")), "ticker", "date", "known", ["datekey", "reportperiod", "ncfo"], tie=["reportperiod"])


_PREV = "ASOF LEFT JOIN art p ON b.ticker = p.ticker AND CAST(b.date - INTERVAL 1 YEAR AS DATE) >= p.datekey"


@query("asof_prior_year", "bars art", f"SELECT b.ticker, b.date, p.datekey AS prev_datekey, p.epsdil AS prev_epsdil FROM bars b {_PREV}")
def asof_prior_year(r):
    d = FU.with_latest(r.bars.select("ticker", "date"), r.art, "prev_", ["epsdil"], shift=F.expr("cast(date - interval 1 year as date)"))
    return d.select("ticker", "date", "prev_datekey", "prev_epsdil")


_SINCE = "datediff('day', {0}, b.date)"
_LATER = "greatest(f.datekey, q.vintage)"
STALE_SQL = f"""{_LATER} AS datekey, {_SINCE.format(_LATER)} AS days_since_filing, {q6(_SINCE.format(_LATER) + ' / 91.0')} AS quarters_stale, {_SINCE.format('f.datekey')} AS days_since_art, {_SINCE.format('q.vintage')} AS days_since_arq,
CASE WHEN f.datekey IS NOT NULL OR q.vintage IS NOT NULL THEN greatest(coalesce({_SINCE.format('f.datekey')}, 0), coalesce({_SINCE.format('q.vintage')}, 0)) END AS days_since_filing_max"""
_SPINE_ASOF = "ASOF LEFT JOIN spine q ON b.ticker = q.ticker AND b.date >= q.vintage"


@query("staleness", "bars art arq ary", f"WITH {SPINE} SELECT b.ticker, b.date, {STALE_SQL} FROM bars b {_ASOF} {_SPINE_ASOF}")
def staleness(r):
    """The ages of the trailing-year filing and of the last vintage; entities without annual filings, and days before the first, have one or none."""
    facts = [Facts(FU.known_filings(r.art, "art_", []), "_at", ["art_datekey"], ["_period"]), Facts(Q.vintages(r.arq, r.ary).withColumn("arq_datekey", F.col("vintage")), "vintage", ["arq_datekey"])]
    d = FU.staleness(asof_joins(r.bars.select("ticker", "date"), "ticker", "date", facts))
    return d.select("ticker", "date", *FU.STALENESS).withColumn("quarters_stale", r6("quarters_stale"))


_POS = "CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) END"


def pos(a, b):
    return _POS.format(a=a, b=b)


def nonzero(a, b):
    return f"({a}) / nullif({b}, 0)"


_CAP, _SALES, _FREE = "CASE WHEN f.shareswa > 0 THEN b.closeadj * f.shareswa END", "coalesce(f.revenueusd, f.revenue)", "(f.ncfo + f.capex)"
_RATIO_SQL = {
    "fcf_conversion": f"{_FREE} / nullif(f.netinccmn, 0)", "accrual": "(f.netinccmn - f.ncfo) / nullif(f.assets, 0)", "sbc_pct": pos("f.sbcomp", _SALES), "capex_intensity": nonzero("abs(f.capex)", _SALES), "fcf_recon_ttm": _FREE,
    "pcf": pos(_CAP, "f.ncfo"), "pfcf": f"({_CAP}) / nullif({_FREE}, 0)", "ncfo_to_revenue": nonzero("f.ncfo", _SALES), "fcf_to_revenue": nonzero(_FREE, _SALES), "pe": pos(_CAP, "f.netinccmn"), "pb": pos(_CAP, "f.equity"), "ps": nonzero(_CAP, _SALES),
    "evebitda": pos(f"({_CAP}) + coalesce(f.debt, 0) - coalesce(f.cashnequsd, 0)", "f.ebitda"), "dividend_yield": "coalesce(f.divyield, f.dps / nullif(b.closeadj, 0))", "roe": "coalesce(f.roe, f.netinccmn / nullif(f.equity, 0))", "pretax_margin": nonzero("f.ebt", _SALES),
    "current_ratio": "f.currentratio", "debt_to_equity": "f.debt / nullif(f.equity, 0)", "liabilities_to_assets": "f.liabilities / nullif(f.assets, 0)", "payout": "f.dps / nullif(f.epsdil, 0)", "eps_growth": "(f.epsdil - p.epsdil) / nullif(p.epsdil, 0)",
}
RATIO_COLUMNS = ", ".join(f"{q6(_RATIO_SQL[k])} AS {k}" for k in FU.RATIOS)


@query("valuation_ratios", "bars art", f"SELECT b.ticker, b.date, {RATIO_COLUMNS} FROM bars b {_ASOF} {_PREV}")
def valuation_ratios(r):
    d = FU.with_latest(r.bars.select(*GRID), r.art, "art_", FU.FILED)
    d = FU.ratios(FU.with_latest(d, r.art, "prev_", ["epsdil"], shift=F.expr("cast(date - interval 1 year as date)")))
    return d.select("ticker", "date", *[r6(k).alias(k) for k in FU.RATIOS])


PIT = f"""{YEARS}, qm AS MATERIALIZED ({METRICS}), pit AS MATERIALIZED (SELECT b.ticker, b.date, f.datekey AS art_datekey, q.vintage AS arq_datekey, {STALE_SQL}, {', '.join(f'q.{m}' for m in Q.METRICS)}, {RATIO_COLUMNS}
FROM bars b {_ASOF} {_PREV} ASOF LEFT JOIN qm q ON b.ticker = q.ticker AND b.date >= q.vintage)"""
PIT_COLUMNS = ("art_datekey", "arq_datekey", *FU.STALENESS, *Q.METRICS, *FU.RATIOS)


def pit(r):
    quality = metrics(r)
    d = FU.fundamental_pit(r.bars.select(*GRID), r.art, quality)
    return d.select("ticker", "date", *[c if c.endswith("datekey") or c.startswith("days") else r6(c).alias(c) for c in PIT_COLUMNS])


@query("fundamental_pit", "bars art arq ary", f"WITH {PIT} SELECT * FROM pit")
def fundamental_pit(r):
    return pit(r)


# --- series


@query("series_clean", "series", "SELECT date, value FROM series WHERE value > 17")
def series_clean(r):
    text = r.series.select(F.col("date").cast("string").alias("date"), F.when(F.col("value") > 17, F.col("value").cast("string")).otherwise(".").alias("value"), F.lit(1).alias("at"))
    again = text.withColumns({"at": F.lit(0), "value": F.lit("0.5")}).where(F.col("date") > "1999-01-01").join(text.where("value <> '.'").select("date"), "date", "left_semi").select("date", "value", "at")
    return S.clean(text.unionByName(again))


@query("series_resample_bday", "series", "SELECT d.date, s.value FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM series), (SELECT max(date) FROM series), INTERVAL 1 DAY)) AS DATE) AS date) d ASOF LEFT JOIN series s ON d.date >= s.date WHERE isodow(d.date) < 6")
def series_resample_bday(r):
    return S.business_days(r.series.withColumn("series", F.lit("price"))).select("date", "value")


_VINTAGE = """v AS (SELECT vintage_date, observation_date, max(value) AS value FROM vintages GROUP BY ALL), d AS (SELECT DISTINCT date FROM bars),
known AS (SELECT d.date, (SELECT max(vintage_date) FROM v WHERE vintage_date <= d.date) AS vintage FROM d)"""


@query("macro_vintage_asof", "bars vintages", f"WITH {_VINTAGE} SELECT k.date, k.vintage, v.observation_date AS observed, v.value FROM known k ASOF LEFT JOIN v ON k.vintage = v.vintage_date AND k.date >= v.observation_date")
def macro_vintage_asof(r):
    return S.vintage_asof(r.bars.select("date").distinct(), r.vintages)


@query("macro_ffill", "bars series", "SELECT d.date, s.value FROM (SELECT DISTINCT date FROM bars) d ASOF LEFT JOIN series s ON d.date >= s.date")
def macro_ffill(r):
    return S.carried(r.bars.select("date").distinct().withColumn("series", F.lit("vix")), r.series.withColumn("series", F.lit("vix"))).select("date", "value")


@query("macro_change", "series", f"SELECT date, {q6('value - lag(value, 20) OVER (ORDER BY date)')} AS change_20 FROM series")
def macro_change(r):
    return S.with_change(r.series.withColumn("series", F.lit("vix")), 20, "c").select("date", r6("c").alias("change_20"))


@query("macro_yoy_real_rate", "series", f"SELECT date, {q6('(value - lag(value, 252) OVER (ORDER BY date)) / nullif(lag(value, 252) OVER (ORDER BY date), 0) * 100')} AS cpi_yoy, {q6('value - (value - lag(value, 252) OVER (ORDER BY date)) / nullif(lag(value, 252) OVER (ORDER BY date), 0) * 100')} AS real_rate FROM series")
def macro_yoy_real_rate(r):
    d = S.with_growth(r.series.withColumn("series", F.lit("cpi")), 252, "g")
    return d.select("date", r6("g").alias("cpi_yoy"), r6(S.real_rate("value", "g")).alias("real_rate"))


_BT = ", ".join(f"{q6(f'closeadj / nullif(lag(closeadj, {n}) OVER (ORDER BY date), 0) - 1')} AS ret_{k}" for k, n in (("1m", 21), ("3m", 63), ("6m", 126), ("12m", 252)))


@query("benchmark_trend", "benchmark_bars", f"SELECT date, CASE WHEN closeadj > avg(closeadj) OVER (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) THEN 1.0 ELSE 0.0 END::DOUBLE AS above_ma200, {_BT} FROM benchmark_bars")
def benchmark_trend(r):
    d = S.benchmark_trend(r.benchmark_bars.withColumn("ticker", F.lit("market")))
    return d.select("date", "above_ma200", *[r6(f"ret_{k}").alias(f"ret_{k}") for k in ("1m", "3m", "6m", "12m")])


# --- holdings

_TRADES = "SELECT ticker, filingdate, transactioncode = 'P' AS buy, CASE transactioncode WHEN 'P' THEN abs(transactionshares) ELSE -abs(transactionshares) END AS shares, upper(trim(isofficer)) IN ('Y', '1', 'TRUE') AS officer, sharesownedbeforetransaction AS owned FROM insider WHERE transactioncode IN ('P', 'S') AND abs(transactionshares) > 0"


@query("insider_clean", "insider", _TRADES)
def insider_clean(r):
    return H.clean_trades(r.insider)


INSIDER = f"""SELECT b.ticker, b.date, count(*) FILTER (buy) AS insider_buys, count(*) FILTER (NOT buy) AS insider_sells, sum(shares) AS insider_net_shares,
{q6('CASE WHEN avg(owned) > 0 THEN sum(shares) / avg(owned) END')} AS insider_net_ratio, coalesce(sum(shares) FILTER (buy AND officer), 0)::DOUBLE AS officer_buy_shares
FROM bars b LEFT JOIN ({_TRADES}) t ON b.ticker = t.ticker AND t.filingdate BETWEEN b.date - 90 AND b.date GROUP BY b.ticker, b.date"""


@query("insider_features", "bars insider", INSIDER)
def insider_features(r):
    d = H.insider_features(r.bars.select("ticker", "date"), r.insider)
    return d.withColumn("insider_net_ratio", r6("insider_net_ratio"))


@query("insider_trailing_90d", "bars insider", f"SELECT ticker, date, insider_buys, insider_sells, insider_net_shares FROM ({INSIDER})")
def insider_trailing_90d(r):
    return H.insider_features(r.bars.select("ticker", "date"), r.insider).select("ticker", "date", "insider_buys", "insider_sells", "insider_net_shares")


_PUT = "CASE WHEN cllunits > 0 AND putunits / cllunits <= 100 THEN putunits / cllunits END"


@query("put_call_ratio", "holdings", f"SELECT ticker, calendardate, {q6(_PUT)} AS put_call_ratio FROM holdings")
def put_call_ratio(r):
    return H.put_call(r.holdings).select("ticker", "calendardate", r6("put_call_ratio").alias("put_call_ratio"))


_QOQ = ", ".join(f"{q6(f'{c} - lag({c}) OVER (PARTITION BY ticker ORDER BY calendardate)')} AS {c}_qoq" for c in ("shrholders", "shrunits", "shrvalue"))


@query("inst_qoq", "holdings", f"SELECT ticker, calendardate, {_QOQ} FROM holdings")
def inst_qoq(r):
    return H.quarter_changes(r.holdings).select("ticker", "calendardate", *[r6(f"{c}_qoq").alias(f"{c}_qoq") for c in ("shrholders", "shrunits", "shrvalue")])


_INST = f"ASOF LEFT JOIN (SELECT *, CAST(calendardate + 45 AS DATE) AS pit_date, {_QOQ}, {q6(_PUT)} AS put_call_ratio FROM holdings) h ON b.ticker = h.ticker AND b.date >= h.pit_date"


@query("inst_asof_45d", "bars holdings", f"SELECT b.ticker, b.date, h.calendardate, h.shrunits FROM bars b {_INST}")
def inst_asof_45d(r):
    return H.institutional_features(r.bars.select("ticker", "date"), r.holdings).select("ticker", "date", "calendardate", "shrunits")


@query("inst_features", "bars holdings", f"SELECT b.ticker, b.date, h.calendardate, shrholders, shrunits, shrvalue, shrholders_qoq, shrunits_qoq, shrvalue_qoq, put_call_ratio FROM bars b {_INST}")
def inst_features(r):
    d = H.institutional_features(r.bars.select("ticker", "date"), r.holdings)
    return d.withColumns({c: r6(c) for c in ("shrholders_qoq", "shrunits_qoq", "shrvalue_qoq", "put_call_ratio")})


# --- peers

PANEL = f"""panel AS (SELECT b.ticker, b.date, i.sector, v.pe, v.marketcap, {q6('b.closeadj / nullif(lag(b.closeadj, 21) OVER (PARTITION BY b.ticker ORDER BY b.date), 0) - 1')} AS ret_1m
FROM bars b JOIN instruments i ON b.ticker = i.ticker LEFT JOIN vendor v ON b.ticker = v.ticker AND b.date = v.date)"""


def panel(r):
    d = PR.with_returns(r.bars).withColumn("ret_1m", r6("ret_1m")).select("ticker", "date", "ret_1m")
    return d.join(r.instruments.select("ticker", "sector"), "ticker").join(r.vendor.select("ticker", "date", "pe", "marketcap"), ["ticker", "date"], "left")


@query("peer_medians", "bars instruments vendor", f"WITH {PANEL} SELECT date, sector, count(*) AS peers, {q6('median(pe)')} AS pe_median, {q6('median(ret_1m)')} AS ret_1m_median FROM panel GROUP BY date, sector HAVING count(*) >= 5")
def peer_medians(r):
    return P.medians(panel(r), ["date", "sector"], ["pe", "ret_1m"]).withColumns({c: r6(c) for c in ("pe_median", "ret_1m_median")})


_PR = "percent_rank() OVER (PARTITION BY date, sector ORDER BY pe ASC NULLS LAST)"


@query("peer_percent_rank", "bars instruments vendor", f"WITH {PANEL} SELECT ticker, date, {q6(_PR)} AS pe_peer_rank FROM panel")
def peer_percent_rank(r):
    return P.with_percent_rank(panel(r), ["date", "sector"], "pe", "x").select("ticker", "date", r6("x").alias("pe_peer_rank"))


@query("peer_avg_rank", "bars instruments vendor", f"WITH {PANEL} SELECT ticker, date, {q6('CASE WHEN pe IS NOT NULL THEN (rank() OVER (PARTITION BY date, sector ORDER BY pe ASC NULLS LAST) + (count(*) OVER (PARTITION BY date, sector, pe) - 1) / 2.0) / count(pe) OVER (PARTITION BY date, sector) END')} AS pe_rank FROM panel")
def peer_avg_rank(r):
    return P.with_average_rank(panel(r), ["date", "sector"], "pe", "x").select("ticker", "date", r6("x").alias("pe_rank"))
