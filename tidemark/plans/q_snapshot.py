"""Queries: the current snapshot and its parts, and the screens."""

from pyspark.sql import functions as F

from ..functions.columns import q6, r6
from ..operators import prices as PR
from ..operators import snapshot as SN
from ..operators import strategies as ST
from ..operators import universe as U
from ..registry import query
from . import q_strategies as QS
from .q_features import _ASOF, _SALES, PIT, PIT_COLUMNS, nonzero, pit
from .q_panel import MACRO, MACRO_ROLES, macro, price
from .q_prices import PRICE_SQL
from .q_quality import _QT, _ROIC, cagr_sql, log_sql

_CAP = "b.closeadj * f.shareswa"
_VALUE = {
    "pcf": nonzero(_CAP, "f.ncfo"), "roe": "coalesce(f.roe, f.netinccmn / nullif(f.equity, 0))", "current_ratio": "f.currentratio", "pe": nonzero(_CAP, "f.netinccmn"), "pb": nonzero(_CAP, "f.equity"), "ps": nonzero(_CAP, _SALES),
    "evebitda": nonzero(f"{_CAP} + coalesce(f.debt, 0) - coalesce(f.cashnequsd, 0)", "f.ebitda"), "dividend_yield": "coalesce(f.divyield, f.dps / nullif(b.closeadj, 0))", "pretax_margin": nonzero("f.ebt", _SALES), "debt_to_equity": nonzero("f.debt", "f.equity"),
    "liabilities_to_assets": nonzero("f.liabilities", "f.assets"), "payout": nonzero("f.dps", "f.epsdil"), "eps_growth": nonzero("f.epsdil - p.epsdil", "p.epsdil"), "capex_intensity": nonzero("abs(f.capex)", _SALES), "accrual": nonzero("f.netinccmn - f.ncfo", "f.assets"),
}
LISTED = "listed AS (SELECT DISTINCT ticker, sector, famaindustry FROM instruments WHERE upper(coalesce(isdelisted, 'N')) = 'N')"
VALUE = f"""b AS (SELECT ticker, (SELECT max(date) FROM bars) AS date, arg_max(closeadj, date) AS closeadj FROM bars WHERE ticker IN (SELECT ticker FROM listed) GROUP BY ticker),
value AS MATERIALIZED (SELECT b.ticker, {", ".join(f"{q6(_VALUE[k])} AS {k}" for k in SN.VALUATION)} FROM b {_ASOF} ASOF LEFT JOIN art p ON b.ticker = p.ticker AND CAST(b.date - INTERVAL 1 YEAR AS DATE) >= p.datekey)"""


def listed(r):
    return U.listed(r.instruments).select("ticker", "sector", "famaindustry").distinct()


def last_prices(r, entities):
    """The last price of each entity, as of the last date that any has; the date is one row."""
    day = r.bars.agg(F.max("date").alias("date"))
    return r.bars.join(entities.select("ticker"), "ticker", "left_semi").groupBy("ticker").agg(F.max_by("closeadj", "date").alias("closeadj")).crossJoin(F.broadcast(day)).select("ticker", "date", "closeadj")


def valuation(r, entities):
    d = SN.valuation(last_prices(r, entities), r.art)
    return d.select("ticker", *[r6(c).alias(c) for c in SN.VALUATION])


@query("valuation_current", "bars art instruments", f"WITH {LISTED}, {VALUE} SELECT * FROM value")
def valuation_current(r):
    return valuation(r, listed(r))


_LAST = "(SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY ticker, reportperiod ORDER BY datekey DESC) = 1)"
CURRENT = f"""years AS (SELECT ticker, DATE '9999-12-31' AS vintage, year(reportperiod) AS fy, ncfo, coalesce(ncfo, 0) + coalesce(capex, 0) AS fcf, roic, sharesbas AS shares FROM {_LAST.format('ary')}), kq AS (SELECT *, DATE '9999-12-31' AS vintage FROM {_LAST.format('arq')}),
quality AS MATERIALIZED (SELECT n5.ticker, {q6('n5.r2')} AS ncfo_r2_5y, {q6('g1.g')} AS ncfo_cagr_5y, {q6('n10.r2')} AS ncfo_r2_10y, {q6('g2.g')} AS ncfo_cagr_10y, {q6('n10.up')} AS ncfo_pct_positive, {q6('q.g')} AS grossmargin_slope, {q6('o.roic')} AS roic_level,
  {q6('f5.r2')} AS fcf_r2_5y, {q6('f10.r2')} AS fcf_r2_10y, {q6('g3.g')} AS fcf_cagr_5y, {q6('g4.g')} AS fcf_cagr_10y FROM {log_sql('ncfo', 5)} n5 JOIN {log_sql('ncfo', 10)} n10 USING (ticker) JOIN {log_sql('fcf', 5)} f5 USING (ticker) JOIN {log_sql('fcf', 10)} f10 USING (ticker)
  {" ".join(f"JOIN {cagr_sql(c, n)} g{k} USING (ticker)" for k, (c, n) in enumerate((("ncfo", 5), ("ncfo", 10), ("fcf", 5), ("fcf", 10)), 1))} JOIN {_ROIC} o USING (ticker) LEFT JOIN {_QT} q USING (ticker))"""


def quality(r):
    return SN.quality(r.arq, r.ary).select("ticker", *[r6(c).alias(c) for c in SN.QUALITY])


@query("quality_current", "arq ary", f"WITH {CURRENT} SELECT * FROM quality")
def quality_current(r):
    """Restated quality: what the last versions of all years and quarters say."""
    return quality(r)


@query("macro_current", MACRO_ROLES, f"WITH {MACRO} SELECT * FROM macro ORDER BY date DESC LIMIT 1")
def macro_current(r):
    """The last date's row of the macro table."""
    return macro(r).orderBy(F.desc("date")).limit(1)


_RANK = "CASE WHEN ret_3m IS NOT NULL THEN (rank() OVER (PARTITION BY sector ORDER BY ret_3m ASC NULLS LAST) + (count(*) OVER (PARTITION BY sector, ret_3m) - 1) / 2.0) / count(ret_3m) OVER (PARTITION BY sector) END"
SNAPSHOT = f"""{LISTED}, {VALUE}, {CURRENT}, lp AS (SELECT * EXCLUDE (date) FROM ({PRICE_SQL}) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
own AS MATERIALIZED (SELECT b.ticker, b.date, l.sector, l.famaindustry, NULL::DOUBLE AS fwd_ret_5td, lp.* EXCLUDE (ticker), quality.* EXCLUDE (ticker), value.* EXCLUDE (ticker) FROM b JOIN listed l USING (ticker) LEFT JOIN quality USING (ticker) LEFT JOIN value USING (ticker) LEFT JOIN lp USING (ticker)),
md AS (SELECT sector, {", ".join(f"median({c}) AS {c}_m" for c in (*SN.OVER, *SN.MINUS))} FROM own GROUP BY sector HAVING count(*) >= 5),
peers AS MATERIALIZED (SELECT o.ticker, {", ".join(f"{q6(f'{c} / nullif({c}_m, 0)')} AS {c}_vs_peers" for c in SN.OVER)}, {", ".join(f"{q6(f'{c} - {c}_m')} AS {c}_minus_peers" for c in SN.MINUS)}, {q6('rk')} AS ret_3m_peer_rank FROM (SELECT *, {_RANK} AS rk FROM own) o LEFT JOIN md ON o.sector IS NOT DISTINCT FROM md.sector)"""
ROLES = f"{MACRO_ROLES} instruments art arq ary"
_MACRO_COLUMNS = ("vix", "yield_curve", "hy_spread", "vix_change_20d", "nfci", "real_rate", "market_above_ma200", "market_ret_12m")


def own_rows(r):
    """Listed entities with a price: one row each with quality, valuation and price features."""
    r.keep("bars", "quarters")
    entities = listed(r)
    last = last_prices(r, entities).select("ticker", "date").join(entities, "ticker").withColumn("fwd_ret_5td", F.lit(None).cast("double"))
    prices = price(r).withColumn("_n", F.lead("date").over(PR.W())).where("_n is null").drop("_n", "date")
    for side in (quality(r), valuation(r, entities), prices):
        last = last.join(side, "ticker", "left")
    return last


def with_peers(d):
    d = SN.relative(d, "sector")
    return d.withColumns({c: r6(c) for c in SN.RELATIVE})


@query("peer_relative_current", "bars instruments art arq ary", f"WITH {SNAPSHOT} SELECT * FROM peers")
def peer_relative_current(r):
    return with_peers(own_rows(r)).select("ticker", *SN.RELATIVE)


@query("current_snapshot", ROLES, f"WITH {SNAPSHOT}, {MACRO}, today AS (SELECT {', '.join(_MACRO_COLUMNS)} FROM macro ORDER BY date DESC LIMIT 1) SELECT own.*, peers.* EXCLUDE (ticker), today.* FROM own JOIN peers USING (ticker) CROSS JOIN today")
def current_snapshot(r):
    """Every column of the snapshot: the macro row is one, and joined to all."""
    today = macro_current(r).select(*_MACRO_COLUMNS)
    return with_peers(own_rows(r)).crossJoin(F.broadcast(today))


@query("screen_training", "bars art arq ary", f"WITH {PIT}, pf AS MATERIALIZED ({PRICE_SQL}) SELECT ticker, date, ncfo_r2_5y, roe FROM pit JOIN pf USING (ticker, date) WHERE {SN.TRAINING}")
def screen_training(r):
    """The rows of the panel that one would train on: all eight conditions."""
    stages = r.keep("bars")
    fundamentals = pit(r).select("ticker", "date", *[c for c in PIT_COLUMNS if c in SN.TRAINING])
    d = stages.write("training", fundamentals.join(price(r), ["ticker", "date"]).where(SN.TRAINING))
    return d.select("ticker", "date", "ncfo_r2_5y", "roe")


_QUALITY_VALUE = ST.PUBLISHED[2]


@query("screen_quality_value", QS.ROLES, f"{QS.PANEL} SELECT ticker, date, pcf, fcf_r2_10y, vix FROM (SELECT *, fwd_ret_21td AS fwd_ret FROM mp) WHERE {QS._where(_QUALITY_VALUE)}")
def screen_quality_value(r):
    """Month-end rows that the published quality and value screen lets in, its macro band included."""
    d = QS.month_panel(r).withColumn("fwd_ret", F.col("fwd_ret_21td"))
    return d.where(_QUALITY_VALUE.screen()).select("ticker", "date", "pcf", "fcf_r2_10y", "vix")
