"""One row an entity as of one date: restated quality, valuation of the last filing at the last price, price features, peers, macro."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from . import fundamentals as FU
from . import peers as P
from . import quality as Q
from .asof import asof_joins

QUALITY = ("ncfo_r2_5y", "ncfo_cagr_5y", "ncfo_r2_10y", "ncfo_cagr_10y", "ncfo_pct_positive", "grossmargin_slope", "roic_level", "fcf_r2_5y", "fcf_r2_10y", "fcf_cagr_5y", "fcf_cagr_10y")
VALUATION = ("pcf", "roe", "current_ratio", "pe", "pb", "ps", "evebitda", "dividend_yield", "pretax_margin", "debt_to_equity", "liabilities_to_assets", "payout", "eps_growth", "capex_intensity", "accrual")
OVER, MINUS = ("pe", "pb", "ps", "pcf", "evebitda"), ("roic_level", "ret_3m", "vol_20d")
RELATIVE = (*[f"{c}_vs_peers" for c in OVER], *[f"{c}_minus_peers" for c in MINUS], "ret_3m_peer_rank")


def quality(arq: DataFrame, ary: DataFrame) -> DataFrame:
    """The metrics of each entity with annual filings, from the last version of every year and of every quarter."""
    one = F.lit("9999-12-31").cast("date")
    years = Q.of_years(Q.annual(FU.latest_versions(ary).withColumn("vintage", one)), ["ticker"])
    quarters = Q.quarterly_trends(FU.latest_versions(arq).withColumn("vintage", one)).drop("vintage")
    return years.join(quarters, "ticker", "left").select("ticker", *QUALITY)


def valuation(last: DataFrame, art: DataFrame) -> DataFrame:
    """``last`` (ticker, date, closeadj: the as-of date and the last price by it) with ratios of the last filing; a denominator of 0 gives null, its sign is not looked at."""
    d = asof_joins(last, "ticker", "date", FU.known(art))
    c = lambda n: F.col(f"art_{n}")
    cap, sales = F.col("closeadj") * c("shareswa"), F.coalesce(c("revenueusd"), c("revenue"))
    none = lambda n: F.coalesce(c(n), F.lit(0.0))
    out = {
        "pcf": ratio(cap, c("ncfo")), "roe": F.coalesce(c("roe"), ratio(c("netinccmn"), c("equity"))), "current_ratio": c("currentratio"), "pe": ratio(cap, c("netinccmn")), "pb": ratio(cap, c("equity")), "ps": ratio(cap, sales),
        "evebitda": ratio(cap + none("debt") - none("cashnequsd"), c("ebitda")), "dividend_yield": F.coalesce(c("divyield"), ratio(c("dps"), F.col("closeadj"))), "pretax_margin": ratio(c("ebt"), sales),
        "debt_to_equity": ratio(c("debt"), c("equity")), "liabilities_to_assets": ratio(c("liabilities"), c("assets")), "payout": ratio(c("dps"), c("epsdil")), "eps_growth": ratio(c("epsdil") - F.col("prev_epsdil"), F.col("prev_epsdil")),
        "capex_intensity": ratio(F.abs(c("capex")), sales), "accrual": ratio(c("netinccmn") - c("ncfo"), c("assets")),
    }
    return d.select("ticker", *[x.alias(k) for k, x in out.items()])


def relative(rows: DataFrame, group: str, least: int = 5) -> DataFrame:
    """``rows`` with ratios to and differences from the medians of groups of at least ``least`` rows, and the average percentile rank of ret_3m. A
    null group is a group of its own; a median of 0 gives null."""
    d = rows.withColumn("_g", F.struct(F.col(group)))
    m = P.medians(d, ["_g"], [*OVER, *MINUS], least)
    d = P.with_average_rank(d, ["_g"], "ret_3m", "ret_3m_peer_rank").join(m, "_g", "left")
    new = {f"{c}_vs_peers": ratio(c, f"{c}_median") for c in OVER} | {f"{c}_minus_peers": F.col(c) - F.col(f"{c}_median") for c in MINUS}
    return d.withColumns(new).drop("_g", "peers", *[f"{c}_median" for c in (*OVER, *MINUS)])


#: What rows to train on must satisfy (fixed values).
TRAINING = "ncfo_r2_5y > 0.5 and fcf_cagr_5y > 0 and roe > 0.12 and debt_to_equity < 1.5 and grossmargin_slope > 0 and ret_12m > 0 and ret_1m > -0.15 and ret_6m > ret_3m"
