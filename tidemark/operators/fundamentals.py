"""Point-in-time fundamentals: as-of filings, staleness, guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import positive_ratio as over
from ..functions.columns import ratio
from .asof import Facts, asof_join, asof_joins, year_after

FILED = ["ncfo", "capex", "revenue", "revenueusd", "netinccmn", "shareswa", "equity", "assets", "liabilities", "debt", "cashnequsd", "ebitda", "ebt", "sbcomp", "divyield", "dps", "roe", "currentratio", "epsdil"]


def latest_versions(filings: DataFrame) -> DataFrame:
    """The last filed version of each report period."""
    rest = [c for c in filings.columns if c not in ("ticker", "reportperiod")]
    return filings.groupBy("ticker", "reportperiod").agg(F.max_by(F.struct(*rest), "datekey").alias("x")).select("ticker", "reportperiod", "x.*")


def with_latest(grid: DataFrame, filings: DataFrame, prefix: str, payload: list[str], shift: Column | None = None) -> DataFrame:
    """``grid`` with the filing known on its date (or on ``shift``), columns prefixed."""
    f = filings.withColumns({f"{prefix}{c}": F.col(c) for c in ("datekey", "reportperiod", *payload)})
    return asof_join(grid, f, "ticker", "date", "datekey", [f"{prefix}{c}" for c in ("datekey", "reportperiod", *payload)], tie=["reportperiod"], shift=shift)


STALENESS = ("datekey", "days_since_filing", "quarters_stale", "days_since_art", "days_since_arq", "days_since_filing_max")


def staleness(d: DataFrame, art: str = "art_datekey", arq: str = "arq_datekey") -> DataFrame:
    """The later of two filing dates, the days since it, that in quarters, the days since each, and the longer of both; nulls where neither is known."""
    since = lambda c: F.datediff("date", c).cast("long")
    known = F.col(art).isNotNull() | F.col(arq).isNotNull()
    zero = lambda c: F.coalesce(since(c), F.lit(0).cast("long"))
    return d.withColumn("datekey", F.greatest(art, arq)).withColumns({
        "days_since_filing": since("datekey"), "quarters_stale": since("datekey") / 91.0, "days_since_art": since(art), "days_since_arq": since(arq),
        "days_since_filing_max": F.when(known, F.greatest(zero(art), zero(arq))),
    })


def ratios(d: DataFrame, p: str = "art_", before: str = "prev_") -> DataFrame:
    """Valuation and profitability ratios from the filing with prefix ``p``, the one a year earlier, and closeadj.

    Market capitalisation needs a positive share count. Price ratios to cash flow, income, equity and EBITDA need a
    positive denominator, like stock compensation to revenue; free cash flow and revenue otherwise need not be zero. Missing debt or cash counts as none."""
    c = lambda n: F.col(p + n)
    cap = F.when(c("shareswa") > 0, F.col("closeadj") * c("shareswa"))
    sales, free = F.coalesce(c("revenueusd"), c("revenue")), c("ncfo") + c("capex")
    none = lambda n: F.coalesce(c(n), F.lit(0.0))
    out = {
        "fcf_conversion": ratio(free, c("netinccmn")), "accrual": ratio(c("netinccmn") - c("ncfo"), c("assets")), "sbc_pct": over(c("sbcomp"), sales), "capex_intensity": ratio(F.abs(c("capex")), sales),
        "fcf_recon_ttm": free, "pcf": over(cap, c("ncfo")), "pfcf": ratio(cap, free), "ncfo_to_revenue": ratio(c("ncfo"), sales), "fcf_to_revenue": ratio(free, sales),
        "pe": over(cap, c("netinccmn")), "pb": over(cap, c("equity")), "ps": ratio(cap, sales), "evebitda": over(cap + none("debt") - none("cashnequsd"), c("ebitda")),
        "dividend_yield": F.coalesce(c("divyield"), ratio(c("dps"), F.col("closeadj"))), "roe": F.coalesce(c("roe"), ratio(c("netinccmn"), c("equity"))), "pretax_margin": ratio(c("ebt"), sales),
        "current_ratio": c("currentratio"), "debt_to_equity": ratio(c("debt"), c("equity")), "liabilities_to_assets": ratio(c("liabilities"), c("assets")), "payout": ratio(c("dps"), c("epsdil")),
        "eps_growth": ratio(c("epsdil") - F.col(before + "epsdil"), F.col(before + "epsdil")),
    }
    return d.withColumns({k: v for k, v in out.items()})


RATIOS = ("fcf_conversion", "accrual", "sbc_pct", "capex_intensity", "fcf_recon_ttm", "pcf", "pfcf", "ncfo_to_revenue", "fcf_to_revenue", "pe", "pb", "ps", "evebitda", "dividend_yield", "roe", "pretax_margin", "current_ratio", "debt_to_equity", "liabilities_to_assets", "payout", "eps_growth")


def known_filings(filings: DataFrame, prefix: str, payload: list[str]) -> DataFrame:
    return filings.select("ticker", F.col("datekey").alias("_at"), F.col("reportperiod").alias("_period"), *[F.col(c).alias(f"{prefix}{c}") for c in ("datekey", "reportperiod", *payload)])


def known(art: DataFrame) -> list[Facts]:
    """The filing known on a date, and the one known a year before it, for `asof_joins`."""
    return [
        Facts(known_filings(art, "art_", FILED), "_at", [f"art_{c}" for c in ("datekey", *FILED)], ["_period"]),
        Facts(known_filings(art, "prev_", ["epsdil"]), year_after("_at"), ["prev_epsdil"], ["_at", "_period"]),
    ]


def with_ratios(grid: DataFrame, art: DataFrame) -> DataFrame:
    """``grid`` (ticker, date, closeadj) with the ratios of what was on file each day."""
    return ratios(asof_joins(grid, "ticker", "date", known(art)))


def point_in_time(art: DataFrame, quality: DataFrame) -> list[Facts]:
    """What `fundamental_pit` looks up: the filings of `known` and the last vintage with its metrics."""
    metrics = [c for c in quality.columns if c not in ("ticker", "vintage")]
    return [*known(art), Facts(quality.withColumn("arq_datekey", F.col("vintage")), "vintage", ["arq_datekey", *metrics])]


def fundamental_pit(grid: DataFrame, art: DataFrame, quality: DataFrame) -> DataFrame:
    """``grid`` (ticker, date, closeadj) with what was on file each day: the ratios of the trailing-year filing, growth over the one known a year
    before, the quality metrics of the last vintage, and the ages of both. ``quality`` is `quality.quality_metrics`; three as-of joins in one exchange."""
    return staleness(ratios(asof_joins(grid, "ticker", "date", point_in_time(art, quality))))
