"""Queries: quality metrics by vintage."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import q6, r6
from ..operators import quality as Q
from ..operators.asof import asof_join
from ..registry import query

KEYS = ["ticker", "vintage"]
SPINE = "spine AS (SELECT DISTINCT ticker, datekey AS vintage FROM (SELECT ticker, datekey FROM arq UNION ALL SELECT ticker, datekey FROM ary))"


def _state(f):
    return f"(SELECT s.vintage, f.* FROM spine s JOIN (SELECT *, lead(datekey) OVER (PARTITION BY ticker, reportperiod ORDER BY datekey) AS until FROM {f}) f ON f.ticker = s.ticker AND f.datekey <= s.vintage AND (until IS NULL OR s.vintage < until))"


YEARS = f"""{SPINE}, kq AS {_state('arq')}, ka AS {_state('ary')},
ya AS (SELECT ticker, vintage, year(reportperiod) AS fy, ncfo, coalesce(ncfo, 0) + coalesce(capex, 0) AS fcf, roic, sharesbas AS shares FROM ka),
yq AS (SELECT ticker, vintage, year(reportperiod) AS fy, sum(coalesce(ncfo, 0)) AS ncfo, sum(coalesce(ncfo, 0) + coalesce(capex, 0)) AS fcf, avg(roic) AS roic, max(sharesbas) AS shares FROM kq
  WHERE (ticker, vintage) NOT IN (SELECT ticker, vintage FROM ya) GROUP BY 1, 2, 3 HAVING count(*) >= 3),
years AS (SELECT * FROM ya UNION ALL SELECT * FROM yq)"""


#: What the quality metrics read several times; the state of a vintage is a join of these tables by entity, in as many tasks as they have buckets, so
#: that small files with many pairs are not put together in one.
FILINGS = ("quarters", "arq", "ary")


def _fixed(r):
    r.keep(*FILINGS)
    return Q.known_years(r.arq, r.ary)


def metrics(r):
    r.keep(*FILINGS)
    return Q.quality_metrics(r.arq, r.ary)


@query("quality_vintages", "arq ary", f"WITH {SPINE} SELECT * FROM spine")
def quality_vintages(r):
    return Q.vintages(r.arq, r.ary)


@query("quality_state", "arq ary", f"WITH {SPINE} SELECT ticker, vintage, reportperiod, datekey, revenue FROM {_state('arq')}")
def quality_state(r):
    return Q.state(Q.vintages(r.arq, r.ary), r.arq).select("ticker", "vintage", "reportperiod", "datekey", "revenue")


@query("annual_series", "arq ary", f"WITH {YEARS} SELECT ticker, vintage, fy, {q6('ncfo')} AS ncfo, {q6('fcf')} AS fcf, roic, shares FROM ya")
def annual_series(r):
    d = Q.annual(Q.state(Q.vintages(r.arq, r.ary), r.ary))
    return d.withColumns({"ncfo": r6("ncfo"), "fcf": r6("fcf"), "fy": F.col("fy").cast("long")})


@query("annual_series_fallback", "arq ary", f"WITH {YEARS} SELECT ticker, vintage, fy, {q6('ncfo')} AS ncfo, {q6('fcf')} AS fcf, {q6('roic')} AS roic, shares FROM yq")
def annual_series_fallback(r):
    spine = Q.vintages(r.arq, r.ary)
    d = Q.annual_from_quarters(Q.state(spine, r.arq), Q.annual(Q.state(spine, r.ary)))
    return d.withColumns({"ncfo": r6("ncfo"), "fcf": r6("fcf"), "roic": r6("roic"), "fy": F.col("fy").cast("long")})


@query("ols_trend", "quarters", f"WITH i AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY reportperiod) - 1 AS i FROM quarters) SELECT ticker, {q6('regr_slope(revenue, i)')} AS slope, {q6('CASE WHEN var_pop(revenue) = 0 THEN 0 ELSE regr_r2(revenue, i) END')} AS r2 FROM i GROUP BY ticker")
def ols_trend(r):
    from ..functions.columns import r_squared

    d = r.quarters.withColumn("i", (F.row_number().over(Window.partitionBy("ticker").orderBy("reportperiod")) - 1).cast("double"))
    return d.groupBy("ticker").agg(r6(F.regr_slope("revenue", "i")).alias("slope"), r6(r_squared(F.col("revenue"), F.col("i"))).alias("r2"))


def log_sql(c, n, least=3):
    """R2 of the logarithms of the last n years' positive values, that of arcsinh of the known ones, and the positive share."""
    asinh = f"sign({c}) * ln(abs({c}) + sqrt({c} * {c} + 1))"
    return f"""(SELECT ticker, vintage, CASE WHEN count({c}) >= {least} AND count(*) FILTER ({c} > 0) >= {least} THEN CASE WHEN var_pop(ln({c})) FILTER ({c} > 0) = 0 THEN 0 ELSE regr_r2(ln(CASE WHEN {c} > 0 THEN {c} END), i) END END AS r2,
CASE WHEN count({c}) >= 3 THEN count(*) FILTER ({c} > 0) / count({c}) END AS up, CASE WHEN count({c}) >= 3 THEN CASE WHEN var_pop({asinh}) = 0 THEN 0 ELSE regr_r2({asinh}, j) END END AS ash
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, vintage, {c} > 0 ORDER BY fy) - 1 AS i, row_number() OVER (PARTITION BY ticker, vintage, {c} IS NULL ORDER BY fy) - 1 AS j
  FROM (SELECT * FROM years QUALIFY row_number() OVER (PARTITION BY ticker, vintage ORDER BY fy DESC) <= {n})) GROUP BY ticker, vintage)"""


@query("r2_log_trend", "arq ary", f"WITH {YEARS} SELECT ticker, vintage, {q6('r2')} AS ncfo_r2_5y, {q6('up')} AS ncfo_positive_5y FROM {log_sql('ncfo', 5)}")
def r2_log_trend(r):
    d = Q.log_trend(_fixed(r)[0], "ncfo", 5, KEYS)
    return d.withColumns({c: r6(c) for c in ("ncfo_r2_5y", "ncfo_positive_5y")})


@query("r2_adjusted", "arq ary", f"WITH {YEARS} SELECT ticker, vintage, {q6('f.r2 * f.up')} AS fcf_r2_adjusted, {q6('round(n.r2 * n.up - f.r2 * f.up, 4)')} AS fcf_ncfo_r2_delta FROM {log_sql('fcf', 10)} f JOIN {log_sql('ncfo', 10)} n USING (ticker, vintage)")
def r2_adjusted(r):
    return Q.of_years(_fixed(r)[0], KEYS).select(*KEYS, *[r6(c).alias(c) for c in ("fcf_r2_adjusted", "fcf_ncfo_r2_delta")])


@query("r2_asinh_trend", "arq ary", f"WITH {YEARS} SELECT ticker, vintage, {q6('ash * up')} AS fcf_asinh_r2_10y FROM {log_sql('fcf', 10)}")
def r2_asinh_trend(r):
    return Q.asinh_trend(_fixed(r)[0], "fcf", 10, KEYS).withColumn("fcf_asinh_r2_10y", r6("fcf_asinh_r2_10y"))


def cagr_sql(c, n):
    return f"(SELECT ticker, vintage, CASE WHEN count(*) = {n + 1} AND count({c}) = {n + 1} AND arg_min({c}, fy) > 0 AND arg_max({c}, fy) > 0 THEN pow(arg_max({c}, fy) / arg_min({c}, fy), 1.0 / {n}) - 1 END AS g FROM (SELECT * FROM years QUALIFY row_number() OVER (PARTITION BY ticker, vintage ORDER BY fy DESC) <= {n + 1}) GROUP BY ticker, vintage)"


@query("cagr_strict", "arq ary", f"WITH {YEARS} SELECT a.ticker, a.vintage, {q6('a.g')} AS ncfo_cagr_5y, {q6('b.g')} AS ncfo_cagr_10y FROM {cagr_sql('ncfo', 5)} a JOIN {cagr_sql('ncfo', 10)} b ON a.ticker = b.ticker AND a.vintage = b.vintage")
def cagr_strict(r):
    d = Q.measure(_fixed(r)[0], KEYS, "fy", Q.strict_growth_part("ncfo", 5), Q.strict_growth_part("ncfo", 10))
    return d.withColumns({c: r6(c) for c in ("ncfo_cagr_5y", "ncfo_cagr_10y")})


_ROIC = "(SELECT ticker, vintage, max(CASE WHEN back = 1 THEN roic END) AS roic, CASE WHEN count(roic) >= 2 THEN regr_slope(roic, i) END AS slope FROM (SELECT *, row_number() OVER (PARTITION BY ticker, vintage, roic IS NULL ORDER BY fy) - 1 AS i FROM (SELECT *, row_number() OVER (PARTITION BY ticker, vintage ORDER BY fy DESC) AS back FROM years) WHERE back <= 3) GROUP BY ticker, vintage)"


@query("roic_trend", "arq ary", f"WITH {YEARS} SELECT ticker, vintage, {q6('roic')} AS roic_level, {q6('slope')} AS roic_slope_3y FROM {_ROIC}")
def roic_trend(r):
    return Q.roic_trend(_fixed(r)[0], KEYS).withColumns({c: r6(c) for c in ("roic_level", "roic_slope_3y")})


_QT = "(SELECT ticker, vintage, CASE WHEN count(grossmargin) >= 4 THEN regr_slope(grossmargin, gi) END AS g, CASE WHEN count(nd) >= 4 THEN regr_slope(nd, ni) END AS n FROM (SELECT *, row_number() OVER (PARTITION BY ticker, vintage, grossmargin IS NULL ORDER BY reportperiod) - 1 AS gi, row_number() OVER (PARTITION BY ticker, vintage, nd IS NULL ORDER BY reportperiod) - 1 AS ni FROM (SELECT *, debt - cashnequsd AS nd FROM kq QUALIFY row_number() OVER (PARTITION BY ticker, vintage ORDER BY reportperiod DESC) <= 8)) GROUP BY ticker, vintage)"


@query("quarterly_trends", "arq ary", f"WITH {YEARS} SELECT ticker, vintage, {q6('g')} AS grossmargin_slope, {q6('n')} AS net_debt_trend FROM {_QT}")
def quarterly_trends(r):
    return Q.quarterly_trends(_fixed(r)[1]).withColumns({c: r6(c) for c in ("grossmargin_slope", "net_debt_trend")})


_DIL = "(SELECT ticker, vintage, CASE WHEN count(*) FILTER (shares > 0) >= 2 THEN pow(arg_max(shares, fy) FILTER (shares > 0) / arg_min(shares, fy) FILTER (shares > 0), 1.0 / (count(*) FILTER (shares > 0) - 1)) - 1 END AS d FROM years GROUP BY ticker, vintage)"


@query("dilution_rate", "arq ary", f"WITH {YEARS} SELECT ticker, vintage, {q6('d')} AS dilution_rate FROM {_DIL}")
def dilution_rate(r):
    return Q.dilution(_fixed(r)[0], KEYS).withColumn("dilution_rate", r6("dilution_rate"))


_SIDES = {f"{c}{n}": log_sql(c, n) for c in ("ncfo", "fcf") for n in (5, 10)} | {f"g{c}{n}": cagr_sql(c, n) for c in ("ncfo", "fcf") for n in (5, 10)} | {"o": _ROIC, "d": _DIL, "q": _QT}
_METRIC = {}
for _c in ("ncfo", "fcf"):
    _METRIC |= {f"{_c}_r2_5y": f"{_c}5.r2", f"{_c}_r2_10y": f"{_c}10.r2", f"{_c}_cagr_5y": f"g{_c}5.g", f"{_c}_cagr_10y": f"g{_c}10.g", f"{_c}_pct_positive": f"{_c}10.up", f"{_c}_r2_adjusted": f"{_c}10.r2 * {_c}10.up", f"{_c}_r2_adjusted_arcsinh": f"{_c}10.ash * {_c}10.up"}
_METRIC |= {"fcf_ncfo_r2_delta": "round(ncfo10.r2 * ncfo10.up - fcf10.r2 * fcf10.up, 4)", "roic_level": "o.roic", "roic_slope_3y": "o.slope", "grossmargin_slope": "q.g", "net_debt_trend": "q.n", "dilution_rate": "d.d"}
METRICS = f"SELECT s.ticker, s.vintage, {', '.join(f'{q6(e)} AS {k}' for k, e in _METRIC.items())} FROM spine s " + " ".join(f"LEFT JOIN {t} {k} USING (ticker, vintage)" for k, t in _SIDES.items())
METRIC_COLUMNS = Q.METRICS


@query("quality_metrics", "arq ary", f"WITH {YEARS} {METRICS}")
def quality_metrics(r):
    return metrics(r).select(*KEYS, *[r6(c).alias(c) for c in METRIC_COLUMNS])


@query("asof_quality", "bars arq ary", f"WITH {YEARS}, d AS {_DIL} SELECT b.ticker, b.date, d.vintage, {q6('d.d')} AS dilution_rate FROM bars b ASOF LEFT JOIN d ON b.ticker = d.ticker AND b.date >= d.vintage")
def asof_quality(r):
    d = Q.dilution(_fixed(r)[0], KEYS).withColumn("at", F.col("vintage"))
    return asof_join(r.bars.select("ticker", "date"), d, "ticker", "date", "at", ["vintage", "dilution_rate"]).withColumn("dilution_rate", r6("dilution_rate"))


@query("restatement_counts", "arq", "SELECT ticker, reportperiod, count(*) AS versions FROM arq GROUP BY ticker, reportperiod HAVING count(*) > 1")
def restatement_counts(r):
    return r.arq.groupBy("ticker", "reportperiod").agg(F.count(F.lit(1)).alias("versions")).where("versions > 1")


@query("restatement_magnitude", "arq", f"SELECT ticker, reportperiod, {q6('arg_max(revenue, datekey) / arg_min(revenue, datekey) - 1')} AS change FROM arq GROUP BY ticker, reportperiod HAVING count(*) > 1")
def restatement_magnitude(r):
    d = r.arq.groupBy("ticker", "reportperiod").agg(F.count(F.lit(1)).alias("n"), F.min_by("revenue", "datekey").alias("a"), F.max_by("revenue", "datekey").alias("b")).where("n > 1")
    return d.select("ticker", "reportperiod", r6(F.col("b") / F.col("a") - 1).alias("change"))
