"""Queries: the merged panel and checks on it."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import q6, r6
from ..operators import checks as C
from ..operators import fundamentals as FU
from ..operators import holding as HD
from ..operators import prices as PR
from ..operators import universe as U
from ..operators.asof import asof_join
from ..operators.quantiles import exact_quantiles, quantile_row
from ..registry import query
from .q_features import _ASOF, _PREV, PIT, RATIO_COLUMNS
from .q_prices import PRICE_SQL
from .q_quality import METRICS, YEARS, metrics
from .q_universe import CLEAN, CORE, LABELS, TERMINAL


def _row(check, subject, value, lo, hi):
    """One report row in SQL; the value is rounded before it is judged."""
    lo_s, hi_s = ("NULL" if x is None else repr(float(x)) for x in (lo, hi))
    return f"SELECT '{check}' AS \"check\", '{subject}' AS subject, ({value})::DOUBLE AS value, {lo_s}::DOUBLE AS lo, {hi_s}::DOUBLE AS hi"


def _report(rows):
    return f"SELECT *, CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN (lo IS NULL OR value >= lo) AND (hi IS NULL OR value <= hi) THEN 'PASS' ELSE 'FAIL' END AS status FROM ({' UNION ALL '.join(rows)})"


@query("check_no_lookahead", "bars art", f"WITH f AS (SELECT b.date, f.datekey FROM bars b {_ASOF}) " + _report([_row("look-ahead", "late", "SELECT count(*) FILTER (datekey > date) FROM f", 0, 0), _row("look-ahead", "unknown", "SELECT " + q6("avg(CASE WHEN datekey IS NULL THEN 1.0 ELSE 0.0 END)") + " FROM f", 0, 0.5)]))
def check_no_lookahead(r):
    d = FU.with_latest(r.bars.select("ticker", "date"), r.art, "art_", [])
    v = d.agg(F.count_if(F.col("art_datekey") > F.col("date")).alias("late"), r6(C.share(F.col("art_datekey").isNull())).alias("unknown"))
    return C.report(v, {"late": ("look-ahead", 0, 0), "unknown": ("look-ahead", 0, 0.5)})


_AGE = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


@query("check_staleness", "bars art", f"WITH f AS (SELECT datediff('day', f.datekey, b.date) AS age FROM bars b {_ASOF}) " + _report([_row("staleness", "median_age", "SELECT median(age) FROM f", None, 120), _row("staleness", "max_age", "SELECT max(age) FROM f", None, 400), _row("staleness", "over_a_year", "SELECT " + q6("avg(CASE WHEN age > 365 THEN 1.0 ELSE 0.0 END)") + " FROM f", None, 0.1), *[_row("staleness", k, f"SELECT {q6(f'quantile_cont(age, {p})')} FROM f", None, None) for k, p in _AGE.items()]]))
def check_staleness(r):
    """Ages are whole days, so they are counted by day first: no task sees all rows."""
    d = FU.with_latest(r.bars.select("ticker", "date"), r.art, "art_", []).groupBy(F.datediff("date", "art_datekey").alias("age")).agg(F.count(F.lit(1)).alias("n"))
    old = F.sum(F.when(F.col("age") > 365, F.col("n")).otherwise(0)) / F.sum("n")
    v = d.agg(F.percentile("age", F.lit(0.5), F.col("n")).alias("median_age"), F.max("age").alias("max_age"), r6(old).alias("over_a_year"), *[r6(F.percentile("age", F.lit(p), F.col("n"))).alias(k) for k, p in _AGE.items()])
    return C.report(v, {"median_age": ("staleness", None, 120), "max_age": ("staleness", None, 400), "over_a_year": ("staleness", None, 0.1)} | {k: ("staleness", None, None) for k in _AGE})


@query("check_percentiles", "bars", f"SELECT {', '.join(f'{q6(f'quantile_cont(closeadj, {p})')} AS p{round(p * 100):02d}' for p in (0.01, 0.25, 0.5, 0.75, 0.99))} FROM bars")
def check_percentiles(r):
    d = quantile_row(r.bars, {f"p{round(p * 100):02d}": ("closeadj", p) for p in (0.01, 0.25, 0.5, 0.75, 0.99)})
    return d.select(*[r6(c).alias(c) for c in d.columns])


@query("check_duplicates", "lines", "SELECT ticker, date, count(*) AS n FROM lines GROUP BY ticker, date HAVING count(*) > 1")
def check_duplicates(r):
    return C.duplicates(r.lines, ["ticker", "date"])


_RANGES = {"pe": 500, "pb": 50, "pcf": 200, "evebitda": 100}
_OUT = {k: f"avg(CASE WHEN {k} < 0 OR {k} > {hi} THEN 1.0 ELSE 0.0 END)" for k, hi in _RANGES.items()}


@query("check_ranges", "bars art", f"WITH pit AS MATERIALIZED (SELECT b.ticker, b.date, {RATIO_COLUMNS} FROM bars b {_ASOF} {_PREV}) " + _report([_row("range", k, f"SELECT {q6(e)} FROM pit", 0, 0.05) for k, e in _OUT.items()]))
def check_ranges(r):
    d = FU.with_ratios(r.bars.select("ticker", "date", "closeadj"), r.art).select(*[r6(k).alias(k) for k in _RANGES])
    return C.report(d.agg(*[r6(C.share((F.col(k) < 0) | (F.col(k) > hi))).alias(k) for k, hi in _RANGES.items()]), {k: ("range", 0, 0.05) for k in _RANGES})


_PANEL = f"WITH pf AS MATERIALIZED ({PRICE_SQL}), pit AS MATERIALIZED (SELECT b.ticker, b.date, {RATIO_COLUMNS} FROM bars b {_ASOF} {_PREV}), panel AS MATERIALIZED (SELECT * FROM pf JOIN pit USING (ticker, date))"
NUMERIC = (*PR.FEATURES, *FU.RATIOS)


def features(r):
    """Price features and ratios of every bar: filings are looked up for the rows of the features, so nothing is joined by entity and date."""
    d = FU.with_ratios(PR.price_features(r.bars).select("ticker", "date", "closeadj", *PR.FEATURES), r.art)
    return d.select("ticker", "date", *NUMERIC)


@query("check_null_rates", "bars art", f"{_PANEL} " + " UNION ALL ".join(f"SELECT '{c}' AS subject, {q6(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS rate, coalesce(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) > 0.8, false) AS sparse FROM panel" for c in NUMERIC))
def check_null_rates(r):
    d = features(r)
    return C.null_rates(d, list(NUMERIC)).select("subject", r6("rate").alias("rate"), (F.col("rate") > 0.8).alias("sparse"))


@query("check_universe_by_year", "bars", "SELECT year(date) AS year, count(DISTINCT ticker) AS tickers FROM bars GROUP BY 1")
def check_universe_by_year(r):
    return r.bars.groupBy(F.year("date").cast("long").alias("year")).agg(F.countDistinct("ticker").alias("tickers"))


@query("coverage_matrix", "bars art", f"""{_PANEL}, own AS (SELECT ticker, {', '.join(f'100.0 * count({c}) / count(*) AS {c}' for c in NUMERIC)} FROM panel GROUP BY ticker), l AS (UNPIVOT own ON COLUMNS(* EXCLUDE ticker) INTO NAME subject VALUE pct)
SELECT ticker, subject, {q6('pct')} AS pct, pct = 0 AND max(pct) OVER (PARTITION BY subject) > 50 AS flagged FROM l""")
def coverage_matrix(r):
    """The known share of every column by entity; flagged where an entity has none and another over half. One aggregate for all cells."""
    d = features(r)
    return C.coverage(d, "ticker", list(NUMERIC)).withColumn("pct", r6("pct"))


@query("check_cross_feature_corr", "vendor", f"SELECT {q6('corr(pe, pb)')} AS pe_pb FROM vendor")
def check_cross_feature_corr(r):
    return r.vendor.agg(r6(F.corr("pe", "pb")).alias("pe_pb"))


DESCRIBED = ("high", "low", "volume", "closeadj", "ret_1m", "ret_12m", "vol_20d", "pct_52w_range", "ma50_cross")
_QUARTERS = {"q25": 0.25, "median": 0.5, "q75": 0.75}
_DESCRIBE = " UNION ALL ".join(f"SELECT '{c}' AS subject, count({c}) AS n, count(*) - count({c}) AS nulls, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, {q6(f'avg({c})')} AS mean, {q6(f'stddev_samp({c})')} AS std, {', '.join(f'{q6(f'quantile_cont({c}, {p})')} AS {k}' for k, p in _QUARTERS.items())} FROM x" for c in DESCRIBED)


@query("feature_describe", "bars", f"WITH p AS ({PRICE_SQL}), x AS MATERIALIZED (SELECT * FROM bars JOIN p USING (ticker, date)) {_DESCRIBE}")
def feature_describe(r):
    """Counts, nulls, range, mean, deviation and quartiles of columns, a row each; quartiles by counting, in no single task."""
    d = PR.price_features(r.bars).select(*[r6(c).alias(c) if c in PR.FEATURES else c for c in DESCRIBED])
    one = lambda c: F.struct(F.lit(c).alias("subject"), F.count(c).alias("n"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), r6(F.avg(c)).alias("mean"), r6(F.stddev_samp(c)).alias("std"))
    own = d.agg(F.array(*map(one, DESCRIBED)).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    q = exact_quantiles(d, list(DESCRIBED), list(_QUARTERS.values())).groupBy("subject").agg(*[r6(F.max(F.when(F.col("p") == p, F.col("value")))).alias(k) for k, p in _QUARTERS.items()])
    return own.join(q, "subject", "left")


@query("check_jumps", "bars", f"SELECT ticker, date, {q6('closeadj / pc - 1')} AS jump FROM (SELECT *, lag(closeadj) OVER (PARTITION BY ticker ORDER BY date) AS pc FROM bars) WHERE abs(closeadj / pc - 1) > 0.95")
def check_jumps(r):
    d = r.bars.withColumn("pc", F.lag("closeadj").over(Window.partitionBy("ticker").orderBy("date"))).withColumn("j", F.try_divide("closeadj", "pc") - 1)
    return d.where(F.abs("j") > 0.95).select("ticker", "date", r6("j").alias("jump"))


@query("check_null_gaps", "arq", "SELECT ticker, reportperiod, datekey FROM (SELECT *, lag(ncfo) OVER (PARTITION BY ticker ORDER BY reportperiod, datekey) AS before FROM arq) WHERE ncfo IS NULL AND before IS NOT NULL")
def check_null_gaps(r):
    d = r.arq.withColumn("before", F.lag("ncfo").over(Window.partitionBy("ticker").orderBy("reportperiod", "datekey")))
    return d.where("ncfo is null and before is not null").select("ticker", "reportperiod", "datekey")


@query("check_warmup", "bars", f"WITH p AS (SELECT ticker, date, ret_12m, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM ({PRICE_SQL})) SELECT ticker, count(*) FILTER (k <= 252 AND ret_12m IS NOT NULL) AS early, count(*) FILTER (k > 252 AND ret_12m IS NULL) AS missing FROM p GROUP BY ticker")
def check_warmup(r):
    d = PR.with_returns(r.bars).withColumn("k", F.row_number().over(PR.W()))
    return d.groupBy("ticker").agg(F.count_if((F.col("k") <= 252) & F.col("ret_12m").isNotNull()).alias("early"), F.count_if((F.col("k") > 252) & F.col("ret_12m").isNull()).alias("missing"))


@query("check_key_parity", "bars instruments actions", f"WITH {CORE} SELECT ticker, date, 'left' AS side FROM (SELECT ticker, date FROM bars EXCEPT SELECT ticker, date FROM core) UNION ALL SELECT ticker, date, 'right' FROM (SELECT ticker, date FROM core EXCEPT SELECT ticker, date FROM bars)")
def check_key_parity(r):
    """Keys of the bars that the universe lacks, and the other way round."""
    core = U.core(r.bars, r.instruments, U.removals(U.terminal_events(U.clean_actions(r.actions))))
    return C.parity(r.bars, core, ["ticker", "date"])


_DAYS = "SELECT DISTINCT date FROM "


@query("check_calendar", "bars instruments actions series", f"WITH {CORE}, m AS ({_DAYS}series), u AS ({_DAYS}core) " + _report([_row("calendar", "weekend_dates", "SELECT count(*) FROM u WHERE isodow(date) > 5", 0, 0), _row("calendar", "universe_without_macro", "SELECT count(*) FROM (FROM u EXCEPT FROM m)", 0, 0), _row("calendar", "macro_without_universe", "SELECT count(*) FROM (FROM m EXCEPT FROM u)", 0, 0), _row("calendar", "difference_in_dates", "SELECT (SELECT count(*) FROM u) - (SELECT count(*) FROM m)", 0, 0)]))
def check_calendar(r):
    """Weekend dates, and dates that only the universe or only the macro series have."""
    core = U.core(r.bars, r.instruments, U.removals(U.terminal_events(U.clean_actions(r.actions))))
    d = core.select("date").distinct().withColumn("u", F.lit(1)).join(r.series.select("date").distinct().withColumn("m", F.lit(1)), "date", "full")
    v = d.agg(
        F.count_if(F.col("u").isNotNull() & (F.weekday("date") >= 5)).alias("weekend_dates"), F.count_if(F.col("m").isNull()).alias("universe_without_macro"),
        F.count_if(F.col("u").isNull()).alias("macro_without_universe"), (F.count("u") - F.count("m")).alias("difference_in_dates"),
    )
    return C.report(v, {c: ("calendar", 0, 0) for c in v.columns})


@query("check_extreme_returns", "bars", f"SELECT ticker, date, ret FROM (SELECT ticker, date, {q6('closeadj / lag(closeadj, 252) OVER (PARTITION BY ticker ORDER BY date) - 1')} AS ret FROM bars) WHERE ret IS NOT NULL ORDER BY ret DESC, ticker, date LIMIT 10")
def check_extreme_returns(r):
    return PR.with_returns(r.bars).select("ticker", "date", r6("ret_12m").alias("ret")).where("ret is not null").orderBy(F.desc("ret"), "ticker", "date").limit(10)


@query("check_split_extremes", "bars splits", f"WITH p AS ({PRICE_SQL}) SELECT p.ticker, p.date, p.ret_12m, s.value, abs(p.ret_12m + 1 - s.value) < 0.5 AS near FROM p JOIN splits s ON p.ticker = s.ticker AND p.date = s.date WHERE p.ret_12m > 5")
def check_split_extremes(r):
    """Returns of over 500 % on the date of a split, and whether they are near its ratio."""
    d = PR.with_returns(r.bars).select("ticker", "date", r6("ret_12m").alias("ret_12m")).where("ret_12m > 5").join(r.splits, ["ticker", "date"])
    return d.select("ticker", "date", "ret_12m", "value", (F.abs(F.col("ret_12m") + 1 - F.col("value")) < 0.5).alias("near"))


@query("check_label_rate", "bars actions", f"WITH {TERMINAL}{LABELS} " + _report([_row("labels", "delisted_63td", "SELECT " + q6("avg(CASE WHEN fwd_delisted_63td THEN 1.0 WHEN NOT fwd_delisted_63td THEN 0.0 END)") + " FROM labels", 0.02, 0.05)]))
def check_label_rate(r):
    """The mean of the label, over the rows that have one."""
    flag = F.col("fwd_delisted_63td")
    d = U.forward_labels(r.bars, U.terminal_events(U.clean_actions(r.actions)), (63,)).agg(r6(F.avg(F.when(flag, 1.0).when(~flag, 0.0))).alias("delisted_63td"))
    return C.report(d, {"delisted_63td": ("labels", 0.02, 0.05)})


@query("check_median_bands", "bars arq ary", f"WITH {YEARS}, qm AS MATERIALIZED ({METRICS}), p AS ({PRICE_SQL}) " + _report([_row("median", "vol_20d", f"SELECT {q6('median(vol_20d)')} FROM p", 0.1, 0.8), _row("median", "atr_14d", f"SELECT {q6('median(atr_14d)')} FROM p", None, 0.1), _row("nulls", "quality_null", "SELECT " + q6("avg(CASE WHEN ncfo_r2_10y IS NULL THEN 1.0 ELSE 0.0 END)") + " FROM qm", 0, 0.4)]))
def check_median_bands(r):
    """Medians of volatility and true range, and how often the quality trend is unknown."""
    p = PR.price_features(r.bars).select(r6("vol_20d").alias("vol_20d"), r6("atr_14d").alias("atr_14d"))
    m = quantile_row(p, {c: (c, 0.5) for c in p.columns}).select(*[r6(c).alias(c) for c in p.columns])
    q = metrics(r).agg(r6(C.share(F.col("ncfo_r2_10y").isNull())).alias("quality_null"))
    return C.report(m.crossJoin(F.broadcast(q)), {"vol_20d": ("median", 0.1, 0.8), "atr_14d": ("median", None, 0.1), "quality_null": ("nulls", 0, 0.4)})


@query("check_change_frequency", "bars art arq ary", f"""WITH {PIT}, k AS (SELECT ticker, date, ncfo_r2_adjusted, lag(ncfo_r2_adjusted) OVER (PARTITION BY ticker ORDER BY date) AS before FROM pit WHERE ncfo_r2_adjusted IS NOT NULL),
span AS (SELECT ticker, datediff('day', min(date), max(date)) / 365.0 AS years FROM pit GROUP BY ticker), c AS (SELECT ticker, count(*) FILTER (ncfo_r2_adjusted <> before) AS n FROM k GROUP BY ticker)
SELECT ticker, coalesce(n, 0) AS changes, {q6('coalesce(n, 0) / greatest(years, 0.1)')} AS per_year FROM span LEFT JOIN c USING (ticker)""")
def check_change_frequency(r):
    """How often a filing metric changes on the daily panel, and how often a year: about four times where filings are quarterly."""
    quality = metrics(r).select("ticker", "vintage", r6("ncfo_r2_adjusted").alias("x"))
    d = asof_join(r.dealt("bars").select("ticker", "date"), quality, "ticker", "date", "vintage", ["x"])
    before = F.last("x", ignorenulls=True).over(PR.W().rowsBetween(Window.unboundedPreceding, -1))  # the known value before, past unknown ones
    d = d.withColumn("before", before).groupBy("ticker").agg((F.datediff(F.max("date"), F.min("date")) / 365.0).alias("years"), F.count_if(F.col("x") != F.col("before")).alias("changes"))
    return d.select("ticker", "changes", r6(F.col("changes") / F.greatest("years", F.lit(0.1))).alias("per_year"))


@query("bars_without_filings", "bars ary", "SELECT ticker, count(*) AS n FROM bars WHERE ticker NOT IN (SELECT ticker FROM ary) GROUP BY ticker")
def bars_without_filings(r):
    return r.bars.join(r.ary.select("ticker").distinct(), "ticker", "left_anti").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


_SEED = "concat_ws('|', CAST(ticker AS {t}), CAST(date AS {t}), action, '42')"


@query("event_sample_random", "actions", f"WITH clean AS ({CLEAN}) SELECT ticker, date, action FROM (SELECT DISTINCT ticker, date, action FROM clean) ORDER BY md5({_SEED.format(t='VARCHAR')}) LIMIT 10")
def event_sample_random(r):
    return U.clean_actions(r.actions).select("ticker", "date", "action").distinct().orderBy(F.md5(F.expr(_SEED.format(t="STRING")))).limit(10)


_FREQUENCIES = {"monthly": 1, "quarterly": 3, "annually": 12}


@query("rebalance_calendar", "bars", f"""WITH e AS (SELECT min(date) AS a, max(date) AS b FROM bars), m AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE)) AS day FROM e),
c AS ({' UNION ALL '.join(f"SELECT '{k}' AS frequency, day FROM m WHERE month(day) % {n} = 0" for k, n in _FREQUENCIES.items())}) SELECT frequency, day, lead(day) OVER (PARTITION BY frequency ORDER BY day) AS next_day FROM c""")
def rebalance_calendar(r):
    return HD.calendar(r.bars.agg(F.min("date").alias("a"), F.max("date").alias("b")))
