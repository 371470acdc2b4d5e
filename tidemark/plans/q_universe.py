"""Queries: universe, terminal events and forward labels."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import active_on as active
from ..functions.columns import q6, r6
from ..operators import universe as U
from ..operators.asof import interval_join, next_event_within
from ..registry import query
from ..sources.inputs import optional_table

CLEAN = "SELECT ticker, CAST(date AS DATE) AS date, lower(trim(action)) AS action, contraticker FROM actions"
_REASONS = ", ".join(f"'{x}'" for x in U.REASONS)
RAW = f"""clean AS ({CLEAN}),
gone AS (SELECT DISTINCT ticker, date FROM clean WHERE action = 'delisted'),
why AS (SELECT DISTINCT ticker, date, action AS reason FROM clean WHERE action IN ({_REASONS})),
raw AS (SELECT g.ticker, g.date, coalesce(reason, 'unknown') AS reason FROM gone g LEFT JOIN why w ON g.ticker = w.ticker AND g.date = w.date)"""
TERMINAL = RAW + """,
terminal AS (SELECT ticker, date, reason FROM raw r WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.ticker = r.ticker AND c.action = 'tickerchangefrom' AND abs(datediff('day', r.date, c.date)) <= 5)
  QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY CASE reason WHEN 'bankruptcyliquidation' THEN 1 WHEN 'regulatorydelisting' THEN 2 WHEN 'voluntarydelisting' THEN 3 WHEN 'acquisitionby' THEN 4 WHEN 'mergerfrom' THEN 5 ELSE 6 END) = 1),
removed AS (SELECT ticker, min(date) AS removed FROM terminal WHERE reason <> 'mergerfrom' GROUP BY ticker)"""
ELIGIBLE = "SELECT * FROM instruments WHERE exchange IN ('NYSE', 'NASDAQ', 'NYSEMKT') AND category = 'Domestic Common Stock' AND symbol NOT LIKE '%.%' AND upper(trim(currency)) = 'USD'"
CORE = TERMINAL + f""",
core AS (SELECT b.ticker, b.date, closeadj, sector, famaindustry, datediff('day', firstpricedate, b.date) AS days_listed FROM bars b JOIN ({ELIGIBLE}) i ON b.ticker = i.ticker LEFT JOIN removed r ON b.ticker = r.ticker
  WHERE firstpricedate <= b.date AND (lastpricedate IS NULL OR lastpricedate >= b.date) AND (removed IS NULL OR removed > b.date))"""


@query("scan_roles", "bars instruments actions", "SELECT 'bars' AS role, count(*) AS n FROM bars UNION ALL SELECT 'instruments', count(*) FROM instruments UNION ALL SELECT 'actions', count(*) FROM actions")
def scan_roles(r):
    one = lambda n: getattr(r, n).agg(F.lit(n).alias("role"), F.count(F.lit(1)).alias("n"))
    return one("bars").unionByName(one("instruments")).unionByName(one("actions"))


@query("instruments_eligible", "instruments", f"SELECT ticker, symbol, sector FROM ({ELIGIBLE})")
def instruments_eligible(r):
    return U.eligible(r.instruments).select("ticker", "symbol", "sector")


@query("listed_entities", "instruments", "SELECT ticker FROM instruments WHERE upper(coalesce(isdelisted, 'N')) = 'N'")
def listed_entities(r):
    return U.listed(r.instruments).join(r.bars.select("ticker"), "ticker", "left_semi").select("ticker")


@query("actions_clean", "actions", CLEAN)
def actions_clean(r):
    return U.clean_actions(r.actions).select("ticker", "date", "action", "contraticker")


@query("terminal_events_raw", "actions", f"WITH {RAW} SELECT * FROM raw")
def terminal_events_raw(r):
    return U.terminal_events_raw(U.clean_actions(r.actions))


@query("terminal_events", "actions", f"WITH {TERMINAL} SELECT * FROM terminal")
def terminal_events(r):
    return U.terminal_events(U.clean_actions(r.actions))


@query("removal_per_ticker", "actions", f"WITH {TERMINAL} SELECT * FROM removed")
def removal_per_ticker(r):
    return U.removals(U.terminal_events(U.clean_actions(r.actions)))


@query("active_on_date", "bars instruments actions", f"WITH {TERMINAL} SELECT i.ticker, coalesce(firstpricedate <= DATE '2000-06-30' AND lastpricedate >= DATE '2000-06-30' AND (removed IS NULL OR removed > DATE '2000-06-30'), false) AS active FROM instruments i LEFT JOIN removed r ON i.ticker = r.ticker")
def active_on_date(r):
    d = r.instruments.join(U.removals(U.terminal_events(U.clean_actions(r.actions))), "ticker", "left")
    return d.select("ticker", F.coalesce(active("firstpricedate", "lastpricedate", "removed", F.lit("2000-06-30").cast("date")), F.lit(False)).alias("active"))


@query("universe_core", "bars instruments actions", f"WITH {CORE} SELECT * FROM core")
def universe_core(r):
    return U.core(r.bars, r.instruments, U.removals(U.terminal_events(U.clean_actions(r.actions))))


SPIN = "coalesce((SELECT bool_or(true) FROM clean a WHERE a.action = 'spinoff' AND a.ticker = c.ticker AND a.date > c.date AND a.date <= c.date + 60), false)"


@query("fwd_event_flag", "bars actions", f"WITH clean AS ({CLEAN}) SELECT c.ticker, c.date, bool_or(a.date IS NOT NULL) AS fwd_spinoff_60d FROM bars c LEFT JOIN clean a ON a.action = 'spinoff' AND a.ticker = c.ticker AND a.date > c.date AND a.date <= c.date + 60 GROUP BY ALL")
def fwd_event_flag(r):
    return next_event_within(r.bars.select("ticker", "date"), U.clean_actions(r.actions).where("action = 'spinoff'"), "ticker", "date", "date", 60, "fwd_spinoff_60d")


_TIER = "CASE WHEN marketcap IS NULL THEN NULL WHEN marketcap::BIGINT < 50000000 THEN 1 WHEN marketcap::BIGINT < 300000000 THEN 2 WHEN marketcap::BIGINT < 2000000000 THEN 3 WHEN marketcap::BIGINT < 10000000000 THEN 4 WHEN marketcap::BIGINT < 200000000000 THEN 5 ELSE 6 END"
UNIVERSE = f"""flagged AS (SELECT c.ticker, c.date, bool_or(a.date IS NOT NULL) AS s FROM core c LEFT JOIN clean a ON a.action = 'spinoff' AND a.ticker = c.ticker AND a.date > c.date AND a.date <= c.date + 60 GROUP BY ALL),
universe AS MATERIALIZED (SELECT c.*, f.s AS fwd_spinoff_60d, marketcap::BIGINT AS marketcap_daily, {_TIER} AS scalemarketcap, true AS in_universe FROM core c JOIN flagged f ON c.ticker = f.ticker AND c.date = f.date LEFT JOIN vendor v ON c.ticker = v.ticker AND c.date = v.date)"""


@query("daily_universe", "bars instruments actions vendor", f"WITH {CORE}, {UNIVERSE} SELECT * FROM universe")
def daily_universe(r):
    return U.daily_universe(r.bars, r.instruments, r.actions, r.vendor)


@query("fwd_price_n", "bars", "SELECT ticker, date, lead(closeadj, 21) OVER (PARTITION BY ticker ORDER BY date) AS fwd_price_21 FROM bars")
def fwd_price_n(r):
    return r.bars.select("ticker", "date", F.lead("closeadj", 21).over(Window.partitionBy("ticker").orderBy("date")).alias("fwd_price_21"))


@query("terminal_row", "bars", "SELECT ticker, date, arg_max(closeadj, date) OVER (PARTITION BY ticker) AS last_price, max(date) OVER (PARTITION BY ticker) AS last_date FROM bars")
def terminal_row(r):
    w = Window.partitionBy("ticker")
    return r.bars.select("ticker", "date", F.max_by("closeadj", "date").over(w).alias("last_price"), F.max("date").over(w).alias("last_date"))


_L = ", ".join(
    f"{q6(f'CASE WHEN p{n} IS NOT NULL THEN p{n} / closeadj - 1 WHEN rank < last_rank THEN last_price / closeadj - 1 END')} AS fwd_ret_{n}td, "
    f"CASE WHEN p{n} IS NOT NULL THEN {n} WHEN rank < last_rank THEN last_rank - rank END AS fwd_holding_days_{n}td, "
    f"CASE WHEN p{n} IS NOT NULL THEN false WHEN rank < last_rank AND reason IS NOT NULL THEN reason <> 'mergerfrom' END AS fwd_delisted_{n}td, "
    f"CASE WHEN p{n} IS NULL AND reason <> 'mergerfrom' THEN reason END AS fwd_delist_type_{n}td"
    for n in U.HORIZONS
)
LABELS = f""", ranked AS (SELECT *, {', '.join(f'lead(closeadj, {n}) OVER (PARTITION BY ticker ORDER BY date) AS p{n}' for n in U.HORIZONS)}, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rank,
  count(*) OVER (PARTITION BY ticker) AS last_rank, arg_max(closeadj, date) OVER (PARTITION BY ticker) AS last_price, max(date) OVER (PARTITION BY ticker) AS last_date FROM bars WHERE closeadj > 0),
labels AS (SELECT k.ticker, k.date, {_L} FROM ranked k LEFT JOIN terminal t ON k.ticker = t.ticker AND k.last_date = t.date)"""


@query("forward_labels", "bars actions", f"WITH {TERMINAL}{LABELS} SELECT * FROM labels")
def forward_labels(r):
    d = U.forward_labels(r.bars, U.terminal_events(U.clean_actions(r.actions)))
    return d.select(*[r6(c).alias(c) if c.startswith("fwd_ret") else c for c in d.columns])


@query("semi_grid", "bars instruments", f"SELECT * FROM bars WHERE ticker IN (SELECT ticker FROM ({ELIGIBLE}))")
def semi_grid(r):
    return r.bars.join(U.eligible(r.instruments), "ticker", "left_semi")


@query("empty_relation", "bars", "SELECT ticker, date, closeadj, NULL::DOUBLE AS override, closeadj AS used FROM bars")
def empty_relation(r):
    """Bars with the prices of a table of corrections, which is absent here and so is a typed empty one."""
    own = optional_table(r.spark, f"{r.sf_dir}/corrections.parquet", "ticker long, date date, override double")
    return r.bars.join(own, ["ticker", "date"], "left").select("ticker", "date", "closeadj", "override", F.coalesce("override", "closeadj").alias("used"))


# --- events


@query("event_overview", "actions", f"WITH clean AS ({CLEAN}) SELECT action, count(*) AS n, count(DISTINCT ticker) AS tickers, min(date) AS first_date, max(date) AS last_date FROM clean GROUP BY action")
def event_overview(r):
    return U.clean_actions(r.actions).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("event_samples", "actions", f"WITH clean AS ({CLEAN}) SELECT DISTINCT action, ticker, date, k FROM (SELECT *, dense_rank() OVER (PARTITION BY action ORDER BY date DESC, ticker) AS k FROM clean) WHERE k <= 5")
def event_samples(r):
    w = Window.partitionBy("action").orderBy(F.desc("date"), "ticker")
    return U.clean_actions(r.actions).withColumn("k", F.dense_rank().over(w).cast("long")).where("k <= 5").select("action", "ticker", "date", "k").distinct()


_GAP = "SELECT reason, t.ticker, datediff('day', last_date, t.date) AS gap FROM terminal t JOIN (SELECT ticker, max(date) AS last_date FROM bars GROUP BY ticker) b ON t.ticker = b.ticker"


@query("event_gap_stats", "bars actions", f"WITH {TERMINAL} SELECT reason, count(*) AS n, {q6('avg(gap)')} AS mean_gap, CAST(median(gap) AS DOUBLE) AS median_gap, min(gap) AS min_gap, max(gap) AS max_gap, count(*) FILTER (gap > 5) AS late, count(*) FILTER (gap < 0) AS early FROM ({_GAP}) GROUP BY reason")
def event_gap_stats(r):
    d = U.terminal_events(U.clean_actions(r.actions)).join(r.bars.groupBy("ticker").agg(F.max("date").alias("last_date")), "ticker").withColumn("gap", F.datediff("date", "last_date").cast("long"))
    return d.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("gap")).alias("mean_gap"), F.median("gap").alias("median_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.count_if(F.col("gap") > 5).alias("late"), F.count_if(F.col("gap") < 0).alias("early"))


@query("event_price_window", "bars", "SELECT ticker, date, closeadj FROM bars b WHERE date > (SELECT max(date) FROM bars c WHERE c.ticker = b.ticker) - 60")
def event_price_window(r):
    d = r.bars.withColumn("last", F.max("date").over(Window.partitionBy("ticker")))
    return d.where(F.col("date") > F.date_sub("last", 60)).select("ticker", "date", "closeadj")


@query("event_counterparty", "bars actions", f"WITH clean AS ({CLEAN}) SELECT a.ticker, a.date AS event_date, a.contraticker, b.date, b.closeadj FROM clean a JOIN bars b ON a.contraticker = b.ticker AND b.date BETWEEN a.date - 5 AND a.date + 5")
def event_counterparty(r):
    """The other side's bars within five days of an event."""
    a = U.clean_actions(r.actions).where("contraticker is not null").select("ticker", F.col("date").alias("event_date"), "contraticker", F.date_sub("date", 5).alias("a"), F.date_add("date", 5).alias("b"))
    b = r.bars.select(F.col("ticker").alias("contraticker"), "date", "closeadj")
    return interval_join(b, a, "contraticker", "date", "a", "b", 11).select("ticker", "event_date", "contraticker", "date", "closeadj")


_TERMINAL_ROWS = (1, 21, 63, 252)
_OVER = ", ".join(f"{q6(f'{f}(CASE WHEN p{n} > 0 THEN p1 / p{n} - 1 END)')} AS {k}_ret_{n}" for n in _TERMINAL_ROWS[1:] for k, f in (("mean", "avg"), ("median", "median")))


@query("terminal_returns", "bars actions", f"WITH clean AS ({CLEAN}), p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars), x AS (SELECT ticker, {', '.join(f'max(CASE WHEN rn = {n} THEN closeadj END) AS p{n}' for n in _TERMINAL_ROWS)} FROM p GROUP BY ticker) SELECT action, count(*) AS n, {_OVER} FROM (SELECT DISTINCT ticker, action FROM clean WHERE action IN ('delisted', {_REASONS})) t JOIN x USING (ticker) GROUP BY action")
def terminal_returns(r):
    """By kind of event, the mean and median return of entities from their 21st, 63rd and 252nd last bar to the last."""
    p = r.bars.withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))))
    x = p.groupBy("ticker").agg(*[F.max(F.when(F.col("rn") == n, F.col("closeadj"))).alias(f"p{n}") for n in _TERMINAL_ROWS])
    t = U.clean_actions(r.actions).where(F.col("action").isin("delisted", *U.REASONS)).select("ticker", "action").distinct().join(x, "ticker")
    over = lambda n: F.when(F.col(f"p{n}") > 0, F.col("p1") / F.col(f"p{n}") - 1)
    return t.groupBy("action").agg(F.count(F.lit(1)).alias("n"), *[r6(f(over(n))).alias(f"{k}_ret_{n}") for n in _TERMINAL_ROWS[1:] for k, f in (("mean", F.avg), ("median", F.median))])


@query("terminal_value", "bars actions vendor", f"WITH clean AS ({CLEAN}), l AS (SELECT v.ticker, max(v.date) AS last_date, arg_max(closeadj, v.date) AS last_price, arg_max(marketcap, v.date) AS marketcap FROM vendor v JOIN bars b ON v.ticker = b.ticker AND v.date = b.date GROUP BY v.ticker) SELECT DISTINCT c.ticker, action, c.date AS event_date, last_date, last_price, {q6('marketcap / 1e6')} AS last_value_m, datediff('day', last_date, c.date) AS days_after FROM clean c JOIN l USING (ticker) WHERE action IN ('acquisitionby', 'mergerfrom')")
def terminal_value(r):
    """Acquisitions and mergers beside the entity's last price and capitalisation in millions."""
    last = r.vendor.select("ticker", "date", "marketcap").join(r.bars.select("ticker", "date", "closeadj"), ["ticker", "date"]).groupBy("ticker")
    last = last.agg(F.max("date").alias("last_date"), F.max_by("closeadj", "date").alias("last_price"), r6(F.max_by("marketcap", "date") / 1e6).alias("last_value_m"))
    a = U.clean_actions(r.actions).where(F.col("action").isin("acquisitionby", "mergerfrom")).select("ticker", "action", F.col("date").alias("event_date")).distinct()
    return a.join(last, "ticker").withColumn("days_after", F.datediff("event_date", "last_date").cast("long"))


_SURV = f"WITH {CORE}, b AS (SELECT ticker, date AS event_date FROM terminal WHERE reason = 'bankruptcyliquidation')"


@query("survivorship_detail", "bars instruments actions", f"{_SURV} SELECT b.ticker, event_date, c.date, closeadj FROM b JOIN core c ON c.ticker = b.ticker AND c.date BETWEEN event_date - 90 AND event_date - 1")
def survivorship_detail(r):
    a = U.clean_actions(r.actions)
    e = U.terminal_events(a).where("reason = 'bankruptcyliquidation'").select("ticker", F.col("date").alias("event_date"))
    c = U.core(r.bars, r.instruments, U.removals(U.terminal_events(a))).select("ticker", "date", "closeadj")
    e = e.withColumns({"a": F.date_sub("event_date", 90), "b": F.date_sub("event_date", 1)})
    return interval_join(c, e, "ticker", "date", "a", "b", 90).drop("a", "b")


@query("survivorship_summary", "bars instruments actions", f"{_SURV} SELECT b.ticker, event_date, count(c.date) AS days_covered, max(c.date) AS last_covered FROM b LEFT JOIN core c ON c.ticker = b.ticker AND c.date BETWEEN event_date - 90 AND event_date - 1 GROUP BY ALL")
def survivorship_summary(r):
    e = U.terminal_events(U.clean_actions(r.actions)).where("reason = 'bankruptcyliquidation'").select("ticker", F.col("date").alias("event_date"))
    return e.join(survivorship_detail(r), ["ticker", "event_date"], "left").groupBy("ticker", "event_date").agg(F.count("date").alias("days_covered"), F.max("date").alias("last_covered"))
