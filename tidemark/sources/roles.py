"""Role tables derived from the star-schema tables: bars, instruments, actions, filings and so on.

Every role is one SELECT in SQL that Spark and DuckDB read alike, so that tests and oracles
start from equal inputs. Money goes through whole cents, so sums do not depend on their order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .stages import Stages

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Role name -> (roles it reads, SELECT).
ROLES: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), """
SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_partkey, l_linenumber, l_quantity AS qty, l_returnflag, l_linestatus,
  CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents, CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS net_cents,
  CAST(floor(l_extendedprice * l_tax * 20 + 0.5) AS BIGINT) AS tax_cents, floor((l_extendedprice / l_quantity) * 1e4 + 0.501) / 1e4 AS px
FROM lineitem"""),
    "bars": (("lines",), """
SELECT ticker, date, max(px) AS high, min(px) AS low, CAST(sum(qty) AS DOUBLE) AS volume, floor((CAST(sum(cents) AS DOUBLE) / sum(qty) / 100) * 1e4 + 0.501) / 1e4 AS closeadj
FROM lines GROUP BY ticker, date"""),
    "spans": (("bars",), "SELECT ticker, min(date) AS firstpricedate, max(date) AS lastpricedate FROM bars GROUP BY ticker"),
    "instruments": (("spans",), """
SELECT s_suppkey AS ticker, CASE WHEN s_suppkey % 19 = 0 THEN concat(s_name, '.A') ELSE s_name END AS symbol,
  CASE s_suppkey % 8 WHEN 0 THEN 'NASDAQ' WHEN 1 THEN 'NYSEMKT' WHEN 7 THEN 'OTC' ELSE 'NYSE' END AS exchange,
  CASE WHEN s_suppkey % 13 = 0 THEN 'ETF' ELSE 'Domestic Common Stock' END AS category,
  CASE WHEN s_suppkey % 17 = 0 THEN 'CAD' ELSE ' usd ' END AS currency, CASE WHEN s_suppkey % 3 = 0 THEN 'Y' ELSE 'n' END AS isdelisted,
  r_name AS sector, n_name AS famaindustry, firstpricedate, lastpricedate
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN spans ON s_suppkey = ticker"""),
    "marked": (("lines",), """
SELECT ticker, date, l_orderkey, substr(o_orderpriority, 1, 1) AS p FROM lines JOIN orders ON l_orderkey = o_orderkey
WHERE l_linenumber = 1 AND o_orderkey % 23 = 0"""),
    "actions": (("marked", "spans"), """
SELECT ticker, date, CASE p WHEN '1' THEN ' AcquisitionBy' WHEN '2' THEN 'bankruptcyliquidation ' WHEN '3' THEN 'SPINOFF' WHEN '4' THEN 'tickerchangefrom' ELSE 'mergerfrom' END AS action,
  CASE WHEN p = '1' AND ticker % 2 = 0 THEN ticker + 1 END AS contraticker FROM marked
UNION ALL SELECT ticker, date, 'delisted' AS action, NULL AS contraticker FROM marked WHERE p <> '3' AND date >= DATE '2000-06-01'
UNION ALL SELECT ticker, lastpricedate, 'Delisted', NULL FROM spans WHERE ticker % 3 = 0
UNION ALL SELECT ticker, lastpricedate, CASE ticker % 5 WHEN 0 THEN 'acquisitionby' WHEN 1 THEN 'bankruptcyliquidation' WHEN 2 THEN 'regulatorydelisting' ELSE 'mergerfrom' END, NULL
  FROM spans WHERE ticker % 3 = 0 AND ticker % 5 <> 4"""),
    "quarters": (("lines",), """
SELECT ticker, last_day(CAST(CAST(date_trunc('quarter', date) AS DATE) + INTERVAL 2 MONTH AS DATE)) AS reportperiod,
  CAST(sum(net_cents) AS DOUBLE) / 100 AS revenue, CAST(sum(cents * (l_partkey % 13 - 2)) AS DOUBLE) / 1000 - CAST(sum(net_cents) AS DOUBLE) / 300 AS ncfo,
  CAST(sum(cents * (l_partkey % 11 - 2)) AS DOUBLE) / 1200 - CAST(sum(net_cents) AS DOUBLE) / 500 AS netinccmn, -CAST(sum(tax_cents) AS DOUBLE) / 100 AS capex, CAST(sum(qty) AS DOUBLE) * 100 AS shareswa,
  CAST(sum(l_partkey % 5) AS DOUBLE) / count(*) / 10 AS grossmargin
FROM lines GROUP BY 1, 2"""),
    "filed": (("quarters",), """
SELECT ticker, reportperiod, CAST(reportperiod + CAST(30 + ticker % 31 AS INT) AS DATE) AS datekey, CAST(1 AS DOUBLE) AS k FROM quarters
UNION ALL SELECT ticker, reportperiod, CAST(reportperiod + CAST(75 + ticker % 31 AS INT) AS DATE), CAST(1.01 AS DOUBLE) FROM quarters WHERE (ticker + year(reportperiod) * 4 + quarter(reportperiod)) % 16 = 0"""),
    "arq": (("quarters", "filed"), """
SELECT q.ticker, q.reportperiod, f.datekey, CASE WHEN (q.ticker + quarter(q.reportperiod)) % 37 = 0 THEN NULL ELSE ncfo * k END AS ncfo, CASE WHEN q.ticker % 23 = 1 THEN NULL ELSE capex * k END AS capex,
  revenue * k AS revenue, netinccmn * k AS netinccmn, shareswa, shareswa AS sharesbas, CASE WHEN q.ticker % 41 = 0 THEN NULL ELSE grossmargin END AS grossmargin, floor((netinccmn / revenue / 3) * 1e6 + 0.501) / 1e6 AS roic,
  revenue * 0.5 AS debt, revenue * 0.1 AS cashnequsd
FROM quarters q JOIN filed f ON q.ticker = f.ticker AND q.reportperiod = f.reportperiod"""),
    "ary": (("quarters",), """
SELECT ticker, CAST(concat(CAST(year(reportperiod) AS STRING), '-12-31') AS DATE) AS reportperiod, CAST(CAST(concat(CAST(year(reportperiod) AS STRING), '-12-31') AS DATE) + CAST(60 + ticker % 31 AS INT) AS DATE) AS datekey,
  CASE WHEN (ticker + year(reportperiod)) % 11 = 0 THEN NULL ELSE floor((sum(ncfo)) * 1e2 + 0.501) / 1e2 END AS ncfo, floor((sum(capex)) * 1e2 + 0.501) / 1e2 AS capex, floor((sum(revenue)) * 1e2 + 0.501) / 1e2 AS revenue, floor((sum(netinccmn)) * 1e2 + 0.501) / 1e2 AS netinccmn,
  floor((sum(netinccmn) / sum(revenue) / 3) * 1e6 + 0.501) / 1e6 AS roic, max(shareswa) AS sharesbas
FROM quarters WHERE ticker % 7 <> 0 GROUP BY 1, 2, 3, year(reportperiod)"""),
    "art": (("quarters",), """
SELECT ticker, reportperiod, CAST(reportperiod + CAST(30 + ticker % 31 AS INT) AS DATE) AS datekey, ncfo, capex, revenue, CASE WHEN ticker % 2 = 0 THEN revenue END AS revenueusd, netinccmn, shareswa, CASE WHEN ticker % 9 = 0 THEN NULL ELSE revenue * 1.2 END AS equity,
  revenue * 3 AS assets, revenue * 3 - revenue * 1.2 AS liabilities, CASE WHEN ticker % 10 = 0 THEN NULL ELSE revenue * 0.5 END AS debt, revenue * 0.1 AS cashnequsd, netinccmn * 1.5 AS ebitda, netinccmn * 1.2 AS ebt, revenue * 0.02 AS sbcomp,
  CASE WHEN ticker % 4 = 0 THEN 0.02 END AS divyield, CASE WHEN ticker % 2 = 0 THEN 0.5 ELSE 0 END AS dps, CASE WHEN ticker % 6 = 0 THEN 0.11 END AS roe, 1.5 AS currentratio, floor((netinccmn / shareswa) * 1e6 + 0.501) / 1e6 AS epsdil, rn
FROM (SELECT ticker, reportperiod, floor((sum(ncfo) OVER w) * 1e2 + 0.501) / 1e2 AS ncfo, floor((sum(capex) OVER w) * 1e2 + 0.501) / 1e2 AS capex, floor((sum(revenue) OVER w) * 1e2 + 0.501) / 1e2 AS revenue, floor((sum(netinccmn) OVER w) * 1e2 + 0.501) / 1e2 AS netinccmn, shareswa,
  row_number() OVER (PARTITION BY ticker ORDER BY reportperiod) AS rn FROM quarters WINDOW w AS (PARTITION BY ticker ORDER BY reportperiod ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE rn >= 4"""),
    "vendor": (("bars", "instruments"), """
SELECT b.ticker, b.date, closeadj * sum(volume) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS marketcap, CASE WHEN b.ticker % 5 = 0 THEN NULL ELSE floor((closeadj / 100) * 1e4 + 0.501) / 1e4 END AS pe,
  CASE WHEN b.ticker % 10 = 3 THEN NULL ELSE floor((closeadj / 500) * 1e4 + 0.501) / 1e4 END AS pb,
  CASE WHEN b.ticker % 4 = 1 THEN NULL ELSE floor((closeadj / 300) * 1e4 + 0.501) / 1e4 END AS ps, CASE WHEN b.ticker % 3 = 1 THEN NULL ELSE floor((closeadj / 90) * 1e4 + 0.501) / 1e4 END AS evebitda FROM bars b"""),
    "insider": (("lines",), """
SELECT ticker, CAST(date + 2 AS DATE) AS filingdate, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'M' END AS transactioncode, CASE WHEN l_linestatus = 'O' THEN ' y' ELSE 'N' END AS isofficer,
  CAST(qty AS DOUBLE) AS transactionshares, CAST(qty * l_linenumber * 10 AS DOUBLE) AS sharesownedbeforetransaction FROM lines WHERE l_linenumber <= 2"""),
    "holdings": (("lines",), """
SELECT ticker, last_day(CAST(CAST(date_trunc('quarter', date) AS DATE) + INTERVAL 2 MONTH AS DATE)) AS calendardate, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS shrholders, CAST(sum(qty) AS DOUBLE) AS shrunits, CAST(sum(cents) AS DOUBLE) / 100 AS shrvalue,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN qty ELSE 0 END) AS DOUBLE) AS cllunits, CAST(sum(CASE WHEN l_returnflag = 'R' THEN qty ELSE 0 END) AS DOUBLE) AS putunits
FROM lines JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""),
    "series": ((), """
SELECT CAST(o_orderdate AS DATE) AS date, floor((CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 1000000) * 1e6 + 0.501) / 1e6 AS value FROM orders GROUP BY 1"""),
    "rates": ((), """
SELECT date, series, value - CASE WHEN series = 'yield_curve' THEN 1.5 ELSE 0 END AS value FROM (
  SELECT CAST(o_orderdate AS DATE) AS date, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'yield_curve' WHEN '2' THEN 'hy_spread' WHEN '3' THEN 'ig_spread' WHEN '4' THEN 'fed_funds' ELSE 'dgs10' END AS series,
    floor((CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 10000000) * 1e6 + 0.501) / 1e6 AS value FROM orders GROUP BY 1, 2) x"""),
    "cpi": ((), """
SELECT last_day(CAST(o_orderdate AS DATE)) AS date, floor((CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 100000) * 1e6 + 0.501) / 1e6 AS value FROM orders GROUP BY 1"""),
    "splits": (("marked",), "SELECT DISTINCT ticker, date, CAST(2 + l_orderkey % 9 AS DOUBLE) AS value FROM marked WHERE p = '3'"),
    "vintages": (("series",), """
SELECT observation_date, CAST(observation_date + 15 AS DATE) AS vintage_date, value FROM (SELECT last_day(date) AS observation_date, floor((sum(value) / count(*)) * 1e6 + 0.501) / 1e6 AS value FROM series GROUP BY 1)
UNION ALL SELECT observation_date, CAST(observation_date + 45 AS DATE), floor((value * 1.01) * 1e6 + 0.501) / 1e6 FROM (SELECT last_day(date) AS observation_date, floor((sum(value) / count(*)) * 1e6 + 0.501) / 1e6 AS value FROM series GROUP BY 1)"""),
    "benchmark_bars": (("bars",), "SELECT date, floor((CAST(sum(CAST(floor(closeadj * 10000 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 10000) * 1e4 + 0.501) / 1e4 AS closeadj FROM bars GROUP BY date"),
}


def needed(names: tuple[str, ...]) -> list[str]:
    """The roles to define for ``names``, dependencies first."""
    out: list[str] = []
    for n in names:
        for m in (*needed(ROLES[n][0]), n):
            if m not in out:
                out.append(m)
    return out


def ctes(*names: str) -> str:
    """The roles as the head of a DuckDB query."""
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({ROLES[n][1]})" for n in needed(names)).replace("AS STRING)", "AS VARCHAR)")


class Roles:
    """The role DataFrames of one data folder; each is lazy and built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._found = spark, sf_dir, {}
        self._stages, self._kept = None, set()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def put(self, name: str, frame: DataFrame) -> None:
        """Use ``frame``, for instance a written table, for a role from now on, also in roles that read it."""
        self._found[name] = frame

    def keep(self, *names: str) -> Stages:
        """Writes the named roles, those that others read first, and uses the tables from then on: what reads a role several times neither
        scans nor aggregates the lines again, and steps by entity need no exchange. A role is written once a run."""
        if self._stages is None:
            self._stages = Stages(self.spark)
        for name in names:
            if name not in self._kept:
                self.put(name, self._stages.write(name, self.dealt(name)))
                self._kept.add(name)
        return self._stages

    def dealt(self, name: str) -> DataFrame:
        """The named role, not written: one made of lines has these dealt by entity as they are read, which is its only exchange."""
        if "lines" not in ROLES[name][0] or name in self._found:
            return getattr(self, name)
        stages = self.keep()
        source = Roles(self.spark, self.sf_dir)
        source.put("lines", self.lines.repartition(stages.buckets, stages.key))
        return getattr(source, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in ROLES:
            raise AttributeError(name)
        if name not in self._found:
            reads, text = ROLES[name]
            frames = {r: getattr(self, r) for r in reads}
            frames |= {t: self.table(t) for t in TABLES if f" {t} " in f" {text} ".replace("\n", " ")}
            named = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(frames)})\b", r"\1 {\2}", text)
            self._found[name] = self.spark.sql(named, **frames)  # no view is left in the caller's session
        return self._found[name]
