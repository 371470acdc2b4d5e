"""Stage tables: what several later steps read is written once, bucketed by entity and sorted by date.

Tables of one `Stages` have the same buckets, so joins of them on the entity (and a date besides), windows and aggregates by
entity need no exchange. A table can be partitioned by year too, for readers of a date range. A profile, and what it must
satisfy, is taken while a table is written, in the same pass.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Whether a join on several keys wants its sides dealt by all of them; sides that are dealt by the entity meet anyway.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Whether what a query exchanged is removed from the disks when it ends, and not when the driver comes to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class StageError(AssertionError):
    """A written table does not satisfy what was expected of it."""


def satisfied(name: str, profile: dict, expect: dict[str, tuple[str, float | None, float | None]]) -> None:
    """Raises `StageError` where a value of the profile lies outside (what is wrong outside, lowest, highest)."""
    for k, (wrong, lo, hi) in expect.items():
        v = profile[k]
        if v is None or lo is not None and v < lo or hi is not None and v > hi:
            raise StageError(f"{name}: {wrong} ({k} = {v})")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one process (tests) gets a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        sc.setCheckpointDir(found)
    return found


@contextmanager
def _with(spark: SparkSession, **settings: str) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def dealt_by_entity(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, joins on (entity, date) use a partitioning by entity alone."""
    return _with(spark, **{_ALL_KEYS: "false"})


class Stages:
    """The stage tables of one run, in ``root`` (the session's shared folder if None), with ``buckets`` buckets (the number of shuffle partitions if None)."""

    def __init__(self, spark: SparkSession, key: str = "ticker", order: str = "date", buckets: int | None = None, root: str | None = None):
        self.spark, self.key, self.order = spark, key, order
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = root or shared_dir(spark)
        #: Name -> profile of each table that was written with one.
        self.profiles: dict[str, dict] = {}

    def write(self, name: str, df: DataFrame, by_year: bool = False, profile: dict[str, Column] | None = None, expect: dict[str, tuple[str, float | None, float | None]] | None = None) -> DataFrame:
        """``df`` as a written table. ``profile`` names aggregates that are taken on the way; ``expect`` bounds some of them, (what is
        wrong outside, lowest, highest), and a value outside raises `StageError` once the table is there."""
        table = f"{name}_{uuid.uuid4().hex}"
        order = [self.key] + [self.order] * (self.order in df.columns)
        d = df.repartition(self.buckets, self.key)
        seen = Observation(table)
        if profile:
            d = d.observe(seen, *[c.alias(k) for k, c in profile.items()])
        out = d.withColumn("year", F.year(self.order)).write.partitionBy("year") if by_year else d.write
        with _with(self.spark, **{_ALL_KEYS: "false", _CLEAN: "true"}):
            out.format("parquet").option("path", f"{self.root}/{table}").bucketBy(self.buckets, self.key).sortBy(*order).saveAsTable(table)
        if profile:
            self.profiles[name] = found = seen.get
            satisfied(name, found, expect or {})
        return self.spark.table(table)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of the shared folder, for what is read more than once and not by entity."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    with _with(df.sparkSession, **{_CLEAN: "true"}):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_ordered(df: DataFrame, path: str, *order: str) -> None:
    """``df`` as Parquet files in the given order, across files and within them: a range exchange, no single task."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
