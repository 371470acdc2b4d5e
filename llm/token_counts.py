"""Token counts as delta-maintained rollups.

Totals are additive by (source, lang, version of the tokenizer). A batch is a set of signed rows:
an insert counts +1 document and +n tokens, a delete -1 and -n, a revision or a move is the
old row taken away and the new one added. Each batch is aggregated once (map-side first, so a hot
source is one row a task) and recorded under its own id in the ledger; recording an id again replaces
its sums, so a retried or repeated batch changes nothing. The totals are the sum of the
ledger, whose size depends on groups and batches, not on documents; `compact` folds old batches
into one.

Null source or language is a group of its own; a null or empty text has no token but is a
document. Repeated rows of a batch each count. Groups whose documents are all gone are dropped.
Texts of any length are counted whole; an empty batch is recorded and changes nothing, and a ledger without batches has no totals.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read, shared_dir

#: How each tokenizer version counts: the pattern of a token.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "marks-2": r"[\p{L}\p{M}]+|\p{N}|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]"}
GROUP = ("source", "lang", "version")


def signed(rows: DataFrame, sign: int, text: str | Column = "text") -> DataFrame:
    """(source, lang, version, docs, tokens) of rows, each counted ``sign`` times in every version."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    counts = F.array(*[F.struct(F.lit(v).alias("version"), (F.regexp_count(t, F.lit(p)) * sign).cast("long").alias("tokens")) for v, p in VERSIONS.items()])
    return rows.select("source", "lang", F.explode(counts).alias("x")).select("source", "lang", "x.version", F.lit(sign).cast("long").alias("docs"), "x.tokens")


class Ledger:
    """The committed batches of one rollup, in a folder that all executors share.

    What is committed stands in the folder itself: every change writes a manifest of the next number
    (the live folder of each batch, the base, the folded ids), and the newest one counts. So another
    ledger of the same path, in this session or a later one, goes on where the last one stopped; what
    a failed write left is in no manifest. Ids folded by ``compact`` are remembered and ignored."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._manifest()

    def _manifest(self) -> tuple[int, dict]:
        """The number and content of the newest manifest."""
        if not self._fs.exists(self._at(self.path)):
            return 0, {"live": {}, "base": None, "folded": []}
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(self.path))]
        number = max((int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-")), default=0)
        if not number:
            return 0, {"live": {}, "base": None, "folded": []}
        file = self._fs.open(self._at(f"{self.path}/manifest-{number}"))
        try:
            return number, json.loads(bytes(file.readAllBytes()).decode())
        finally:
            file.close()

    def _publish(self, number: int, manifest: dict) -> None:
        """Make ``manifest`` the newest one: written aside, then renamed, so it is there whole or not at all."""
        aside, at = self._at(f"{self.path}/.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifest-{number}")
        file = self._fs.create(aside)
        file.write(bytearray(json.dumps(manifest).encode()))
        file.close()
        if self._fs.exists(at) or not self._fs.rename(aside, at):
            raise RuntimeError(f"another writer committed to {self.path}")

    def _write(self, sums: DataFrame) -> str:
        folder = f"sums-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, batch: str, delta: DataFrame) -> None:
        """Record a batch of signed rows; an id that is there already is replaced by the same sums, a folded one is ignored."""
        number, m = self._manifest()
        if batch in m["folded"]:
            return
        m["live"][batch] = self._write(delta.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))
        self._publish(number + 1, m)

    def _sums(self, m: dict) -> DataFrame:
        folders = [*m["live"].values(), *([m["base"]] if m["base"] else [])]
        if folders:
            rows = self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])
        else:
            rows = self.spark.createDataFrame([], "source string, lang string, version string, docs long, tokens long")
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        sums = self._sums(self._manifest()[1]).where("docs <> 0")
        return sums.select(*GROUP, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))

    def compact(self, batch: str) -> None:
        """Fold everything committed so far into the base, under the id ``batch``; the folded ids are ignored from now on."""
        number, m = self._manifest()
        folded = sorted({*m["folded"], *m["live"], batch})
        self._publish(number + 1, {"live": {}, "base": self._write(self._sums(m)), "folded": folded})


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted; then every 10th deleted, every 7th revised (symbols cut), every 11th moved
    to source 'archive'; and the batch of deletes sent once more. A document without an id is inserted and stays as it is."""
    docs = read(spark, sf_dir, "documents")
    ledger = Ledger(spark)
    ledger.commit("insert", signed(docs, 1))
    left = docs.where("doc_id % 10 <> 3")
    ledger.commit("delete", signed(docs.where("doc_id % 10 = 3"), -1))
    revised = left.where("doc_id % 7 = 2")
    ledger.commit("revise", signed(revised, -1).unionByName(signed(revised, 1, F.regexp_replace("text", r"[#*$%&|<>]+", ""))))
    moved = left.where("doc_id % 7 <> 2 and doc_id % 11 = 5")
    ledger.commit("move", signed(moved, -1).unionByName(signed(moved.withColumn("source", F.lit("archive")), 1)))
    ledger.commit("delete", signed(docs.where("doc_id % 10 = 3"), -1))
    return ledger.totals()


ORACLE = r"""
WITH d AS (SELECT CASE WHEN doc_id % 7 <> 2 AND doc_id % 11 = 5 THEN 'archive' ELSE source END AS source, lang,
  coalesce(CASE WHEN doc_id % 7 = 2 THEN regexp_replace(text, '[#*$%&|<>]+', '', 'g') ELSE text END, '') AS t
  FROM documents WHERE doc_id % 10 IS DISTINCT FROM 3),
n AS (SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS k FROM d
  UNION ALL SELECT source, lang, 'marks-2', len(regexp_extract_all(t, '[\p{L}\p{M}]+|\p{N}|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]')) FROM d)
SELECT source, lang, version, count(*) AS n_docs, sum(k)::BIGINT AS n_tokens FROM n GROUP BY ALL
"""
