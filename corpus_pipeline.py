"""A training corpus in five stages, each one operator of ``llm`` on all that the stage before kept.

Every stage but the last returns the columns of ``documents``. Language ID drops texts without a
recognised language; line dedup cuts later copies of lines, and drops a document of which no
word is left; of each group of near duplicates the one with the smallest id stays; documents that
hold a test item go; the last stage encodes and decodes what is left. Rows with a null id
pass the stages that compare documents. Null, empty and blank texts have no language and go at the first stage;
rows repeated under one id are one document for the third stage, which keeps one of them. Texts are read whole at every length, an empty
table passes as one, and columns besides those of ``documents`` are dropped at the start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.bpe import tokenize
from llm.decontaminate import without_contaminated
from llm.language_id import recognised, train
from llm.line_dedup import dedup_lines
from llm.near_duplicates import near_duplicates
from llm.tables import crc_mod, read, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts whose best language is less likely than this are no language of the corpus.
LEAST_LIKELY = 0.30


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs.where(crc_mod("doc_id", 5) != 0))
    return recognised(docs.select(*COLUMNS), model, LEAST_LIKELY)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = dedup_lines(docs.select(*COLUMNS))
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = near_duplicates(docs)
    stay = found.where("component_id = doc_id").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", "lang", "source")
    kept = docs.where("doc_id is not null").join(stay, "doc_id", "left_semi").withColumn("_k", F.row_number().over(one)).where("_k = 1")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenize(docs, ["doc_id", "lang", "source", "n_chars"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]
#: Set-similarity joins, a trained classifier and BPE have no SQL form; their operators are tested against brute force, the stages on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs
