"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of 1 to 3 characters (code points, A-Z folded, digits alike) of *every* eligible document in its own task
(`numpy.bincount` per language) and sums them in Spark, so the model covers the whole corpus.
The model holds every language, in (buckets x languages) log-probability matrices of at most
`LANGUAGES_AT_ONCE` languages; it grows with the number of languages (0.26 MB each), not of documents.
Scoring takes each text's n-grams as a sparse row and adds matrix rows in numpy, a matrix at a time.
N-grams end with their text, so a text's score is the same beside any other texts.

Null text, or a text without a letter, is ``und`` with score 0. Long texts are scored whole,
in pieces of bounded size. A corpus with nothing to learn from gives ``und`` for every row, an empty table no rows. Ties go to
the first language by name. Repeated rows count as often as they are there; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .tables import crc_mod, read

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
LANGUAGES_AT_ONCE = 256
SMOOTHING = 0.5

Model = tuple[list[str], list[np.ndarray]]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[0x09:0x0E] = 0x20
_LOWER[0x30:0x3A] = 0x30
_START, _NEXT, _LAST = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0x2C1B3C6D)


def characters(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each character of UTF-8 rows laid end to end, offsets of the rows among them): the character's bytes, folded."""
    x = _LOWER[raw].astype(np.uint32)
    inside = (raw & 0xC0) == 0x80
    at = np.flatnonzero(~inside)
    code, more, n = x[at], np.ones(len(at), bool), len(raw)
    for k in range(1, 4):
        following = at + k
        more &= following < n
        more[more] = inside[following[more]]
        code[more] = (code[more] << np.uint32(8)) | x[following[more]]
    return code, np.searchsorted(at, off)


def gram_buckets(chars: np.ndarray, off: np.ndarray, order: int, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of the n-gram that starts at each character, with spaces past the end of its row ``off[i]:off[i + 1]``."""
    n = len(chars)
    x = np.concatenate([chars, np.full(order - 1, 0x20, np.uint32)])
    code = (chars + np.uint32(order << 24)) * _START
    for j in range(1, order):
        following = x[j : n + j].copy()
        for d in range(1, j + 1):  # the last characters of a row see none of the next
            last = off[1:] - d
            following[last[last >= off[:-1]]] = 0x20
        code = (code ^ (code >> np.uint32(15))) * _NEXT + following * _START
    code ^= code >> np.uint32(15)
    return (code * _LAST) >> np.uint32(32 - int(buckets).bit_length() + 1)


def _cells(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, counts in total.items():
        some = np.flatnonzero(counts)
        for at in range(0, len(some), 1 << 16):
            s = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(s)), "bucket": s.astype(np.int32), "n": counts[s].astype(np.int64)})


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        raw, off = words.text_bytes(b.column("text"))
        langs = np.asarray(b.column("lang").to_pylist(), object)
        for i, j in words.pieces(off, 1 << 20):
            part, po = characters(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            names, code = np.unique(langs[i:j].astype(str), return_inverse=True)
            at = np.repeat(code.astype(np.int64), np.diff(po))
            for k in ORDERS:
                cell = at * buckets + gram_buckets(part, po, k, buckets)
                if len(names) <= 16:
                    n = np.bincount(cell)
                    cell = np.flatnonzero(n)
                    n = n[cell]
                else:
                    cell, n = np.unique(cell, return_counts=True)
                cut = np.searchsorted(cell, np.arange(len(names) + 1) * buckets)
                for m, name in enumerate(names):
                    if name not in total:
                        total[name] = np.zeros(buckets, np.int64)
                    total[name][cell[cut[m] : cut[m + 1]] - m * buckets] += n[cut[m] : cut[m + 1]]
                    if len(total) > LANGUAGES_AT_ONCE:  # sums are added up by Spark
                        yield from _cells(total)
                        total.clear()
    yield from _cells(total)


def train(docs: DataFrame, buckets: int = BUCKETS, at_once: int = LANGUAGES_AT_ONCE) -> Model:
    """(languages, log-probability matrices of ``at_once`` languages each) from the rows of ``docs`` with text and lang."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = (
        rows.mapInArrow(lambda it: _count(it, buckets), "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    langs: list[str] = []
    blocks: list[np.ndarray] = []
    block: list[np.ndarray] = []

    def done() -> None:
        m = np.stack(block, 1) + SMOOTHING
        blocks.append(np.log(m / m.sum(0)).astype(np.float32))
        block.clear()

    # at most ``buckets`` cells of a language reach the driver at once
    for r in counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).orderBy("lang").toLocalIterator():
        c = np.zeros(buckets)
        cells = np.array(r["cells"], np.int64).reshape(-1, 2)
        c[cells[:, 0]] = cells[:, 1]
        langs.append(r["lang"])
        block.append(c)
        if len(block) == at_once:
            done()
    if block:
        done()
    return langs, blocks


def _score(batches: Iterator[pa.RecordBatch], langs: list[str], blocks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = b.column("text")
        letters = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        raw, off = words.text_bytes(col)
        total, length = np.zeros((len(col), len(langs)), np.float64), np.zeros(len(col), np.int64)
        if langs:
            for i, j in words.pieces(off, 1 << 18):
                part, po = characters(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                length[i:j] = np.diff(po)
                full = np.flatnonzero(np.diff(po))
                if len(full):
                    for k in ORDERS:
                        gram, at = gram_buckets(part, po, k, len(blocks[0])), 0
                        for logp in blocks:
                            total[i + full, at : at + logp.shape[1]] += np.add.reduceat(logp[gram], po[full], axis=0, dtype=np.float64)
                            at += logp.shape[1]
        pred, score = np.full(len(col), "und", object), np.zeros(len(col))
        ok = letters & bool(langs)
        if ok.any():
            # the length-normalised posterior: a whole text's joint one is 0 or 1 almost always
            per = total[ok] / np.maximum(length[ok], 1)[:, None]
            per = np.exp(per - per.max(1, keepdims=True))
            per /= per.sum(1, keepdims=True)
            best = per.argmax(1)
            pred[ok] = np.asarray(langs, object)[best]
            score[ok] = per[np.arange(len(best)), best]
        keep = [b.column(c) for c in b.schema.names if c != "text"]
        names = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])


def identify(docs: DataFrame, model: Model, key: list[str]) -> DataFrame:
    """``key`` columns of ``docs`` with ``lang_pred`` and ``score`` of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.select(*key, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*key).schema)
    return cols.mapInArrow(lambda it: _score(it, *shared.value), f"{schema}, lang_pred string, score double")


def _recognised(batches: Iterator[pa.RecordBatch], langs: list[str], blocks: list[np.ndarray], least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, off = words.text_bytes(b.column("text"))
        for i, j in words.pieces(off, 1 << 22):
            part = b.slice(i, j - i)
            (found,) = _score(iter([part.select(["text"])]), langs, blocks)
            yield part.filter(pc.and_(pc.not_equal(found.column("lang_pred"), "und"), pc.greater_equal(found.column("score"), least)))


def recognised(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with a score of at least ``least``; texts pass once and in small batches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _recognised(it, *shared.value, least), docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(crc_mod("doc_id", 5) != 0))
    rows = docs.select("doc_id", "text", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"))  # without an id: neither held out nor learnt from
    return identify(rows, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
