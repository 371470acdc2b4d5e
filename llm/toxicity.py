"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two words counts the four-character subsequences they share, each weighted by
``DECAY`` to the power of the length it spans, up to ``SPAN`` characters; a marker stands before the
first. (A character beyond ASCII counts by its last bytes.) A word with inserted or left-out characters so stays close to the word it disguises. Its
subsequences are hashed into a fixed table, so kernel values are sparse dot products.

Letters that stand alone with single blanks between them are joined before scoring, so that a
spelled-out insult is one word. Insults broken into longer parts ("st upid") are not seen as one.

Training words come from the sentences of labelled texts: words that are much more frequent in toxic
texts than in clean ones against words that are not. Landmarks span the Nyström feature space
in which a linear machine with squared hinge loss is fitted. Because the kernel is a dot product of
sparse maps, the landmarks' weights fold into one table of subsequence weights, and a text
is scored by table lookups over all its words: nothing is sampled or cut there. The text's score is
a logistic function of its strongest word and of how many words are on the toxic side.

Labels come from at most ``TRAIN_ROWS`` labelled rows (documented bound, by a hash of the id); the
driver receives a bounded number of words and three numbers a training text. Null and
empty texts score as having no word. Without both labels, or without any telling word,
every score is the share of toxic rows. Repeated rows score alike; words of equal telling power are taken in order of
spelling; an empty table gives no rows; other columns are ignored. A row without an id is scored, and neither held out nor learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .quality_gam import training_rows
from .tables import crc_mod, read, stash

TRAIN_ROWS = 20_000
#: Clean words: the most frequent ones, and ones by hash.
FREQUENT_WORDS, OTHER_WORDS = 6_000, 20_000
TOXIC_WORDS = 600
LANDMARKS = 96
DECAY, SPAN = 0.7, 6
TABLE = 1 << 18
#: How surely (standard errors of the log odds) a training word must lean to toxic texts, and how
#: many times as often it must be in them as in clean ones.
SURE, TIMES = 3.0, 20

_LOW = np.arange(256, dtype=np.uint32)
_LOW[65:91] += 32
_STEPS = [(a, b, c, np.float32(DECAY ** (c + 1))) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]


def _marked(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all words with a marker before each, offsets)."""
    size = end - start + 1
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(off[-1]) + np.repeat(start - 1 - off[:-1], size)
    x = _LOW[raw[np.maximum(at, 0)]]
    x[off[:-1]] = 2
    return x, off


def _codes(x: np.ndarray, a: int, b: int, c: int) -> np.ndarray:
    n = len(x) - c
    code = (x[:n] << np.uint32(24)) | (x[a : n + a] << np.uint32(16)) | (x[b : n + b] << np.uint32(8)) | x[c:]
    code = code * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    return (code * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 18)


def _sizes(off: np.ndarray) -> np.ndarray:
    """The length of each word's map, which depends on how many subsequences of each span it has."""
    size = np.diff(off)
    square = sum(np.maximum(size - c, 0) * float(w) ** 2 for _, _, c, w in _STEPS)
    return np.sqrt(np.maximum(square, 1e-9))


def _compact(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text without the first bytes of characters beyond ASCII, so that most take one place."""
    keep = raw < 0xC0
    return raw[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def _joined(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text without the single blanks between words of one letter, so that "i d i o t" is one word."""
    s, e, row = words.word_spans(raw, off)
    letter = (e - s == 1) & ((raw[s] >= 0x80) | ((raw[s] | 0x20) - np.uint8(97) < 26))
    gap = letter[:-1] & letter[1:] & (row[:-1] == row[1:]) & (s[1:] - e[:-1] == 1)
    keep = np.ones(len(raw), bool)
    keep[e[:-1][gap]] = False
    return raw[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def maps(vocabulary: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(subsequence numbers, weights) of each word, of unit length."""
    out = []
    for w in vocabulary:
        raw = np.frombuffer(w.encode() or b" ", np.uint8)
        raw = _compact(raw, np.array([0, len(raw)]))[0]
        x, off = _marked(raw, np.array([0]), np.array([len(raw)]))
        k, v = [], []
        for *step, weight in _STEPS:
            if len(x) > step[-1]:
                code = _codes(x, *step)
                k.append(code)
                v.append(np.full(len(code), weight))
        size = _sizes(off)[0]
        out.append((np.concatenate(k).astype(np.int64), np.concatenate(v) / size) if k else (np.zeros(0, np.int64), np.zeros(0)))
    return out


@dataclass
class Svm:
    table: np.ndarray  # weight of each subsequence
    bias: float
    link: np.ndarray  # of the logistic function: constant, strongest word, words on the toxic side

    def text_values(self, col: pa.Array) -> np.ndarray:
        """(strongest word's value, log of 1 + words on the toxic side, 1 if there is a word) of each text."""
        raw, off = words.text_bytes(col)
        out = np.zeros((len(col), 3))
        for i, j in words.pieces(off):
            part, po = _joined(*_compact(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
            s, e, row = words.word_spans(part, po)
            if not len(s):
                continue
            x, wo = _marked(part, s, e)
            left = np.repeat(wo[1:], np.diff(wo)) - np.arange(len(x))  # characters from here to the word's end
            total = np.zeros(len(x), np.float32)
            for *step, weight in _STEPS:
                if len(x) > step[-1]:
                    v = self.table[_codes(x, *step)]
                    total[: len(v)] += np.where(left[: len(v)] > step[-1], v, 0) * weight
            value = np.add.reduceat(total, wo[:-1]) / _sizes(wo) + self.bias
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[i + row[first], 0] = np.clip(np.maximum.reduceat(value, first), -3, 3)
            out[i + row[first], 1] = np.log1p(np.add.reduceat((value > 0).astype(np.float64), first))
            out[i + row[first], 2] = 1
        return out

    def score(self, col: pa.Array) -> np.ndarray:
        v = self.text_values(col)
        return 1 / (1 + np.exp(-np.clip(self.link[0] + np.where(v[:, 2] > 0, v[:, 0], -3) * self.link[1] + v[:, 1] * self.link[2], -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    v = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * penalty
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        inside = y * (x @ v) < 1
        xs, ws = x[inside], weight[inside]
        new = np.linalg.solve(ridge + (xs * ws[:, None]).T @ xs, (xs * ws[:, None]).T @ y[inside])
        if np.allclose(new, v, atol=1e-8):
            break
        v = new
    return v


def fit_words(toxic: list[str], clean: list[str], weights: list[float]) -> tuple[np.ndarray, float]:
    """(table of subsequence weights, constant) of a machine on words, over Nyström landmarks."""
    found = maps(toxic + clean)
    def dense(which: list[int], used: np.ndarray) -> np.ndarray:
        """The maps of some words on some subsequences only."""
        m = np.zeros((len(which), len(used)), np.float32)
        for i, w in enumerate(which):
            k, v = found[w]
            at = np.minimum(np.searchsorted(used, k), len(used) - 1)
            hit = used[at] == k
            np.add.at(m[i], at[hit], v[hit])
        return m

    def kernel_with(marks: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(subsequences of the landmarks, their maps, the kernel of all words with them)."""
        used = np.unique(np.concatenate([found[w][0] for w in marks]))
        m = dense(marks, used)
        return used, m, np.concatenate([dense(list(range(i, min(i + 500, len(found)))), used) @ m.T for i in range(0, len(found), 500)])

    # landmarks: toxic words far from one another, then the clean words next to them
    pick = [0]
    near = kernel_with([0])[2][: len(toxic), 0]
    while len(pick) < min(LANDMARKS * 2 // 3, len(toxic)):
        k = int(near.argmin())
        if near[k] > 0.9:
            break
        pick.append(k)
        used = np.unique(found[k][0])
        near = np.maximum(near, (dense(list(range(len(toxic))), used) @ dense([k], used).T)[:, 0])
    kernel = kernel_with(pick)[2]
    rivals = len(toxic) + np.argsort(-kernel[len(toxic) :].max(1), kind="stable")[: LANDMARKS // 3]
    used, marks, kernel = kernel_with(pick + rivals.tolist())
    value, vector = np.linalg.eigh(marks @ marks.T)
    good = value > 1e-4 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    y = np.r_[np.ones(len(toxic)), -np.ones(len(clean))]
    weight = np.array(weights)
    weight = np.r_[weight * len(clean) / weight.sum(), np.ones(len(clean))]
    v = _svm(kernel @ root, y, weight)
    table = np.zeros(TABLE, np.float32)
    table[used] = marks.T @ (root @ v[:-1])
    return table, float(v[-1])


def _values(batches: Iterator[pa.RecordBatch], model: Svm) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = model.text_values(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("label"), *[pa.array(v[:, k]) for k in range(3)]], names=["label", "a", "b", "c"])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    v = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(v)), x.T @ (y - p) - 0.1 * v)
        v = v + np.clip(step, -2, 2)
    return v


def train(rows: DataFrame) -> Svm:
    """A model from (label, text) rows."""
    rows = stash(rows)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n, total = counts.get(1, 0), sum(counts.values())
    share = min(max(n / total if total else 0.5, 1e-3), 1 - 1e-3)
    none = Svm(np.zeros(TABLE, np.float32), -1.0, np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    if n == 0 or n == total:
        return none
    in_text = rows.select("label", F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D.!?,;:\"]+")).alias("w"))
    by = in_text.select("label", F.explode("w").alias("w")).where("w <> ''").groupBy("w").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    lean = (F.log((F.col("a") + 0.5) / n) - F.log((F.col("b") + 0.5) / (total - n))) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    by = stash(by.withColumn("lean", lean))
    leaning = by.where((F.col("lean") >= SURE) & (F.col("a") >= 3) & (F.col("a") >= TIMES * F.col("b"))).orderBy(F.desc("lean"), "w").limit(TOXIC_WORDS).collect()
    toxic = [r["w"] for r in leaning]
    plain = by.where("lean < 1")
    parts = (plain.orderBy(F.desc("b"), "w").limit(FREQUENT_WORDS), plain.where("b > 0").orderBy(F.xxhash64("w"), "w").limit(OTHER_WORDS))
    clean = sorted({r["w"] for part in parts for r in part.collect()})
    if not toxic or not clean:
        return none
    table, bias = fit_words(toxic, clean, [float(r["a"]) for r in leaning])
    model = Svm(table, bias, np.zeros(3))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    found = rows.mapInArrow(lambda it: _values(it, shared.value), "label int, a double, b double, c double").toArrow()
    a, b, c, y = (found.column(k).to_numpy() for k in ("a", "b", "c", "label"))
    x = np.stack([np.where(c > 0, a, -3), b], 1)
    o = np.lexsort((y, *x.T))
    model.link = _logistic(x[o], y[o].astype(np.float64))
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Svm) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rest = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(b.column, rest), pa.array(model.score(b.column("text")), pa.float64())], names=[*rest, "score"])


def score(docs: DataFrame, model: Svm, key: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*key).schema)
    return docs.select(*key, "text").mapInArrow(lambda it: _scored(it, shared.value), f"{schema}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(training_rows(docs, labels.where(crc_mod("doc_id", 4) != 2), "toxic", TRAIN_ROWS))
    rows = score(docs.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
