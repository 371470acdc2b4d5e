"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its quantile bins, and so has each chosen pair of
features. The tables are learnt by cyclic boosting: round after round, each feature in turn (then
each pair) gets a shallow tree on the current residuals, whose leaves are added to its table.
Scoring is a sum of table entries, bin by bin, over whole batches.

Training takes at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of the id (a documented
bound; features of that sample, not texts, reach the driver). Features use whole texts. Null and
empty texts have all-zero features and are scored like any other. Without both labels among
the training rows every score is the share of good rows, or 0.5. Repeated rows score alike, and a document that is there
twice is learnt from twice; equal feature values fall into one bin; a score of exactly 0.5 is predicted good. An empty table gives no rows; other
columns are ignored. A row without an id is scored, and neither held out nor learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .tables import crc_mod, read

TRAIN_ROWS = 60_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE, LEAF = 120, 60, 0.15, 20
FEATURES = (
    "log_words", "word_length", "upper", "digit", "symbol", "stop", "loud", "line_break", "line_length", "repeated_lines",
    "distinct_words", "repeated_triples", "capital_words", "beyond_ascii", "longest_word", "bars",
)

_KIND = np.zeros((8, 256), np.float32)
for _row, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>", ".,;:?", "!", "\n", "|")):
    _KIND[_row, [ord(c) for c in _chars]] = 1
_KIND[7, 0xC0:] = 1


def text_features(col: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    raw, off = words.text_bytes(col)
    out = [np.zeros((0, len(FEATURES)))]
    for i, j in words.pieces(off):
        out.append(_piece(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
    return np.concatenate(out)


def _piece(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(np.float64)
    sums = lambda values: np.diff(np.concatenate([[0.0], np.cumsum(values)])[off])
    kinds = [sums(_KIND[k][raw]) / size for k in range(8)]
    start, end, row = words.word_spans(raw, off)
    count = np.bincount(row, minlength=n).astype(np.float64)
    per = np.maximum(count, 1)
    length = end - start
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    capital = np.zeros(0)
    if len(start):
        upper = np.concatenate([[0.0], np.cumsum(_KIND[0][raw])])
        capital = (upper[end] - upper[start]) * 2 > length
    h = words.hash_spans(raw, start, end, True)
    distinct = np.bincount(words.distinct(h, row, n)[1], minlength=n)
    t, trow = words.shingles(h, row, n, 3)
    triples = np.bincount(trow, minlength=n)
    fresh = np.bincount(words.distinct(t, trow, n)[1], minlength=n)
    breaks = np.flatnonzero(raw == 10)
    lines = np.bincount(np.searchsorted(off, breaks, "right") - 1, minlength=n) + 1
    starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], breaks + 1]))
    starts = starts[starts < len(raw)]
    lh = words.hash_spans(raw, starts, np.append(starts[1:], len(raw)), True) if len(starts) else np.zeros(0, np.uint64)
    lrow = np.searchsorted(off, starts, "right") - 1
    lall, lnew = np.bincount(lrow, minlength=n), np.bincount(words.distinct(lh, lrow, n)[1], minlength=n)
    return np.stack([
        np.log1p(count), np.bincount(row, length, n) / per, *kinds[:3], kinds[3], kinds[4], kinds[5], size / lines, 1 - lnew / np.maximum(lall, 1),
        distinct / per, 1 - fresh / np.maximum(triples, 1), np.bincount(row, capital, n) / per, kinds[7], np.minimum(longest, 1000), kinds[6],
    ], 1)


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray]
    tables: np.ndarray  # features x bins
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray  # pairs x bins x bins

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.base)
        for k, e in enumerate(self.edges):
            s += self.tables[k][np.searchsorted(e, x[:, k], "right")]
        c = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.coarse)]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            s += t[c[a], c[b]]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """(gain, position) of the best cut of a histogram of gradients."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain = np.where((nl >= LEAF) & (n.sum() - nl >= LEAF), gain, -1.0)
    k = int(gain.argmax()) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) and gain[k] > 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree of at most three leaves."""
    parts = [(0, len(g))]
    for _ in range(2):
        best = max(((*_split(g[a:b], h[a:b], n[a:b]), a, b) for a, b in parts), key=lambda p: p[0])
        if not best[1]:
            break
        _, k, a, b = best
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = RATE * g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _square(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values by cell) of the tree that cuts either axis once."""
    best, out = 0.0, np.zeros(g.shape)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            cells = [(slice(None, a), slice(None, b)), (slice(None, a), slice(b, None)), (slice(a, None), slice(None, b)), (slice(a, None), slice(b, None))]
            if min(n[c].sum() for c in cells) < LEAF:
                continue
            gain = sum(g[c].sum() ** 2 / (h[c].sum() + 1) for c in cells)
            if gain > best:
                best, out = gain, np.zeros(g.shape)
                for c in cells:
                    out[c] = RATE * g[c].sum() / (h[c].sum() + 1)
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of single-feature tables, then of the tables of the most promising pairs."""
    k = len(FEATURES)
    share = y.mean() if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        base = np.log((share + 1e-6) / (1 - share + 1e-6))
        return Gam(float(base), [np.zeros(0)] * k, np.zeros((k, BINS)), [np.zeros(0)] * k, [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    edges, coarse = ([_edges(x[:, f], b) for f in range(k)] for b in (BINS, PAIR_BINS))
    fine = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    rough = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    s = np.full(len(y), np.log(share / (1 - share)))
    m = Gam(float(s[0]), edges, np.zeros((k, BINS)), coarse, [], np.zeros((0, PAIR_BINS, PAIR_BINS)))

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-s))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(k):
            g, h = residual()
            add = _tree(*(np.bincount(fine[f], v, BINS) for v in (g, h)), np.bincount(fine[f], minlength=BINS))
            m.tables[f] += add
            s += add[fine[f]]
    cell = lambda p: rough[p[0]] * PAIR_BINS + rough[p[1]]
    grid = lambda p, v=None: np.bincount(cell(p), v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = residual()
    gains = {(a, b): _square(grid((a, b), g), grid((a, b), h), grid((a, b)))[0] for a in range(k) for b in range(a + 1, k)}
    m.pairs = sorted(gains, key=gains.get, reverse=True)[:PAIRS]
    m.pair_tables = np.zeros((len(m.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS // 6):
        for t, p in zip(m.pair_tables, m.pairs, strict=True):
            g, h = residual()
            add = _square(grid(p, g), grid(p, h), grid(p))[1]
            t += add
            s += add.ravel()[cell(p)]
    return m


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = text_features(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("label"), *[pa.array(x[:, k]) for k in range(len(FEATURES))]], names=["label", *FEATURES])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(label, text) of at most ``most`` labelled documents, chosen by a hash of the id; the label rows (16 bytes each) are broadcast."""
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
    some = some.orderBy(F.xxhash64("_id"), "_id", "label").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("label", "text")


def train(rows: DataFrame) -> Gam:
    found = rows.mapInArrow(_features, "label int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow()
    x = np.stack([found.column(f).to_numpy() for f in FEATURES], 1) if found.num_rows else np.zeros((0, len(FEATURES)))
    y = found.column("label").to_numpy().astype(np.float64)
    o = np.lexsort((*x.T, y))  # the order of rows must not matter
    return fit(x[o], y[o])


def _scored(batches: Iterator[pa.RecordBatch], model: Gam) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rest = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(b.column, rest), pa.array(model.score(text_features(b.column("text"))), pa.float64())], names=[*rest, "score"])


def score(docs: DataFrame, model: Gam, key: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*key).schema)
    return docs.select(*key, "text").mapInArrow(lambda it: _scored(it, shared.value), f"{schema}, score double")


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(training_rows(docs, labels.where(crc_mod("doc_id", 3) != 1), "quality", TRAIN_ROWS))
    rows = score(docs.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
