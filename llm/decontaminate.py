"""Benchmark decontamination: BM25 retrieval of test items by training passages, then overlap checks.

The test items are the collection and every passage of every document is a query. Items are
indexed by term; their BM25 weights are divided by the item's own attainable score, so one
threshold serves all items. Retrieval is block-max WAND, on whole batches at once: a passage
is dropped when the sum of its terms' largest weights cannot reach the threshold; then each
block of items whose summed block maxima cannot; only in what is left are items scored. All
items that reach the threshold are retrieved, without a limit on their number.

Retrieved items are verified in the passage's surroundings: the share of the item's 4-word
sequences found there, for the question (all sentences but the last; where either part would
be under 8 words, the first three quarters of the words) and the answer (the rest) apart. Words are lower-cased and stripped
of ASCII punctuation at their ends.

Only items are broadcast, in blocks of about ``ITEMS_AT_ONCE`` items and ``BLOCK_BYTES`` of text at most;
a larger benchmark is a sequence of such blocks, each against all documents. Documents stay
where they are: there is no shuffle of text. Null or empty texts and items match nothing; repeated
rows are each reported; documents with a null id are matched too. Items shorter than ``MIN_ITEM_WORDS`` words
are too short for scores: those of at least ``GRAM`` words are found where a text has all their words in a
row, shorter ones only where they are the whole text (score and overlaps are then 1). The attainable score of an item is that of its
``ATTAINABLE_TERMS`` heaviest terms, since a passage has room for no more of a long one. A score equal to the threshold is
retrieved; items of equal text are all reported. Without documents or items nothing is reported and no document goes.
Texts of any length are read whole; columns beside id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .tables import read, stash

ITEMS_AT_ONCE = 20_000
BLOCK_BYTES = 16 << 20
MIN_ITEM_WORDS = 8
#: BM25's constants, and the share of its attainable score at which an item is retrieved.
K1, B, THRESHOLD = 1.2, 0.75, 0.5
#: The attainable score counts this many terms, so an item longer than a passage can be found.
ATTAINABLE_TERMS = 48
PASSAGE, STRIDE = 96, 32
ITEM_BLOCK = 16
GRAM = 4
MIN_QUESTION, MIN_ANSWER = 0.6, 0.5

_STOP = np.zeros(256, bool)
_STOP[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True


def _words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words, without punctuation at their ends."""
    s, e, row = words.word_spans(raw, off)
    while True:
        cut = _STOP[raw[np.minimum(s, len(raw) - 1)]] & (s < e) if len(s) else np.zeros(0, bool)
        if not cut.any():
            break
        s = s + cut
    while True:
        cut = _STOP[raw[e - 1]] & (s < e) if len(s) else np.zeros(0, bool)
        if not cut.any():
            break
        e = e - cut
    some = s < e
    s, e, row = s[some], e[some], row[some]
    return words.hash_spans(raw, s, e, True), row


def _grams(h: np.ndarray, k: int = GRAM) -> np.ndarray:
    return words.shingles(h, np.zeros(len(h), np.int64), 1, k)[0]


@dataclass
class Index:
    """A block-max inverted index of one block of items."""

    item_ids: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    length: np.ndarray
    terms: np.ndarray  # sorted term hashes
    slots: np.ndarray  # first term of each hash range, for fast lookups
    start: np.ndarray  # postings of each term
    item: np.ndarray
    weight: np.ndarray
    top: np.ndarray  # largest weight of each term
    block_start: np.ndarray  # block maxima of each term
    block: np.ndarray
    block_top: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """The term number of each hash, or -1."""
        lo = self.slots[(h >> np.uint64(44)).astype(np.int64)]
        maybe = np.flatnonzero(lo >= 0)
        out = np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
        hit = self.terms[at] == h[maybe]
        out[maybe[hit]] = at[hit]
        return out


def _split(text: str) -> tuple[str, str]:
    """(question, answer) of an item."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    question = text[: text.rstrip().rfind(parts[-1])] if parts else ""
    if min(len(question.split()), len(parts[-1].split()) if parts else 0) >= 2 * GRAM:
        return question, parts[-1]
    w = text.split()
    cut = max(1, len(w) * 3 // 4)
    return " ".join(w[:cut]), " ".join(w[cut:])


def build_index(items: list[tuple[int, str]], document_frequency: dict[int, int], n_items: int, mean_length: float) -> Index:
    hashes = [_item_words(t) for _, t in items]
    length = np.array([len(h) for h in hashes], np.int64)
    terms, where, tf = [], [], []
    for i, h in enumerate(hashes):
        u, c = np.unique(h, return_counts=True)
        terms.append(u)
        tf.append(c)
        where.append(np.full(len(u), i))
    terms, tf, where = (np.concatenate(x) for x in (terms, tf, where))
    df = np.array([document_frequency[t] for t in terms.tolist()], np.float64)
    idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
    w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[where] / mean_length))
    of_item = np.split(w, np.searchsorted(where, np.arange(1, len(items))))  # postings still stand item by item
    own = np.array([np.sort(x)[::-1][:ATTAINABLE_TERMS].sum() for x in of_item])
    w = w / own[where]
    o = np.lexsort((where, terms))
    terms, where, w = terms[o], where[o], w[o].astype(np.float32)
    u, start = np.unique(terms, return_index=True)
    of = np.repeat(np.arange(len(u)), np.diff(np.append(start, len(terms))))
    key = of * (len(items) // ITEM_BLOCK + 1) + where // ITEM_BLOCK
    bk, bs = np.unique(key, return_index=True)
    slots = np.full(1 << 20, -1, np.int32)
    slots[(u >> np.uint64(44)).astype(np.int64)] = 1
    block_term = bk // (len(items) // ITEM_BLOCK + 1)
    q, a = zip(*[tuple(np.unique(_grams(_item_words(p))) for p in _split(t)) for _, t in items], strict=True)
    return Index(
        np.array([i for i, _ in items]), list(q), list(a), length, u, slots, np.append(start, len(terms)), where.astype(np.int32), w,
        np.maximum.reduceat(w, start), np.searchsorted(block_term, np.arange(len(u) + 1)), (bk % (len(items) // ITEM_BLOCK + 1)).astype(np.int32), np.maximum.reduceat(w, bs),
    )


@dataclass
class Short:
    """Items too short for scores: the hash of the whole word sequence, by its length."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray]]  # sorted hashes, their items

    @staticmethod
    def of(items: list[tuple[int, np.ndarray]]) -> Short:
        found: dict[int, list[tuple[int, int]]] = {}
        for i, h in items:
            found.setdefault(len(h), []).append((int(_grams(h, len(h))[0]), i))
        return Short({k: (np.array([h for h, _ in sorted(v)], np.uint64), np.array([i for _, i in sorted(v)], np.int64)) for k, v in found.items()})

    def found(self, h: np.ndarray, row: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
        """(row, item) of the items that the words of ``rows`` texts hold."""
        counts = np.bincount(row, minlength=rows)
        for k, (hashes, items) in self.by_length.items():
            gram, at = words.shingles(h, row, rows, k)
            some = counts[at] >= k if k >= GRAM else counts[at] == k
            gram, at = gram[some], at[some]
            lo, hi = np.searchsorted(hashes, gram, "left"), np.searchsorted(hashes, gram, "right")
            hit = np.flatnonzero(hi > lo)
            yield from sorted({(int(at[x]), int(i)) for x in hit for i in items[lo[x] : hi[x]]})


def _item_words(text: str) -> np.ndarray:
    raw = np.frombuffer(pc.utf8_lower(text or "").as_py().encode(), np.uint8)
    return _words(raw, np.array([0, len(raw)]))[0]


def _expand(term: np.ndarray, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, posting number) of every posting of each term."""
    n = start[term + 1] - start[term]
    first = np.cumsum(n) - n
    return np.repeat(at, n), np.arange(n.sum()) - np.repeat(first - start[term], n)


def _retrieve(h: np.ndarray, row: np.ndarray, x: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, item, score) of every passage and item at or above the threshold."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    term = x.find(h)
    if not (term >= 0).any():
        return none
    # passages: windows from every STRIDE-th word of a row, cut at its end
    counts = np.bincount(row)
    begin = np.cumsum(counts) - counts
    per = np.maximum(1, -(-(counts - PASSAGE + STRIDE) // STRIDE)) * (counts > 0)
    first = np.repeat(begin, per) + STRIDE * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    last = np.minimum(first + PASSAGE, np.repeat(begin + counts, per))
    bound = np.concatenate([[0.0], np.cumsum(np.where(term >= 0, x.top[term], 0.0))])
    keep = bound[last] - bound[first] >= THRESHOLD - 1e-6
    first, last = first[keep], last[keep]
    if not len(first):
        return none
    # distinct terms of the passages that may reach it
    n = last - first
    at = np.repeat(np.arange(len(first)), n)
    word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
    t = term[word]
    pair = np.unique(at[t >= 0] * len(x.terms) + t[t >= 0])
    at, t = pair // len(x.terms), pair % len(x.terms)
    # block maxima
    n_blocks = int(x.block.max()) + 1
    p, k = _expand(t, at, x.block_start)
    cell, inverse = np.unique(p * n_blocks + x.block[k], return_inverse=True)
    cell = cell[np.bincount(inverse, x.block_top[k]) >= THRESHOLD - 1e-6]
    # full scores in the blocks that may reach it
    some = np.isin(at, cell // n_blocks)
    p, k = _expand(t[some], at[some], x.start)
    item = x.item[k].astype(np.int64)
    inside = np.isin(p * n_blocks + item // ITEM_BLOCK, cell)
    p, k, item = p[inside], k[inside], item[inside]
    cell, inverse = np.unique(p * len(x.item_ids) + item, return_inverse=True)
    score = np.bincount(inverse, x.weight[k])
    hit = score >= THRESHOLD
    p, item = cell[hit] // len(x.item_ids), cell[hit] % len(x.item_ids)
    return first[p], last[p], item, score[hit]


def _found(text: pa.Array, x: Index | Short) -> tuple[list, ...]:
    """(row, item id, score, question overlap, answer overlap) lists of the items that a batch of texts holds."""
    raw, off = words.text_bytes(pc.utf8_lower(text))
    found: tuple[list, ...] = ([], [], [], [], [])
    for i, j in words.pieces(off):
        h, row = _words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        if isinstance(x, Short):
            for d, it in x.found(h, row, j - i):
                for out, v in zip(found, (i + d, it, 1.0, 1.0, 1.0), strict=True):
                    out.append(v)
            continue
        first, last, item, score = _retrieve(h, row, x)
        if not len(first):
            continue
        ends = np.searchsorted(row, np.arange(j - i + 1))
        best: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        for f, e, it, s in zip(first.tolist(), last.tolist(), item.tolist(), score.tolist(), strict=True):
            d = int(row[f])
            around = int(x.length[it]) + GRAM
            seen = _grams(h[max(ends[d], f - around) : min(ends[d + 1], e + around)])
            q, a = (float(np.isin(g, seen).mean()) if len(g) else 1.0 for g in (x.question[it], x.answer[it]))
            best[d, it] = max(best.get((d, it), (-1.0,) * 4), (min(q, a), s, q, a))
        for (d, it), (_, s, q, a) in best.items():
            if q >= MIN_QUESTION and a >= MIN_ANSWER:
                for out, v in zip(found, (i + d, int(x.item_ids[it]), s, q, a), strict=True):
                    out.append(v)
    return found


def _match(batches: Iterator[pa.RecordBatch], x: Index | Short) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, items, *numbers = _found(b.column("text"), x)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), *[pa.array(v, pa.float64()) for v in numbers]], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])


def _clean(batches: Iterator[pa.RecordBatch], x: Index | Short) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = np.ones(len(b), bool)
        keep[_found(b.column("text"), x)[0]] = False
        yield b.filter(pa.array(keep))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, off = words.text_bytes(pc.utf8_lower(b.column("text")))
        h, row = _words(raw, off)
        at = pa.array(np.searchsorted(row, np.arange(len(off))), pa.int32())
        yield pa.RecordBatch.from_arrays([*map(b.column, ("k", "item_id", "text")), pa.ListArray.from_arrays(at, pa.array(h.view(np.int64)))], names=["k", "item_id", "text", "h"])


def _in_blocks(items: DataFrame, blocks: int) -> Iterator[DataFrame]:
    """``items`` dealt evenly, copies too, by their row number."""
    for b in range(blocks):
        yield items.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)


def indexes(items: DataFrame) -> Iterator[Index | Short]:
    """The index of each block of items, one at a time. Spark counts document frequencies and the mean length over all items
    long enough for scores; the driver receives one block's items and the frequencies of its terms."""
    rows = items.where("item_id is not null and text is not null").select(F.monotonically_increasing_id().alias("k"), F.col("item_id").cast("long").alias("item_id"), "text")
    rows = stash(rows.mapInArrow(_hashed, "k long, item_id long, text string, h array<long>")).withColumn("n", F.size("h"))
    full, short = rows.where(F.col("n") >= MIN_ITEM_WORDS), rows.where((F.col("n") > 0) & (F.col("n") < MIN_ITEM_WORDS))
    n_items, n_words, size = full.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n_items:
        frequency = stash(full.select(F.explode(F.array_distinct("h")).alias("t")).groupBy("t").count())
        for block in _in_blocks(full, max(-(-n_items // ITEMS_AT_ONCE), -(-size // BLOCK_BYTES))):
            own = frequency.join(block.select(F.explode("h").alias("t")).distinct(), "t", "left_semi").toArrow()
            counts = dict(zip(own.column("t").to_numpy().view(np.uint64).tolist(), own.column("count").to_pylist(), strict=True))
            found = sorted((r["item_id"], r["text"]) for r in block.select("item_id", "text").collect())
            if found:
                yield build_index(found, counts, n_items, n_words / n_items)
    for block in _in_blocks(short, -(-short.count() // ITEMS_AT_ONCE)):
        found = [(r["item_id"], np.array(r["h"], np.int64).view(np.uint64)) for r in block.select("item_id", "h").collect()]
        if found:
            yield Short.of(found)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each document and test item found in it."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double"
    found = None
    for index in indexes(items):
        shared = spark.sparkContext.broadcast(index)
        part = docs.select("doc_id", "text").mapInArrow(lambda it, s=shared: _match(it, s.value), schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows in which a test item is found; nothing is shuffled."""
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.mapInArrow(lambda it, s=shared: _clean(it, s.value), docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])
