"""SimHash near-duplicates: pivot distance tables over 64-bit fingerprints.

A fingerprint has a bit for each bit that is set in over half of the hashes of a text's word shingles. Two
fingerprints link when they differ in at most ``RADIUS`` = 2 bits.

Each fingerprint gets the table of its Hamming distances to 49 reference fingerprints: the zero one, and for
each of four groups of 16 bits the Walsh functions 1 to 12 on that group, zero elsewhere. Two linked
fingerprints have distances that differ by at most 2 to every reference (the triangle inequality), and in
at least two of the groups they have no different bit, so the distances to these groups' references, less that to
the zero one, are equal. The equal distances of two groups are the key of a cell, six cells a fingerprint; pairs
of a cell whose largest difference of distances is over 2 are discarded, the others verified bit by bit.

A cell of more than ``CELL`` fingerprints (a family of near copies) is not compared pair by pair: each of its
fingerprints is listed under itself and under its neighbours at one flipped bit outside the two groups. Fingerprints
of one list are at most 2 bits apart, each pair at most 2 bits apart shares a list, and a list has at most 33
members by construction. So the work is in proportion to the fingerprints whatever their skew: nothing is capped.

Nulls and texts without a word have fingerprint zero and link like any other. A null ``doc_id`` has a component as any
row, named by the smallest id in it (null if it has none). Repeated rows and ties have equal fingerprints; an
empty table gives no rows; extra columns are ignored. Texts are hashed whole, in steps of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .components import connected_components
from .tables import read, stash

SHINGLE, SEED, RADIUS = 3, 42, 2
GROUPS, WIDTH, WALSH = 4, 16, range(1, 13)
#: Fingerprints of a cell that are compared pair by pair.
CELL = 64
#: Shingles that one step hashes.
STEP = 1 << 17


# --- fingerprints


def _bit_counts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For hashes in runs that begin at ``at``, how many of each run have each bit set: (runs, 64)."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, at, axis=0, dtype=np.int64)


def _piece(raw: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The fingerprints of rows laid end to end."""
    n = len(off) - 1
    start, end, row = words.word_spans(raw, off)
    # words side by side with one space between, so that a shingle is one span
    size = end - start + 1
    to = np.cumsum(size) - size
    own = np.repeat(start - to, size) + np.arange(int(size.sum()))
    joined = raw[np.minimum(own, max(len(raw) - 1, 0))].copy() if len(raw) else raw.copy()
    joined[to + size - 1] = 0x20
    view = memoryview(joined.tobytes())
    many = np.bincount(row, minlength=n)
    first = np.cumsum(many) - many
    shingles = np.where(many > 0, np.maximum(many - k + 1, 1), 0)
    counts = np.zeros((n, 64), np.int64)
    of = np.repeat(np.arange(n), shingles)
    begin = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(len(of))
    last = np.minimum(begin + k, (first + many)[of]) - 1
    a, b = to[begin], to[last] + size[last] - 1
    for s in range(0, len(of), STEP):
        e = min(s + STEP, len(of))
        h = np.fromiter((xxhash.xxh64_intdigest(view[i:j], SEED) for i, j in zip(a[s:e].tolist(), b[s:e].tolist())), np.uint64, e - s)
        at = np.concatenate([[0], np.flatnonzero(np.diff(of[s:e])) + 1])
        counts[of[s:e][at]] += _bit_counts(h, at)
    return np.packbits(2 * counts > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel()


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, off = words.text_bytes(b.column("text"))
        for i, j in words.pieces(off):
            f = _piece(_FOLD[raw[off[i] : off[j]]], off[i : j + 1] - off[i], k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(f.view(np.int64))], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint as a long) of each row of ``docs`` (doc_id integer, text): A-Z folded, shingles of ``k`` words, repeats counted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _fingerprints(it, k), "doc_id long, fingerprint long")


# --- pivots


def walsh(t: int) -> int:
    """The Walsh function t on 16 places as bits: eight of them are set."""
    return sum((bin(t & i).count("1") & 1) << i for i in range(WIDTH))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references() -> list[list[int]]:
    """The reference fingerprints of each group, besides the zero one."""
    return [[walsh(t) << (WIDTH * g) for t in WALSH] for g in range(GROUPS)]


def with_distances(fp: DataFrame) -> DataFrame:
    """``fp`` with ``zero``, the distance to the zero fingerprint, and ``near``: for each group and reference of it, half of what
    the distance falls short of ``zero`` + 8 (0 to 8), four bits each."""
    zero = F.bit_count("fp").cast("long")
    packed = []
    for group in references():
        half = [F.shiftright(zero + 8 - F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(r)))).cast("long"), 1) for r in group]
        packed.append(reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(x, 4 * t) for t, x in enumerate(half)]))
    return fp.select("fp", zero.alias("zero"), F.array(*packed).alias("near"))


def largest_difference(a: str, b: str) -> Column:
    """The largest difference of the distances of two rows with `with_distances`' columns to any reference."""
    zero = F.col(f"{a}.zero") - F.col(f"{b}.zero")
    one = lambda x, g, t: F.shiftright(F.col(f"{x}.near")[g], 4 * t).bitwiseAND(F.lit(15))
    return F.greatest(F.abs(zero), *[F.abs(zero - 2 * (one(a, g, t) - one(b, g, t))) for g in range(GROUPS) for t in range(len(WALSH))])


def links(fp: DataFrame) -> DataFrame:
    """(a, b), a < b, that join what is connected by at most 2 different bits among the distinct fingerprints ``fp`` (fp long)."""
    pairs = list(combinations(range(GROUPS), 2))
    table = stash(with_distances(fp))
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(F.lit(i), F.col("near")[g], F.col("near")[h]).alias("key")) for i, (g, h) in enumerate(pairs)])
    cells = table.withColumn("x", F.explode(keys)).select("x.i", "x.key", "fp", "zero", "near")
    shared = cells.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stash(cells.join(shared, ["i", "key"]))

    small = met.where(F.col("n") <= CELL)
    a, b = small.alias("a"), small.alias("b")
    same = (F.col("a.i") == F.col("b.i")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    kept = a.join(b, same).where(largest_difference("a", "b") <= RADIUS)
    found = kept.where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    outside = [[_signed(1 << i) for i in range(64) if i // WIDTH not in p] for p in pairs]
    flips = F.array(*[F.array(F.lit(0).cast("long"), *map(F.lit, o)).cast("array<long>") for o in outside])
    lists = met.where(F.col("n") > CELL).select("i", "fp", F.explode(flips[F.col("i")]).alias("flip")).groupBy("i", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    hot = lists.agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    return stash(found.unionByName(hot).distinct())


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of each row of ``docs``: the smallest id reachable over links of at most 2 bits."""
    marked = stash(fingerprints(docs, k))
    classes = stash(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")))
    linked = stash(connected_components(links(classes.select("fp"))))
    of = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = of.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = stash(of.join(named, "component").select(F.col("fp").alias("fingerprint"), "component_id"))
    return marked.join(ids, "fingerprint").select("doc_id", "fingerprint", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
