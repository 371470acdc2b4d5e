"""Exact n-gram Jaccard self-join by token-combination prefixes.

A document's set holds its distinct word shingles. Two sets with Jaccard of at least
``num / den`` share at least ``l`` shingles within the first ``n - ceil(n * num / den) + l``
shingles of each, under any order that all sets use ("extended prefixes"; ``l`` is that of the smaller
set). The order puts *frequent* shingles last: a list of those in more than 1/500 of the documents,
broadcast (there can be at most 500 times the mean set size of them; the list is cut at `FREQUENT_MOST`,
which only changes the order). The join goes

1. identical sets are one class, by a 128-bit fingerprint; its smallest document stands for it;
2. every set sends its extended prefix, packed by hash range, to where each shingle's classes
   meet; a set in whose prefix fewer than ``l`` shingles occur in a second class has no partner;
3. the sets that remain are fetched. Each meets one set, chosen by chance, for each of a few of its
   shingles, which links most members of large groups of near copies at linear cost;
4. step 2 again, where what must meet is another *component* of the links so far: what is left
   are sets that may be linked to another component;
5. those meet exactly. *Rare* shingles are keys on their own: if two similar sets share a rare shingle,
   the first that they share is in the prefix for ``l = 1`` of both. If they share none, their prefixes share ``l``
   frequent ones, so both hold as many: such sets also have *pairs* of frequent shingles as keys.
   Shingles fall into ``m < l`` groups by hash, some group holds two shared ones, and pairs are made within groups
   only, so their number grows with the set's size and not with its square;
6. where sets meet, the length and positional filters and a 1024-bit parity bitmap leave the
   pairs that may be similar, and of these a spanning forest of the components is verified on the whole
   sets. If all of it holds, every other pair lies within one component by now; if
   not, all pairs that still lie in two components are verified;
7. verified links and classes give components by star contraction.

Texts that are null or have no word have the empty set and no link. Rows with a null id are
returned with a null component and never compared. Rows of one id are one node, whatever their texts. A similarity equal
to the limit links. Texts of any length are read whole, in steps of bounded size; an empty table gives no rows, and columns
beside id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .components import connected_components
from .packed import SCHEMA, WINDOW_BYTES, bucket_of, n_buckets, pack, pairs_within, unpack
from .tables import read, shuffle_partitions, stash

WORDS = 5
NUM, DEN = 75, 100
FREQUENT_SHARE = 500
FREQUENT_MOST = 1 << 18
#: Shingles under which a set meets a set chosen by chance, and how many of the most alike are verified.
ANCHORS, BEST = 10, 2
#: Heads that a key's sets are held against, one after another.
SWEEPS = 3
SIGN_WORDS = 16
PAIRS_AT_ONCE = 100_000

ENTRY = (("hash", "<u8", 1), ("doc", "<i8", 1), ("print", "<u8", 1), ("need", "<i4", 1))
LABELLED = (*ENTRY, ("group", "<i8", 1))
MET = (("doc", "<i8", 1), ("print", "<u8", 1), ("need", "<i4", 1), ("met", "<i4", 1))
ANCHOR = (("key", "<u8", 1), ("doc", "<i8", 1), ("print", "<u8", 1), ("n", "<i4", 1), ("sign", "<u8", SIGN_WORDS))
KEY = (*ANCHOR[:4], ("at", "<i4", 1), ("group", "<i8", 1), ANCHOR[4])
EDGES = "a long, ap long, b long, bp long, apart int"


def _need(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared entries that a partner of at least this size must have in the prefix, prefix length) of sets of size n."""
    alpha = -(-n * NUM // DEN)
    shared = np.minimum(alpha, np.maximum(2, n // 8))
    return shared, n - alpha + shared


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, hashes, offsets) of the shingle sets of the rows with an id."""
    for b in batches:
        b = b.filter(b.column("doc_id").is_valid())
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for i, n, h, off in words.shingle_sets(b.column("text"), WORDS):
            yield ids[i : i + n], h, off


def _prints(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit fingerprint of each set, as two integers."""
    out = []
    for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(h ^ salt))])
        out.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
    return out[0], out[1]


def _signs(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each set the parity of its shingles in each of 1024 ranges."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    cell = row * (64 * SIGN_WORDS) + (words.mix(h) % np.uint64(64 * SIGN_WORDS)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n * 64 * SIGN_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view("<u8").reshape(n, SIGN_WORDS)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document (id, size, fingerprint), and rows (hash, count) of what is frequent in a window of documents."""
    held: list[np.ndarray] = []
    size = docs = 0

    def frequent() -> pa.RecordBatch | None:
        if not held:
            return None
        u, c = np.unique(np.concatenate(held), return_counts=True)
        some = c >= max(8, docs / FREQUENT_SHARE)
        held.clear()
        return _rows(None, None, None, None, u[some].view(np.int64), c[some])

    for ids, h, off in _batches(batches):
        p, q = _prints(h, off)
        yield _rows(ids, np.diff(off), p, q, None, None)
        held.append(h)
        size, docs = size + h.nbytes, docs + len(ids)
        if size > WINDOW_BYTES:
            if (out := frequent()) is not None:
                yield out
            size = docs = 0
    if (out := frequent()) is not None:
        yield out


def _rows(ids, n, p, q, h, c) -> pa.RecordBatch:
    k = len(ids) if ids is not None else len(h)
    col = lambda x: pa.nulls(k, pa.int64()) if x is None else pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([col(x) for x in (ids, n, p, q, h, c)], names=["doc_id", "n", "p", "q", "hash", "c"])


def _ordered(h: np.ndarray, off: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each set with the frequent ones last, and which are frequent. Sets are sorted already."""
    if not len(frequent):
        return h, np.zeros(len(h), bool)
    late = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    o = np.argsort(row * 2 + late, kind="stable")
    return h[o], late[o]


def _prefix_entries(doc: np.ndarray, p: np.ndarray, h: np.ndarray, off: np.ndarray, frequent: np.ndarray) -> dict[str, np.ndarray]:
    """The rare part of each extended prefix; ``row`` is the set of each entry."""
    n = np.diff(off)
    shared, length = _need(n)
    h, late = _ordered(h, off, frequent)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(h)) - off[row] < length[row]
    need = shared - np.bincount(row[inside & late], minlength=len(n))
    take = inside & ~late
    h, row = h[take], row[take]
    # a set that is wholly frequent stays anyway, and needs a place to say so
    bare = np.flatnonzero((n > 0) & (need <= 0) & (np.bincount(row, minlength=len(n)) == 0))
    h, row = np.concatenate([h, words.mix(p[bare] ^ np.uint64(0x9E3779B9))]), np.concatenate([row, bare])
    return {"hash": h, "doc": doc[row], "print": p[row], "need": need[row], "row": row}


def _prefixes(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed prefix entries of the sets of texts; equal sets of a window send theirs once, under their smallest id."""
    held: list[dict[str, np.ndarray]] = []
    least: dict[int, int] = {}
    size = 0

    def packed() -> pa.RecordBatch:
        e = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
        u, at = np.unique(e["print"], return_inverse=True)
        e["doc"] = np.array([least[x] for x in u.tolist()], np.int64)[at]
        held.clear()
        least.clear()
        return pack(ENTRY, e, bucket_of(e["hash"], buckets))

    for ids, h, off in _batches(batches):
        p = _prints(h, off)[0].view(np.uint64)
        new = []
        for k, (d, x) in enumerate(zip(ids.tolist(), p.tolist())):
            if x not in least:
                new.append(k)
            least[x] = min(d, least.get(x, d))
        if len(new) < len(ids):
            n = np.diff(off)
            keep = np.zeros(len(ids), bool)
            keep[new] = True
            h, off = h[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[keep])])
            ids, p = ids[keep], p[keep]
        e = _prefix_entries(ids, p, h, off, frequent)
        del e["row"]
        if len(e["hash"]):  # texts without a word have no entry
            held.append(e)
            size += len(e["hash"]) * 28
        if size > WINDOW_BYTES:
            yield packed()
            size = 0
    if held:
        yield packed()


def _labelled_prefixes(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed prefix entries of fetched sets, with the component of each."""
    for doc, p, _, group, h, off, _ in _fetched(batches):
        e = _prefix_entries(doc, p, h, off, frequent)
        e["group"] = group[e["row"]]
        yield pack(LABELLED, e, bucket_of(e["hash"], buckets))


def _meet(table: pa.Table, labelled: bool, parts: int) -> pa.Table:
    """How many of a bucket's entries each set shares with another class (or component)."""
    e = unpack(LABELLED if labelled else ENTRY, table.column("data"))
    group = e["group"] if labelled else e["print"]
    o = np.lexsort((e["doc"], e["print"], group, e["hash"]))
    h, doc, p, group, need = (x[o] for x in (e["hash"], e["doc"], e["print"], group, e["need"]))
    one = np.ones(len(h), bool)  # a class from several windows counts once, under its smallest id
    one[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1]) | (labelled & (doc[1:] != doc[:-1]))
    h, doc, p, group, need = (x[one] for x in (h, doc, p, group, need))
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))[: len(h)]
    length = np.diff(np.append(start, len(h)))
    met = np.repeat(group[start] != group[start + length - 1], length)
    keep = met | (need <= 0)
    doc, p, need, met = doc[keep], p[keep], need[keep], met[keep]
    o = np.lexsort((p, doc))
    doc, p, need, met = doc[o], p[o], need[o], met[o]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (p[1:] != p[:-1])]))[: len(doc)]
    out = {"doc": doc[new], "print": p[new], "need": need[new], "met": np.add.reduceat(met.astype(np.int64), new) if len(new) else new}
    return pa.table(pack(MET, out, bucket_of(words.mix(out["print"]), parts)))


def _stay(table: pa.Table) -> pa.Table:
    """The sets of a part whose prefix shares enough entries, over all buckets."""
    e = unpack(MET, table.column("data"))
    o = np.lexsort((e["print"], e["doc"]))
    doc, p, need, met = (e[k][o] for k in ("doc", "print", "need", "met"))
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (p[1:] != p[:-1])]))[: len(doc)]
    some = new[np.add.reduceat(met.astype(np.int64), new) >= need[new]] if len(new) else new
    return pa.table({"doc": doc[some], "p": p[some].view(np.int64)})


def _meeting(entries: DataFrame, labelled: bool, buckets: int) -> DataFrame:
    """(doc, p) of the sets whose prefix shares enough entries with other classes (or components)."""
    parts = 12 + buckets // 8
    met = entries.groupBy("bucket").applyInArrow(lambda t: _meet(t, labelled, parts), SCHEMA)
    return stash(met.groupBy("bucket").applyInArrow(_stay, "doc long, p long"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, h, off in _batches(batches):
        n = np.diff(off)
        some = np.flatnonzero(n)
        sign = _signs(h, off)
        data = [h[off[i] : off[i + 1]].tobytes() for i in some]
        cols = [pa.array(ids[some], pa.int64()), pa.array(_prints(h, off)[0][some]), pa.array(n[some], pa.int64()), pa.array([sign[i].tobytes() for i in some], pa.binary()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc", "p", "n", "sign", "tokens"])


def _fetched(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[tuple]:
    """(doc, print, n, component, shingles, offsets, parities) of fetched sets, so many at once."""
    for b in batches:
        for at in range(0, len(b), most):
            x = b.slice(at, most)
            doc, p, n = (x.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "p", "n"))
            group = x.column("component").to_numpy(zero_copy_only=False) if "component" in x.schema.names else doc
            h = np.frombuffer(b"".join(x.column("tokens").to_pylist()), "<u8")
            sign = np.frombuffer(b"".join(x.column("sign").to_pylist()), "<u8").reshape(-1, SIGN_WORDS)
            yield doc, p.view(np.uint64), n, group, h, np.concatenate([[0], np.cumsum(n)]), sign


def _anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each set under the shingles that are its smallest by different hashes."""
    for doc, p, n, _, h, off, sign in _fetched(batches):
        keys, rows = [], []
        for seed in range(ANCHORS):
            m = words.mix(h ^ np.uint64(0xA0761D6478BD642F * (seed + 1) & 0xFFFFFFFFFFFFFFFF))
            keys.append(words.mix(np.minimum.reduceat(m, off[:-1]) + np.uint64(seed)))
            rows.append(np.arange(len(doc)))
        key, row = np.concatenate(keys), np.concatenate(rows)
        yield pack(ANCHOR, {"key": key, "doc": doc[row], "print": p[row], "n": n[row], "sign": sign[row]}, bucket_of(key, buckets))


def _alike(e: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs can be similar by size and parity, places in which their parities differ)."""
    n, m = e["n"][i].astype(np.int64), e["n"][j].astype(np.int64)
    ok = np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM
    apart = np.full(len(i), -1)
    k = np.flatnonzero(ok)
    apart[k] = np.bitwise_count(e["sign"][i[k]] ^ e["sign"][j[k]]).sum(1, dtype=np.int64)
    ok[k] = (n + m - apart)[k] * (NUM + DEN) >= 2 * NUM * (n + m)[k]
    return ok, apart


def _edges(e: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> pa.Table:
    p = e["print"].view(np.int64)
    cols = {"a": e["doc"][i], "ap": p[i], "b": e["doc"][j], "bp": p[j], "apart": apart.astype(np.int32)}
    return pa.table({k: np.ascontiguousarray(v) for k, v in cols.items()})


def _heads(table: pa.Table) -> pa.Table:
    """Candidate pairs of a set chosen by chance under each key and the others there; those unlike it meet another one."""
    e = unpack(ANCHOR, table.column("data"))
    o = np.lexsort((words.mix(e["key"] ^ words.mix(e["doc"].view(np.uint64))), e["key"]))
    found: tuple[list, list, list] = ([], [], [])
    for _ in range(SWEEPS):
        key = e["key"][o]
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(o)]
        head = o[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(o) else o
        other = np.flatnonzero(~new)
        if not len(other):
            break
        i, j = head[other], o[other]
        ok, apart = _alike(e, i, j)
        for out, x in zip(found, (i, j, apart)):
            out.append(x[ok])
        o = o[other[~ok]]
    i, j, apart = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    some = e["doc"][i] != e["doc"][j]
    return _edges(e, i[some], j[some], apart[some])


def _groups(n: int) -> int:
    """Into how many groups, a power of two under l, the frequent shingles of a set of size n fall."""
    l = int(_need(np.array([n]))[0][0])
    return 1 << max(0, (l - 1).bit_length() - 1)


def _frequent_pairs(f: np.ndarray, n: int) -> np.ndarray:
    """Keys of pairs of frequent shingles within groups, for partners from 3/4 of this size to this size."""
    out, m = [], _groups(-(-n * NUM // DEN))
    while m <= _groups(n):
        g = words.mix(f ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(m)
        o = np.argsort(g, kind="stable")
        end = np.searchsorted(g[o], g[o], "right")
        for i, j in pairs_within(np.arange(1, len(f) + 1), end, 1 << 20):
            x, y = np.minimum(f[o[i]], f[o[j]]), np.maximum(f[o[i]], f[o[j]])
            out.append(words.mix(x * np.uint64(3) + words.mix(y) + np.uint64(m)))
        m *= 2
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _keys(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each set under its keys, with its place in the set (0 for pairs of frequent shingles)."""
    for doc, p, n, group, h, off, sign in _fetched(batches, 500):
        h, late = _ordered(h, off, frequent)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(h)) - off[row]
        shared, length = _need(n)
        take = ~late & (at < (length - shared + 1)[row])
        keys, rows, places = [words.mix(h[take])], [row[take]], [at[take]]
        f = late & (at < length[row])
        for k in np.flatnonzero((np.bincount(row[f], minlength=len(n)) >= shared) & (shared >= 2)).tolist():
            x = _frequent_pairs(h[off[k] : off[k + 1]][f[off[k] : off[k + 1]]], int(n[k]))
            keys.append(x)
            rows.append(np.full(len(x), k))
            places.append(np.zeros(len(x), np.int64))
        key, row, at = np.concatenate(keys), np.concatenate(rows), np.concatenate(places)
        yield pack(KEY, {"key": key, "doc": doc[row], "print": p[row], "n": n[row], "at": at, "group": group[row], "sign": sign[row]}, bucket_of(key, buckets))


class _Forest:
    """Components of a bucket, joined pair by pair."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs, taken in order, join two components."""
        up, joins = self.up.tolist(), []

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            x, y = top(x), top(y)
            joins.append(x != y)
            up[max(x, y)] = min(x, y)
        self.up = np.array(up, np.int64)
        return np.array(joins, bool)


def _links(table: pa.Table, whole: bool) -> pa.Table:
    """Candidate pairs of different components in a bucket: all of them, or a spanning forest of the components."""
    e = unpack(KEY, table.column("data"))
    names, comp = np.unique(e["group"], return_inverse=True)
    o = np.lexsort((e["n"], e["key"]))
    start = np.flatnonzero(np.concatenate([[True], np.diff(e["key"][o]) != 0]))[: len(o)]
    size = np.diff(np.append(start, len(o)))
    live = np.repeat(np.minimum.reduceat(comp[o], start) != np.maximum.reduceat(comp[o], start), size) if len(o) else np.zeros(0, bool)
    o = o[live]
    g = np.cumsum(np.concatenate([[0], np.diff(e["key"][o]) != 0]))[: len(o)] << 33
    n = e["n"][o].astype(np.int64)
    last = np.searchsorted(g + n, g + n * DEN // NUM, "right")
    forest = _Forest(len(names))
    found: tuple[list, list, list] = ([], [], [])
    for i, j in pairs_within(np.arange(1, len(o) + 1), last, PAIRS_AT_ONCE):
        i, j = o[i], o[j]
        root = comp if whole else forest.roots()[comp]
        differ = root[i] != root[j]
        i, j = i[differ], j[differ]
        tail = np.minimum(e["n"][i] - e["at"][i], e["n"][j] - e["at"][j]).astype(np.int64)
        ok = tail * (NUM + DEN) >= NUM * (e["n"][i].astype(np.int64) + e["n"][j])
        i, j = i[ok], j[ok]
        ok, apart = _alike(e, i, j)
        i, j, apart = i[ok], j[ok], apart[ok]
        if not whole:
            by = np.argsort(apart, kind="stable")
            i, j, apart = i[by], j[by], apart[by]
            some = forest.join(comp[i], comp[j])
            i, j, apart = i[some], j[some], apart[some]
        for out, x in zip(found, (i, j, apart)):
            out.append(x)
    return _edges(e, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column("x"), b.column("y"), strict=True):
            z = np.concatenate([np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")])
            z.sort()
            both = int((z[1:] == z[:-1]).sum())
            ok.append(both * DEN >= NUM * (len(z) - both))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids of the edges whose sets are similar enough."""
    for c, data in ("ax", "by"):
        edges = edges.join(sets.select(F.col("doc").alias(c), F.col("p").alias(f"{c}p"), F.col("tokens").alias(data)), [c, f"{c}p"])
    return stash(edges.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long").distinct())


def _repeated(known: DataFrame) -> DataFrame:
    """(doc_id, several) of the ids of several rows: whether these have different sets."""
    low = [F.min(c) != F.max(c) for c in ("n", "p", "q")]
    return stash(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), (low[0] | low[1] | low[2]).alias("several")).where("k > 1").drop("k"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id integer, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = stash(rows.mapInArrow(_profile, "doc_id long, n long, p long, q long, hash long, c long"))
    known = profile.where("doc_id is not null")
    total = known.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).first()
    top = (
        profile.where("hash is not null").groupBy("hash").agg(F.sum("c").alias("c"))
        .where(F.col("c") > max(8, total["docs"] // FREQUENT_SHARE)).orderBy(F.desc("c"), "hash").limit(FREQUENT_MOST)
    )
    frequent = np.sort(np.array([r["hash"] for r in top.toLocalIterator()], np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(frequent)
    least = shuffle_partitions(spark)
    buckets = n_buckets((total["n"] or 0) * 3 // 8, least)
    classes = stash(known.where("n > 0").groupBy("n", "p", "q").agg(F.min("doc_id").alias("first")))
    again = _repeated(known)
    several = known.where("n > 0").join(again.where("several"), "doc_id").join(classes, ["n", "p", "q"])
    links = stash(several.select(F.col("doc_id").alias("a"), F.col("first").alias("b")).where("a <> b").distinct())

    # the sets that may have a partner
    chosen = _meeting(rows.mapInArrow(lambda it: _prefixes(it, shared.value, buckets), SCHEMA), False, buckets)
    # what is joined to texts and sets grows with the corpus, so the plan is the same at every size
    texts = rows.join(chosen.select(F.col("doc").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "doc long, p long, n long, sign binary, tokens binary")
    if not again.isEmpty():
        sets = sets.dropDuplicates(["doc", "p"])
    sets = stash(sets)
    shingles = sets.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()

    # sets chosen by chance
    buckets = n_buckets(shingles["k"] * ANCHORS * 4, least)
    heads = sets.mapInArrow(lambda it: _anchors(it, buckets), SCHEMA).groupBy("bucket").applyInArrow(_heads, EDGES)
    best = heads.groupBy("b", "bp").agg(F.slice(F.sort_array(F.collect_set(F.struct("apart", "a", "ap"))), 1, BEST).alias("x"))
    edges = stash(best.select("b", "bp", F.explode("x").alias("x")).select("x.a", "x.ap", "b", "bp"))
    links = links.unionByName(verified(edges, sets))
    stars = _stars(links)

    # the rest, exactly
    labels = stars.select(F.col("a").alias("doc"), F.col("b").alias("component"))
    labelled = lambda some: some.join(labels.hint("merge"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    buckets_left = n_buckets((shingles["n"] or 0) * 3 // 8, least)
    left = _meeting(labelled(sets).mapInArrow(lambda it: _labelled_prefixes(it, shared.value, buckets_left), SCHEMA), True, buckets_left)
    rest = stash(sets.join(left.hint("merge"), ["doc", "p"], "left_semi"))
    many = n_buckets(int(rest.agg(F.sum("n")).first()[0] or 0) * 2, least)
    meet = lambda whole: labelled(rest).mapInArrow(lambda it: _keys(it, shared.value, many), SCHEMA).groupBy("bucket").applyInArrow(lambda t: _links(t, whole), EDGES)
    edges = stash(meet(False).select("a", "ap", "b", "bp").distinct())
    good = verified(edges, sets)
    stars = _stars(stars.unionByName(good))
    labels = stars.select(F.col("a").alias("doc"), F.col("b").alias("component"))
    failed = edges.select("a", "b").distinct().join(good, ["a", "b"], "left_anti")
    for c in "ab":
        failed = failed.join(labels.select(F.col("doc").alias(c), F.col("component").alias(f"c{c}")), c, "left")
    if not failed.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).isEmpty():
        edges = stash(meet(True).select("a", "ap", "b", "bp").distinct())
        stars = _stars(stars.unionByName(verified(edges, sets)))

    node = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    of_class = classes.join(node, classes["first"] == node["node"], "left").select("n", "p", "q", F.coalesce("component", "first").alias("component_id"))
    worded = known.where("n > 0").select("doc_id", "n", "p", "q").join(of_class, ["n", "p", "q"])
    blank = known.where("n = 0").select("doc_id", "n").join(node, F.col("doc_id") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    out = [x.select("doc_id", F.col("n").alias("n_shingles"), "component_id") for x in (worded, blank)]
    return out[0].unionByName(out[1]).unionByName(_without_id(rows))


def _stars(links: DataFrame) -> DataFrame:
    """The components of links as (node, smallest node) links, itself included."""
    return stash(connected_components(links).select(F.col("node").alias("a"), F.col("component").alias("b")))


def _without_id(rows: DataFrame) -> DataFrame:
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, n, _, off in words.shingle_sets(b.column("text"), WORDS):
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(np.diff(off), pa.int64()), pa.nulls(n, pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    return rows.where("doc_id is null").mapInArrow(sizes, "doc_id long, n_shingles long, component_id long")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
