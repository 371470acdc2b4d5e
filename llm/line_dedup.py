"""Line dedup: an exact set-similarity join of lines, and removal of later matches.

A line is the set of its words, ASCII-lower-cased. A line is removed if an earlier one, in the
order (doc_id, hash of the text, position), has the same set or a set with Jaccard of at least
``num / den``; whether that earlier line is itself removed makes no difference, so the result does not
depend on how the work is split. Lines without a word stay.

Words are ordered by rarity: a table of fixed size holds the number of lines in which the words of
each of 2^18 hash ranges occur, over the whole corpus, and decides the order only (a coarse count
costs time, never a match). With that order:

1. lines with equal sets are one class (by two 64-bit hashes of the set), whose first line is known;
   a task keeps the first line of a class only, so a line found everywhere costs a row a task;
2. *prefix filter*: each class goes, packed by hash range, to where the classes with one of its first
   n - ceil(n num / den) + 1 words meet. There the *length* and *positional* filters and a
   128-bit parity bitmap leave the earlier classes that may be similar, and each class gets the few that
   look most alike. Where many classes meet, they are first held against the earliest ones, and those that look like
   one of these are not held against all others: a group of near copies is not expanded into all its pairs;
3. the whole sets of all candidates are taken from the texts again, in one pass that exchanges only texts with such lines;
   for each class its likeliest earlier class is verified on them, then the other candidates of classes without a match;
4. a class that still has no match, but had more candidates than it got, is held against every class
   that it meets, without a limit. So nothing is lost.

Null ids: the text is returned as it is and takes no part. Null text: null text, no line.
Repeated rows (same id and text) are one document and are all cut alike; different texts of one id are
told apart by a 32-bit hash. Empty tables give empty results; other columns of the input pass through, whatever their
names; columns n_lines and n_removed of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .packed import WINDOW_BYTES, bucket_of, n_buckets, pack, pairs_within, unpack
from .tables import read, shuffle_partitions, stash

NUM, DEN = 80, 100
RANGES = 1 << 18
SLICES = 64
#: Candidates that a class gets in one place before it is known whether the likeliest holds; and where that one is not surely similar.
AT_FIRST, UNSURE = 16, 512
#: A candidate is surely similar if its parities tell of no more than this share of the differences allowed.
SURE = 0.6
#: Where more classes than this meet, they are held against the earliest ones first, so many times.
MANY, SWEEPS = 64, 6
PAIRS_AT_ONCE = 400_000
#: Keys that are broadcast (8 bytes each) to send only what is asked for; beyond that everything is sent.
MOST_KEYS = 1 << 20
#: Bits of the map of asked texts, in maps of 2^15 (2 MB in all, broadcast).
ASKED_BITS = 1 << 24

#: A size or place of 65535 stands for any from there on, which passes the filters. Keys of one bucket are told apart by 32 bits.
LARGE = 65535
KEY = (("key", "<u4", 1), ("p", "<i8", 1), ("s", "<u8", 1), ("t", "<u8", 1), ("n", "<u2", 1), ("at", "<u2", 1), ("doc", "<i8", 1), ("h", "<i4", 1), ("pos", "<i4", 1))
GONE = (("doc", "<i8", 1), ("h", "<i4", 1), ("pos", "<i4", 1))
PARTS = "bucket int, data binary, gone binary, ask binary"
FOUND = "yp long, ys long, ydoc long, yh int, ypos int, xp long, xs long, xdoc long, xh int, xpos int, apart int, more boolean, gone binary"


def line_starts(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all lines and the end of all text, index of the first line of each row)."""
    breaks = np.flatnonzero(raw == 10)
    first = np.arange(len(off) - 1) + np.searchsorted(breaks, off[:-1])
    starts = np.empty(len(off) - 1 + len(breaks) + 1, np.int64)
    starts[-1] = off[-1]
    own = np.zeros(len(starts) - 1, bool)
    own[first] = True
    starts[:-1][own] = off[:-1]
    starts[:-1][~own] = breaks + 1
    return starts, first


def _range(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 18)).astype(np.int64)


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, off = words.text_bytes(b.column("text"))
    for i, j in words.pieces(off):
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(RANGES, np.int64)
    held: list[np.ndarray] = []
    size = 0

    def add() -> None:
        nonlocal size
        if held:
            total[:] += np.bincount(np.concatenate(held), minlength=RANGES)
        held.clear()
        size = 0

    for b in batches:
        for _, _, raw, off in _pieces(b):
            s, e, _ = words.word_spans(raw, off)
            held.append(_range(words.hash_spans(raw, s, e, True)))
            size += len(s)
            if size > 4 * RANGES:
                add()
    add()
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())], names=["slice", "counts"])


def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(RANGES // SLICES, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_buffer(), np.int64)
    return pa.table({"slice": table.column("slice").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def rarity(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(the rarity class, 0 to 255, of each hash range: 8 steps for each doubling of its count, words in all)."""
    rows = texts.mapInArrow(_counts, "slice int, counts binary").groupBy("slice").applyInArrow(_sum, "slice int, counts binary")
    total = np.zeros((SLICES, RANGES // SLICES), np.int64)
    for r in rows.toLocalIterator():  # 2 MB, whatever the corpus
        total[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(np.log2(total.ravel() + 1) * 8, 255).astype(np.uint64), int(total.sum())


class Lines:
    """The lines with a word of a piece of text: distinct words of each, rarest first, and its identity."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, rare: np.ndarray, split: bool = True):
        starts, first = line_starts(raw, off) if split else (off, np.arange(len(off) - 1))
        s, e, line = words.word_spans(raw, starts)
        h = words.hash_spans(raw, s, e, True)
        h = (rare[_range(h)] << np.uint64(56)) | (h >> np.uint64(8))
        h, line = words.distinct(h, line, len(starts) - 1)
        count = np.bincount(line, minlength=len(starts) - 1)
        self.line = np.flatnonzero(count)  # among all lines of the piece
        self.n = count[self.line]
        self.doc = np.searchsorted(first, self.line, "right") - 1
        self.at = self.line - first[self.doc]
        self.words, self.off = h, np.concatenate([[0], np.cumsum(self.n)])
        m = words.mix(h)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(m)])
        self.print = (total[self.off[1:]] - total[self.off[:-1]]).view(np.int64)
        bit = np.uint64(1) << (m & np.uint64(63))
        half = (m >> np.uint64(6)) & np.uint64(1) == 1
        parity = lambda x: np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), self.off[:-1]).view(np.int64) if len(h) else np.zeros(0, np.int64)
        self.bits, self.more_bits = parity(half), parity(~half)


def _blobs(part: pa.RecordBatch, column: str) -> pa.RecordBatch:
    """Packed rows as one of the columns that go to a bucket."""
    none = pa.nulls(len(part), pa.binary())
    return pa.RecordBatch.from_arrays([part.column("bucket"), *[part.column("data") if c == column else none for c in ("data", "gone", "ask")]], names=["bucket", "data", "gone", "ask"])


def _prefix(x: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, word) of the prefix of each line."""
    length = x.n - -(-x.n * NUM // DEN) + 1
    row = np.repeat(np.arange(len(x.n)), length)
    at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    return row, at, x.words[x.off[row] + at]


def _columns(line: dict[str, np.ndarray], row: np.ndarray, at: np.ndarray, key: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[row] for k, v in line.items()} | {"n": np.minimum(line["n"], LARGE)[row], "key": words.mix(key), "at": np.minimum(at, LARGE)}


def _bucketed(e: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    return pack(KEY, e | {"key": e["key"] & np.uint64(0xFFFFFFFF)}, bucket_of(e["key"], buckets))


def _elsewhere(e: dict[str, np.ndarray], o: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of rows in the order ``o`` those that are not the first of their group, nor a repetition of its place."""
    head = o[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(o) else o
    return o[np.logical_or.reduce([e[k][o] != e[k][head] for k in ("doc", "h", "pos")])]


def _entries(batches: Iterator[pa.RecordBatch], rare: np.ndarray, buckets: int, only: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Packed prefix entries of the first line of each class of a window, and the places of its other lines.

    ``only``: sorted keys; entries under others are left out."""
    held: list[tuple] = []
    size = n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        line = {k: np.concatenate([x[0][k] for x in held]) for k in held[0][0]}
        row, at, key = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
        held.clear()
        o = np.lexsort((line["pos"], line["h"], line["doc"], line["s"], line["p"]))
        p, s = line["p"][o], line["s"][o]
        first = np.ones(len(o), bool)
        first[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
        other = _elsewhere(line, o, first)
        if len(other):
            gone = {k: line[k][other] for k in ("doc", "h", "pos")}
            yield _blobs(pack(GONE, gone, bucket_of(words.mix(gone["doc"].view(np.uint64)), buckets)), "gone")
        keep = np.zeros(len(o), bool)
        keep[o[first]] = True
        some = keep[row]
        e = _columns(line, row[some], at[some], key[some])
        if only is not None:
            hit = only[np.minimum(np.searchsorted(only, e["key"]), len(only) - 1)] == e["key"]
            e = {k: v[hit] for k, v in e.items()}
        yield _blobs(_bucketed(e, buckets), "data")

    for b in batches:
        ids, texts = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("h").to_numpy(zero_copy_only=False)
        for i, _, raw, off in _pieces(b):
            x = Lines(raw, off, rare)
            row, at, key = _prefix(x)
            line = {"p": x.print, "s": x.bits.view(np.uint64), "t": x.more_bits.view(np.uint64), "n": x.n, "doc": ids[i + x.doc], "h": texts[i + x.doc], "pos": x.at}
            held.append((line, row + n, at, key))
            n, size = n + len(x.n), size + len(row) * 46
            if size > WINDOW_BYTES:
                yield from flush()
                size = n = 0
    if held:
        yield from flush()


def _alike(e: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs that can be similar by length, position and parity, places in which the parities of these differ, which are surely similar)."""
    n, m = e["n"][i], e["n"][j]
    tail = np.minimum(n - e["at"][i], m - e["at"][j])
    any_size = (n == LARGE) | (m == LARGE)
    ok = np.flatnonzero((np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM) & (tail * (NUM + DEN) >= NUM * (n + m)) | any_size)
    a, b, both = i[ok], j[ok], (n + m)[ok]
    apart = np.bitwise_count(e["s"][a] ^ e["s"][b]).astype(np.int64) + np.bitwise_count(e["t"][a] ^ e["t"][b])
    some = ((both - apart) * (NUM + DEN) >= 2 * NUM * both) | any_size[ok]
    apart, both = apart[some], both[some]
    likely = -64 * np.log(np.maximum(1 - apart / 64, 1e-9))  # differences that show in so many of 128 places
    return ok[some], apart, likely * (NUM + DEN) <= SURE * (DEN - NUM) * both


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _group_sizes(key: np.ndarray) -> np.ndarray:
    """How many rows have the key of each row; keys are sorted."""
    start = np.flatnonzero(_first_of(key)) if len(key) else key[:0].astype(np.int64)
    size = np.diff(np.append(start, len(key)))
    return np.repeat(size, size)


def _place(e: dict[str, np.ndarray]) -> np.ndarray:
    """Text and position as one number of the same order."""
    return (e["h"].astype(np.int64) << 32) + e["pos"]


def _by_class(e: dict[str, np.ndarray], asks: np.ndarray) -> np.ndarray:
    """Rows by key, class and place, of equal places that which asks first. One sort by key and half a class's hash; only rows that are alike in these are compared by the rest."""
    half = (e["key"].astype(np.uint64) << np.uint64(32)) | (e["p"].view(np.uint64) >> np.uint64(32))
    o = np.argsort(half)
    some = np.flatnonzero(_group_sizes(half[o]) > 1)
    x = o[some]
    o[some] = x[np.lexsort((~asks[x], _place({k: e[k][x] for k in ("h", "pos")}), e["doc"][x], e["s"][x], e["p"][x], half[x]))]
    return o


def _match(table: pa.Table) -> pa.Table:
    """What a bucket finds: candidates (y, x) where x is an earlier class than y, and places of lines that have an equal one before them.

    Where classes ask, only they get candidates, and all of them."""
    asking = table.column("ask").null_count < len(table)
    e = unpack(KEY, table.column("data").drop_null())
    asked = unpack(KEY, table.column("ask").drop_null())
    e = {k: np.concatenate([e[k], asked[k]]) for k in e}
    asks = np.arange(len(e["key"])) >= len(e["key"]) - len(asked["key"])
    e = {k: v.astype(np.int64) if k in ("n", "at") else v for k, v in e.items()}
    o = _by_class(e, asks)
    first = _first_of(*(e[k][o] for k in ("key", "p", "s")))
    again = _elsewhere(e, o, first)
    again = again[(e["at"][again] == 0) & ~asks[again]]
    gone = pack(GONE, {k: e[k][again] for k in ("doc", "h", "pos")}, np.zeros(len(again), np.int32)).column("data").to_pylist()
    if not asking:
        gone += table.column("gone").drop_null().to_pylist()
    else:
        gone = []
    o = o[first]
    o = o[_group_sizes(e["key"][o]) > 1]  # a class alone under a key meets none
    e, asks = {k: v[o] for k, v in e.items()}, asks[o]
    rank = np.empty(len(o), np.int64)
    rank[np.lexsort((_place(e), e["doc"]))] = np.arange(len(o))
    o = np.argsort(e["key"].astype(np.int64) << 16 | e["n"])
    size_of = _group_sizes(e["key"][o])
    found: tuple[list, ...] = ([], [], [], [])

    def add(*columns: np.ndarray) -> None:
        for out, v in zip(found, columns):
            out.append(v)

    times = np.zeros(len(o), np.int64)  # how often a class surely looks like one of the earliest under a key
    if not asking:
        left = o[size_of > MANY]
        left = left[np.lexsort((rank[left], e["key"][left]))]
        for _ in range(SWEEPS):
            new = _first_of(e["key"][left]) if len(left) else np.zeros(0, bool)
            head, other = left[np.flatnonzero(new)[np.cumsum(new) - 1]][~new], left[~new]
            ok, apart, sure = _alike(e, other, head)
            add(other[ok], head[ok], apart, sure)
            times[other[ok[sure]]] += 1
            left = other[times[other] < 2]
    settled = times > 1
    g = (np.cumsum(_first_of(e["key"][o])) << 33) if len(o) else o
    n = e["n"][o]
    for i, j in pairs_within(np.arange(1, len(o) + 1), np.searchsorted(g + n, g + n * DEN // NUM, "right"), PAIRS_AT_ONCE):
        i, j = o[i], o[j]
        later = rank[i] > rank[j]
        y, x = np.where(later, i, j), np.where(later, j, i)
        some = asks[y] if asking else ~settled[y]
        y, x = y[some], x[some]
        ok, apart, sure = _alike(e, y, x)
        add(y[ok], x[ok], apart, sure)
    y, x, apart, sure = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in found)
    # a class may stand under several keys of the bucket
    lead = np.full(len(rank), -1)
    by = np.lexsort((e["s"], e["p"]))
    same = np.cumsum(_first_of(e["p"][by], e["s"][by])) - 1 if len(by) else by
    lead[by] = by[np.flatnonzero(np.diff(same, prepend=-1))][same] if len(by) else by
    more = np.zeros(len(rank), bool)
    np.logical_or.at(more, lead, settled)
    y, x = lead[y], lead[x]
    by = np.lexsort((rank[x], apart, y))
    y, x, apart, sure = y[by], x[by], apart[by], sure[by]
    pair = np.unique(y * np.int64(max(len(rank), 1)) + x, return_index=True)[1]
    pair.sort()
    y, x, apart, sure = y[pair], x[pair], apart[pair], sure[pair]
    if not asking and len(y):
        best = np.maximum.accumulate(np.where(_first_of(y), np.arange(len(y)), 0))
        keep = np.arange(len(y)) - best < np.where(sure[best], AT_FIRST, UNSURE)
        more[y[~keep]] = True
        y, x, apart = y[keep], x[keep], apart[keep]
    cols = {f"{c}{k}": e[f][v] for c, v in (("y", y), ("x", x)) for k, f in (("p", "p"), ("s", "s"), ("doc", "doc"), ("h", "h"), ("pos", "pos"))}
    cols = {k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for k, v in cols.items()} | {"apart": pa.array(apart.astype(np.int32)), "more": pa.array(more[y])}
    rows = pa.table(cols).append_column("gone", pa.nulls(len(y), pa.binary()))
    only = pa.table({**{f.name: pa.nulls(len(gone), f.type) for f in rows.schema if f.name != "gone"}, "gone": pa.array(gone, pa.binary())})
    return pa.concat_tables([rows, only])


def _asked(batches: Iterator[pa.RecordBatch], rare: np.ndarray) -> Iterator[tuple[np.ndarray, Lines]]:
    """(number in the batch, asked lines) of texts with the places that are asked of each, as ``Lines`` of one text a line."""
    for b in batches:
        raw, off = words.text_bytes(b.column("text"))
        rows, parts = [], []
        for k, asked in enumerate(b.column("asked").to_pylist()):
            text = raw[off[k] : off[k + 1]]
            starts, _ = line_starts(text, np.array([0, len(text)]))
            for at in asked:
                rows.append((k, at))
                parts.append(text[starts[at] : starts[at + 1]])
        ends = np.cumsum([0, *map(len, parts)])
        x = Lines(np.concatenate([*parts, np.zeros(0, np.uint8)]), ends, rare, False)
        at = np.array(rows, np.int64).reshape(-1, 2)[x.line]
        yield b, at, x


def _tokens(batches: Iterator[pa.RecordBatch], rare: np.ndarray) -> Iterator[pa.RecordBatch]:
    for _, _, x in _asked(batches, rare):
        data = [x.words[i:j].tobytes() for i, j in zip(x.off.tolist(), x.off[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(x.print), pa.array(x.bits), pa.array(data, pa.binary())], names=["p", "s", "tokens"])


def _asking(batches: Iterator[pa.RecordBatch], rare: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed prefix entries of asked lines, as questions."""
    for b, at, x in _asked(batches, rare):
        ids, texts = (b.column(c).to_numpy(zero_copy_only=False)[at[:, 0]] for c in ("doc_id", "h"))
        line = {"p": x.print, "s": x.bits.view(np.uint64), "t": x.more_bits.view(np.uint64), "n": x.n, "doc": ids, "h": texts, "pos": at[:, 1]}
        e = _columns(line, *_prefix(x))
        yield _blobs(_bucketed(e, buckets), "ask")


def _asked_keys(batches: Iterator[pa.RecordBatch], rare: np.ndarray) -> Iterator[pa.RecordBatch]:
    for _, _, x in _asked(batches, rare):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(words.mix(_prefix(x)[2])).view(np.int64))], names=["key"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column("tx"), b.column("ty"), strict=True):
            z = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
            z.sort()
            both = int((z[1:] == z[:-1]).sum())
            ok.append(both * DEN >= NUM * (len(z) - both))
        yield b.drop_columns(["tx", "ty"]).filter(pa.array(ok, pa.bool_()))


def _asked_bits(doc: str, h: str) -> tuple[Column, Column]:
    """(number of the map, place in it) of the bit that stands for a text."""
    bit = F.pmod(F.xxhash64(F.col(doc).cast("long"), h), F.lit(ASKED_BITS))
    return F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)


def _maybe_asked(texts: DataFrame, asks: DataFrame) -> DataFrame:
    """The texts of ``asks``, and few others: those whose bit is set in a map of fixed size."""
    number, place = _asked_bits("doc", "h")
    bits = asks.groupBy(number.alias("number")).agg(F.bitmap_construct_agg(place).alias("bits"))
    number, place = _asked_bits("doc_id", "h")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    some = texts.withColumns({"number": number, "place": place}).join(F.broadcast(bits), "number")
    return some.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*texts.columns)


def _with_asked(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The texts of which lines are asked, with the places (doc, h, pos) of these. Only what `_maybe_asked` leaves is exchanged."""
    asks = stash(places.groupBy("doc", "h").agg(F.collect_set("pos").alias("asked")))
    own = asks.select(F.col("doc").alias("doc_id"), "h", "asked").hint("shuffle_hash")
    return _maybe_asked(texts, asks).join(own, ["doc_id", "h"]).select("doc_id", "h", "text", "asked")


def _sets(pairs: DataFrame, texts: DataFrame, rare) -> DataFrame:
    """(p, s, tokens): the whole sets of the classes of pairs, taken from the texts."""
    place = lambda c: pairs.select(*[F.col(f"{c}{k}").alias(k) for k in ("doc", "h", "pos")])
    asked = _with_asked(texts, place("x").unionByName(place("y")))
    sets = asked.mapInArrow(lambda it: _tokens(it, rare.value), "p long, s long, tokens binary")
    return stash(sets.groupBy("p", "s").agg(F.any_value("tokens").alias("tokens")))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The classes y, with their places, of the pairs whose sets are similar."""
    on = lambda c: sets.select(F.col("p").alias(f"{c}p"), F.col("s").alias(f"{c}s"), F.col("tokens").alias(f"t{c}"))
    rows = pairs.join(on("x"), ["xp", "xs"]).join(on("y"), ["yp", "ys"]).select("yp", "ys", "ydoc", "yh", "ypos", "tx", "ty")
    return stash(rows.mapInArrow(_verify, "yp long, ys long, ydoc long, yh int, ypos int").distinct())


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pydict(unpack(GONE, b.column("gone")))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc, h, cut): the line positions, from 0, to remove from the text with hash h of a document."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("h"), "text")
    table, n_words = rarity(rows.select("text"))
    rare = spark.sparkContext.broadcast(table)
    buckets = n_buckets(n_words // 5, shuffle_partitions(spark))
    entries = rows.mapInArrow(lambda it: _entries(it, rare.value, buckets), PARTS)
    found = stash(entries.groupBy("bucket").applyInArrow(_match, FOUND))
    y, x = ["yp", "ys", "ydoc", "yh", "ypos"], ["xp", "xs", "xdoc", "xh", "xpos"]
    candidates = found.where("gone is null").select(*y, *x, "apart", "more")

    best = stash(candidates.groupBy(*y).agg(F.min(F.struct("apart", *x)).alias("x"), F.max("more").alias("more")).select(*y, "x.*", "more"))
    sets = _sets(candidates, rows, rare)
    near = _verified(best.select(*y, *x), sets)
    others = candidates.join(near, ["yp", "ys"], "left_anti").join(best.select("yp", "ys", "xp", "xs"), ["yp", "ys", "xp", "xs"], "left_anti")
    others = stash(others.select(*y, *x).distinct())
    if not others.isEmpty():
        near = near.unionByName(_verified(others, sets))
    open_ = stash(best.where("more").join(near, ["yp", "ys"], "left_anti").select(F.col("ydoc").alias("doc"), F.col("yh").alias("h"), F.col("ypos").alias("pos")))
    if not open_.isEmpty():
        asked = _with_asked(rows, open_)
        asks = asked.mapInArrow(lambda it: _asking(it, rare.value, buckets), PARTS)
        keys = stash(asked.mapInArrow(lambda it: _asked_keys(it, rare.value), "key long").distinct())
        only = np.sort(keys.toArrow().column("key").to_numpy().view(np.uint64)) if keys.count() <= MOST_KEYS else None
        some = spark.sparkContext.broadcast(only)
        entries = rows.mapInArrow(lambda it: _entries(it, rare.value, buckets, some.value), PARTS)
        all_found = entries.where("data is not null").unionByName(asks).groupBy("bucket").applyInArrow(_match_asked, FOUND)
        pairs = stash(all_found.select(*y, *x).distinct())
        near = near.unionByName(_verified(pairs, _sets(pairs, rows, rare)))

    gone = found.where("gone is not null").select("gone").mapInArrow(_places, "doc long, h int, pos int")
    gone = gone.unionByName(near.select(F.col("ydoc").alias("doc"), F.col("yh").alias("h"), F.col("ypos").alias("pos")))
    return gone.groupBy("doc", "h").agg(F.collect_set("pos").alias("cut"))


def _match_asked(table: pa.Table) -> pa.Table:
    """Candidates of the classes that ask; a bucket without one has none."""
    if table.column("ask").null_count == len(table):
        table = table.slice(0, 0)
    return _match(table)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later lines cut from ``text``, and n_lines and n_removed of each row."""
    cuts = stash(removed_lines(docs)).hint("shuffle_hash")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.hash("text").alias("h")).join(cuts, ["doc", "h"], "left")
    text, cut = F.col("row").getField("text"), F.col("cut")
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    kept = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut), lambda k: F.get(lines, k))
    left = F.array_join(F.element_at(F.transform(F.array(F.split(text, "\n", -1)), kept), 1), "\n")
    some = cut.isNotNull() & text.isNotNull()
    rows = rows.select("row", F.when(some, left).otherwise(text).alias("text"), n_lines.cast("long").alias("n_lines"), F.when(some, F.size(cut)).otherwise(0).cast("long").alias("n_removed"))
    new = {"text", "n_lines", "n_removed"}
    other = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in new]
    return rows.select(*other, *sorted(new, key=["text", "n_lines", "n_removed"].index))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
