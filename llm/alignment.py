"""Alignment of two tokenizers: where both end a token, and how often their tokens meet.

A text with a space before it is encoded by a byte-level BPE (A) and by a piece model (B). A byte offset at which tokens of
both end is a shared cut; the cuts part the tokens into groups, and every A token of a group is linked with every B
token of it. The cuts are found by divide and conquer: in an interval, the end of an A token nearest to the middle that
bisect also finds among the ends of B; both halves follow, and an interval without such an end is one group.

No token of either vocabulary goes from a character that is no white space over to a space or line feed, or from a letter
over to a punctuation mark (checked when the vocabularies are loaded: other places are not cut), so texts are first cut
there, at places that need no search, and each distinct chunk is encoded and aligned once a worker, which remembers a bounded number of them. Texts with
rarer white space are encoded and aligned whole. Chunks are told apart by 64-bit fingerprints.

How many documents hold a pair of ids linked is counted over the whole corpus. Of these counts, the most frequent
``FREQUENT`` pairs and the highest count of each A id (as many as A has tokens) are broadcast, both of a size fixed by
parameters; links of rarer pairs are joined to their counts by Spark. The result does not depend on which are which.

Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens. Special tokens in
texts are plain text. Ties for the highest count all count. Repeated rows are documents of their own; an empty table
gives no rows; other columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from string import ascii_letters, punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .bpe import byte_alphabet
from .tables import read, stash

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts are broadcast (16 bytes each).
FREQUENT = 1 << 18
#: Chunks, and links of theirs, that a worker remembers.
CHUNKS, LINKS = 400_000, 4_000_000
#: White space that is looked at whole.
_ODD = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WHITE = " \t\n\r\x0b\x0c"


def default_paths() -> tuple[str, str]:
    """The public vocabulary files; users pass their own paths to `align` instead."""
    import public_tokenizers

    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


def shared_groups(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """(first A, past last A, first B, past last B) of each group, in order; ``a`` and ``b`` are the ends of tokens and have their last in common."""
    groups = []
    todo = [(0, len(a), 0, len(b))] if a else []
    while todo:
        i, j, k, m = todo.pop()
        if j - i == 1 or m - k == 1:  # no end inside
            groups.append((i, j, k, m))
            continue
        low = at = (i + j - 1) // 2
        high, most = at + 1, j - 1
        while True:  # outward from the middle; the last end is shared anyway
            if at < most:
                other = bisect_left(b, a[at], k, m - 1)
                if other < m - 1 and b[other] == a[at]:
                    todo.append((at + 1, j, other + 1, m))
                    todo.append((i, at + 1, k, other + 1))
                    break
            if low > i and (high >= most or at == low or at - low <= high - at):
                low -= 1
                at = low
            elif high < most:
                at = high
                high += 1
            else:
                groups.append((i, j, k, m))
                break
    return groups


class Pair:
    """Both tokenizers, and what a worker remembers of chunks."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: k for k, c in enumerate(byte_alphabet())}
        plain = lambda t: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.a_bytes = {i: plain(t) for t, i in self.a.get_vocab(True).items()}
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.codes = size
        self.a_text, self.b_text = {i: str(i) for i in self.a_bytes}, [str(i) for i in range(size)]
        #: Bytes before which a chunk may begin: no token holds one of them after a character that is no white space, or, of the marks, after a letter.
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        tokens = [t for i, t in self.a_bytes.items() if self.a.id_to_token(i) not in special] + [t for i, t in enumerate(self.b_bytes) if not (self.b.is_control(i) or self.b.is_unknown(i))]
        inside = {t[k] for t in (t.decode(errors="replace") for t in tokens) for k in range(1, len(t)) if t[k] in " \n" and not t[k - 1].isspace()}
        self.begins = np.zeros(256, bool)
        self.begins[[ord(c) for c in " \n" if c not in inside]] = True
        self.letter = np.zeros(256, bool)
        self.letter[list(ascii_letters.encode())] = True
        # a letter's last byte, also of the letters from U+00C0 to U+00FF, which are 0xC3 and one more byte
        tail = lambda t, k: self.letter[t[k]] or 0x80 <= t[k] < 0xC0 and (k == 0 or t[k - 1] == 0xC3)
        after = {t[k] for t in tokens for k in range(1, len(t)) if t[k] < 0x80 and tail(t, k - 1)}
        self.marks = np.zeros(256, bool)
        self.marks[[c for c in punctuation.encode() if c not in after]] = True
        self.white = np.zeros(256, bool)
        self.white[list(_WHITE.encode())] = True
        self.forget()

    def forget(self) -> None:
        self.at: dict[int, int] = {}
        self.text: list[str] = []
        #: Tokens of A, of B, groups, links, and whether both give the bytes back, of each chunk.
        self.numbers = array("q")
        #: The distinct links of the chunks end to end, how often each is there, and where each chunk's end.
        self.pairs, self.times, self.ends = array("Q"), array("q"), array("q", [0])

    def _aligned(self, raw: bytes, a: list[int], b: list[int]) -> tuple[tuple[int, int, int, int, int], str, dict[int, int]]:
        """Numbers (tokens of A, of B, groups, links, 1 if both give the bytes back), groups as text, and the distinct links with how often each is there."""
        x, y = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(x) != raw or b"".join(y) != raw:
            return (0, 0, 0, 0, 0), "", {}
        codes, left, right = self.codes, self.a_text, self.b_text
        if len(a) == 1 and len(b) == 1:
            return (1, 1, 1, 1, 1), f"{left[a[0]]}|{right[b[0]]}", {a[0] * codes + b[0]: 1}
        groups = shared_groups(list(accumulate(map(len, x))), list(accumulate(map(len, y))))
        found: dict[int, int] = {}
        n, out = 0, []
        for i, j, k, m in groups:
            if j - i == 1 and m - k == 1:
                p = a[i] * codes + b[k]
                found[p] = found.get(p, 0) + 1
                n += 1
                out.append(f"{left[a[i]]}|{right[b[k]]}")
                continue
            n += (j - i) * (m - k)
            out.append(f"{','.join([left[t] for t in a[i:j]])}|{','.join([right[t] for t in b[k:m]])}")
            if (j - i) * (m - k) <= 64:
                for t in a[i:j]:
                    for q in b[k:m]:
                        p = t * codes + q
                        found[p] = found.get(p, 0) + 1
            else:  # a long group has few distinct ids
                ours, theirs = Counter(a[i:j]), Counter(b[k:m])
                for t, c in ours.items():
                    for q, d in theirs.items():
                        p = t * codes + q
                        found[p] = found.get(p, 0) + c * d
        return (len(a), len(b), len(groups), n, 1), ";".join(out), found

    def _b(self, texts: list[str]) -> list[list[int]]:
        """B's tokens of texts that begin where a token does; an x before each keeps the model from adding white space."""
        return [t[1:] for t in self.b.encode(["x" + t for t in texts], num_threads=1)]

    def learn(self, keys: list[int], chunks: list[bytes]) -> None:
        texts = [c.decode() for c in chunks]
        a = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        for key, raw, x, y in zip(keys, chunks, a, self._b(texts)):
            self.at[key] = len(self.text)
            numbers, text, links = self._aligned(raw, x, y)
            self.numbers.extend(numbers)
            self.text.append(text)
            self.pairs.extend(links)
            self.times.extend(links.values())
            self.ends.append(len(self.pairs))

    def whole(self, text: str) -> tuple[tuple[int, int, int, int, int], str, np.ndarray, np.ndarray]:
        """A text looked at as one chunk; its links are sorted."""
        numbers, groups, links = self._aligned(f" {text}".encode(), self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text, num_threads=1))
        p, t = np.fromiter(links, np.uint64, len(links)), np.fromiter(links.values(), np.int64, len(links))
        o = np.argsort(p)
        return numbers, groups, p[o], t[o]

    def piece(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, chunk) of each chunk of rows laid end to end, each with its space before it, and whether a row comes back byte for byte."""
        n = len(off) - 1
        first = np.zeros(len(raw), bool)
        letter = self.letter[raw]
        letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)  # but for the signs of multiplication and division
        first[1:] = self.begins[raw[1:]] & ~self.white[raw[:-1]] | self.marks[raw[1:]] & letter[:-1]
        first[off[:-1]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(raw))
        row = np.searchsorted(off, start, "right") - 1
        h, at, back = np.unique(words.hash_spans(raw, start, end, False), return_index=True, return_inverse=True)
        keys = h.tolist()
        if len(self.text) > CHUNKS or len(self.pairs) > LINKS:
            self.forget()
        new = [k for k, key in enumerate(keys) if key not in self.at]
        if new:
            s, e = start[at[new]].tolist(), end[at[new]].tolist()
            self.learn([keys[k] for k in new], [raw[i:j].tobytes() for i, j in zip(s, e)])
        own = [self.at[k] for k in keys]
        chunk = np.array(own, np.int64)[back]
        fine = np.ones(n, bool)
        known = np.array([self.numbers[5 * k + 4] for k in own], bool)[back]
        fine[row[~known]] = False
        return row, chunk, fine


@lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    """One table a Python worker."""
    return Pair(a_path, b_path)


def _within(ends: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the place in ``chunk``, the place in the table) of each entry of the chunks' runs, which end at ``ends``."""
    size = ends[chunk + 1] - ends[chunk]
    at = np.repeat(ends[chunk] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return np.repeat(np.arange(len(chunk)), size), at


def _row_links(pair: Pair, row: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, times) of the distinct links of each row, in order."""
    both, many = np.unique(row * len(pair.text) + chunk, return_counts=True)
    row, chunk = both // len(pair.text), both % len(pair.text)
    own, back = np.unique(chunk, return_inverse=True)  # copy what this piece needs, not all that is known
    ends = np.frombuffer(pair.ends, np.int64)
    _, at = _within(ends, own)
    pairs, times = np.frombuffer(pair.pairs, np.uint64)[at], np.frombuffer(pair.times, np.int64)[at]
    size = np.zeros(len(own) + 1, np.int64)
    np.cumsum(ends[own + 1] - ends[own], out=size[1:])
    of, at = _within(size, back)
    r, p, t = row[of], pairs[at], times[at] * many[of]
    del ends
    # distinct pairs get small codes, so that one sort of whole numbers orders rows and pairs
    names, code = np.unique(pairs, return_inverse=True)
    key = r * len(names) + code[at]
    o = np.argsort(key)
    key, t = key[o], t[o]
    first = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1]) if len(key) else np.zeros(0, np.int64)
    return key[first] // len(names), names[key[first] % len(names)], np.add.reduceat(t, first) if len(first) else t


def _align(batches: Iterator[pa.RecordBatch], paths: tuple[str, str] | None, groups_too: bool) -> Iterator[pa.RecordBatch]:
    pair = _pair(*(paths or default_paths()))
    for b in batches:
        given = pc.fill_null(b.column("text"), "")
        odd = pc.match_substring_regex(given, _ODD)
        raw, off = words.text_bytes(pc.binary_join_element_wise("", pc.if_else(odd, "", given), " "))  # a space before each
        odd = odd.to_numpy(zero_copy_only=False)
        there = pc.not_equal(given, "").to_numpy(zero_copy_only=False)
        for i, j in words.pieces(off):
            n = j - i
            row, chunk, fine = pair.piece(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            fine &= there[i:j] & ~odd[i:j]
            # a text of which some chunk does not come back is looked at whole, as one with rarer white space
            look = {k: pair.whole(given[i + k].as_py()) for k in np.flatnonzero(there[i:j] & ~fine).tolist()}
            keep = fine[row]
            row, chunk = row[keep], chunk[keep]
            numbers = np.zeros((n, 4), np.int64)
            if len(row):
                values = np.frombuffer(pair.numbers, np.int64).reshape(-1, 5)[chunk, :4]
                at = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
                numbers[row[at]] = np.add.reduceat(values, at, axis=0)
                r, p, t = _row_links(pair, row, chunk)
            else:
                r, p, t = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            cuts, ends = np.searchsorted(r, np.arange(n + 1)), np.searchsorted(row, np.arange(n + 1))
            names = pair.text
            texts, digests, links = [], [], []
            for k in range(n):
                if k in look:
                    numbers[k], text, q, u = look[k][0][:4], *look[k][1:]
                else:
                    q, u = p[cuts[k] : cuts[k + 1]], t[cuts[k] : cuts[k + 1]]
                    text = ";".join([names[c] for c in chunk[ends[k] : ends[k + 1]].tolist()])
                texts.append(text)
                digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
                links.append(q.tobytes() + u.astype(np.uint32).tobytes())
            out = [b.column("doc_id").slice(i, n), b.column("row").slice(i, n), *[pa.array(numbers[:, c]) for c in range(4)], pa.array(links, pa.binary()), *([pa.array(texts, pa.string())] if groups_too else []), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "links", *(["groups"] if groups_too else []), "groups_sha256"])


def _unpacked(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, times) of packed links."""
    size = np.array([len(x) // 12 for x in (v.as_buffer() if v.is_valid else b"" for v in col)], np.int64)
    values = [v.as_buffer() for v in col]
    pairs = np.concatenate([np.frombuffer(v, np.uint64, k) for v, k in zip(values, size.tolist())]) if len(values) else np.zeros(0, np.uint64)
    times = np.concatenate([np.frombuffer(v, np.uint32, k, 8 * k) for v, k in zip(values, size.tolist())]) if len(values) else np.zeros(0, np.uint32)
    return np.repeat(np.arange(len(size)), size), pairs, times.astype(np.int64)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p, n = np.unique(_unpacked(b.column("links"))[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])


def _scored(batches: Iterator[pa.RecordBatch], pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums over the links whose count is known here; ``best`` marks the pairs with the highest count of their A id."""
    for b in batches:
        row, p, t = _unpacked(b.column("links"))
        n = b.num_rows
        at = np.minimum(np.searchsorted(pairs, p), max(len(pairs) - 1, 0))
        here = pairs[at] == p if len(pairs) else np.zeros(len(p), bool)
        row, at, t = row[here], at[here], t[here]
        total, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(total, row, t * counts[at])
        np.add.at(top, row, t * best[at])
        keep = [c for c in b.schema.names if c != "links"]
        yield pa.RecordBatch.from_arrays([*map(b.column, keep), pa.array(top), pa.array(total)], names=[*keep, "n_best", "count_sum"])


def _rare(batches: Iterator[pa.RecordBatch], pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, p, t = _unpacked(b.column("links"))
        away = ~np.isin(p, pairs)
        yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(row[away])), pa.array(p[away].astype(np.int64)), pa.array(t[away])], names=["row", "pair", "times"])


def align(docs: DataFrame, paths: tuple[str, str] | None = None, groups_too: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, [groups,] groups_sha256.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``. n_best counts the links whose pair has the highest document count of its A id, count_sum adds
    the counts of all links. ``paths`` names both vocabulary files on every executor; None takes the installed public ones."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    more = "groups string, " if groups_too else ""
    numbers = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links"))
    found = stash(rows.mapInArrow(lambda it: _align(it, paths, groups_too), f"doc_id {kind}, row long, {numbers}, links binary, {more}groups_sha256 string"))
    codes = _codes(paths)
    counts = stash(found.select("links").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.floor(F.col("pair") / codes)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))  # at most a row a token of A
    marked = stash(counts.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best")))
    top = marked.orderBy(F.desc("n"), "pair").limit(frequent).toPandas().sort_values("pair")
    known = [top[c].to_numpy(np.uint64 if c == "pair" else np.int64) for c in ("pair", "n", "best")]
    shared = spark.sparkContext.broadcast(known)
    texts = [c for c in found.columns if c not in ("links", "groups_sha256", "groups")]
    last = ["groups"] * groups_too + ["groups_sha256"]
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*texts, *last).schema)
    scored = found.select(*texts, *last, "links").mapInArrow(lambda it: _scored(it, *shared.value), f"{kept}, n_best long, count_sum long")
    rare = found.select("row", "links").mapInArrow(lambda it: _rare(it, shared.value[0]), "row long, pair long, times long")
    more_of = rare.join(marked, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum"))
    d = scored.join(more_of, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return d.select(*[c for c in texts if c != "row"], (F.col("n_best") + zero("rare_best")).alias("n_best"), (F.col("count_sum") + zero("rare_sum")).alias("count_sum"), *last)


@lru_cache(maxsize=8)
def _codes(paths: tuple[str, str] | None) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=(paths or default_paths())[1]).get_piece_size()


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
