"""BPE encoding and decoding by prefix-sharing trie traversal.

Distinct words of a batch are put in depth-first trie order (sorting them *is* that order: a
word shares the path of its common prefix with the word before it). The traversal carries one
state a node: the last token of the encoding of the path so far. It follows from the states
above it: the last token is the one vocabulary entry that ends here and that BPE would not
merge with, or split from, the last token of what precedes it. A shared prefix is thus
encoded once, and a word's tokens are read off by walking the states back.

Whitespace never joins a token, so a text is its whitespace-free chunks. The distinct chunks of a
piece of a batch are encoded in sorted order, a slice at a time; each task keeps a bounded table of
chunks it has met. Memory so depends on neither the length of a batch nor on how many of its words differ,
save for a single text above the size of a piece. Null and empty texts have no token. Texts of any length
are encoded whole. Repeated rows are each encoded; an empty table gives no rows. Only the key columns and the text are read; a key must not
be named like a result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read
from .words import pieces, text_bytes

TOKENIZER = "word_bpe_49k.json"
#: Bytes of chunks and their encodings, and pairs of tokens, that a task remembers; beyond them it starts afresh.
REMEMBER, PAIRS = 48 << 20, 300_000
#: Bytes of text that are taken at once, of them those of texts looked at whole, and distinct chunks that are encoded at once.
PIECE, WHOLE_PIECE, SLICE = 1 << 23, 1 << 21, 1 << 14
#: About what Python takes for the three strings of a chunk, and their places in tables, besides the characters.
A_CHUNK = 400
END = "</w>"

_WHOLE = r"<\||\p{M}|\x{130}|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def default_path() -> str:
    """The public vocabulary file; users pass their own path to `tokenize` instead."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


class TrieBpe:
    """A word-level BPE vocabulary with its merge table, encoding sets of words by trie traversal."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        v = self.vocab
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = (v[a], v[b])
            if pair not in self.merged:
                self.merged[pair] = rank
            self.parts.setdefault(v[a + b], (*pair, rank))
        self.inner = {t: i for t, i in v.items() if not t.endswith(END)}
        self.final = {t[: -len(END)]: i for t, i in v.items() if t.endswith(END)}
        #: For the last two characters of a path: the lengths of the tokens that can end there, longest first.
        self.inner_lengths, self.final_lengths = map(self._lengths, (self.inner, self.final))
        self.alphabet = byte_alphabet()
        self._stands: dict[tuple[int, int], bool] = {}
        self._pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._ids: dict[str, str] = {}
        self._text: dict[str, str] = {}
        self._size = 0

    def forget(self) -> None:
        """Let go of the chunks that earlier texts have left."""
        self._ids.clear()
        self._text.clear()
        self._size = 0

    def rest(self) -> None:
        """Let go of all that earlier texts have left."""
        self.forget()
        self._stands.clear()
        pa.default_memory_pool().release_unused()

    @staticmethod
    def _lengths(table: dict[str, int]) -> dict[str, tuple[int, ...]]:
        out: dict[str, set[int]] = {}
        for t in table:
            if len(t) > 1:
                out.setdefault(t[-2:], {1}).add(len(t))
        return {k: tuple(sorted(v, reverse=True)) for k, v in out.items()}

    # --- the pair test

    def stands(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` side by side: no merge across their border comes first.

        The border is looked at backwards in time: whichever token was made by the later merge
        is taken apart, and a merge of the two symbols then at the border must not have come
        before that one."""
        key = (left, right)
        known = self._stands.get(key)
        if known is None:
            known = self._stands[key] = self._test(left, right)
            if len(self._stands) > PAIRS:
                self._stands.clear()
        return known

    def _test(self, left: int, right: int) -> bool:
        rank_of = lambda t: self.parts[t][2] if t in self.parts else -1
        until = len(self.merged)  # merges from this rank on can no longer happen at the border
        strict = True  # a merge of equal rank on the left side happens first
        while True:
            r = self.merged.get((left, right))
            if r is not None and (r < until or (r == until and not strict)):
                return False
            a, b = rank_of(left), rank_of(right)
            if a < 0 and b < 0:
                return True
            if a > b:
                until, strict = a, True
                left = self.parts[left][1]
            else:
                until, strict = b, False
                right = self.parts[right][0]

    # --- traversal

    def words(self, distinct: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, its token ids) of byte-alphabet words, in trie order."""
        inner, final, stands = self.inner, self.final, self._stands
        inner_lengths, final_lengths, single = self.inner_lengths, self.final_lengths, (1,)
        path, last, back = "", [-1], [0]  # state of each node on the path: its last token, and where that begins
        for word in sorted(distinct):
            n = len(word)
            common, most = 0, min(len(path), n - 1)
            while common < most and path[common] == word[common]:
                common += 1
            del last[common + 1 :], back[common + 1 :]
            t = None
            for d in range(common + 1, n + 1):
                table, lengths = (inner, inner_lengths) if d < n else (final, final_lengths)
                for k in lengths.get(word[d - 2 : d], single) if d > 1 else single:
                    at = d - k
                    if at < 0:
                        continue
                    t = table.get(word[at:d])
                    if t is not None:
                        if not at:
                            break
                        pair = (last[at], t)
                        fits = stands.get(pair)
                        if fits if fits is not None else self.stands(*pair):
                            break
                        t = None
                if t is None:
                    break
                if d < n:
                    last.append(t)
                    back.append(at)
            path = word[: len(last) - 1]
            if t is None:
                yield word, self._merge(word)
                continue
            ids = [t]
            while at:
                ids.append(last[at])
                at = back[at]
            yield word, ids[::-1]

    def _merge(self, word: str) -> list[int]:
        """Plain merging, for a vocabulary in which some state has no last token."""
        ids = [self.inner[c] for c in word[:-1]] + [self.final[word[-1]]]
        while len(ids) > 1:
            r, i = min((self.merged.get(p, 1 << 60), i) for i, p in enumerate(zip(ids, ids[1:])))
            if r == 1 << 60:
                break
            ids[i : i + 2] = [next(t for t, p in self.parts.items() if p[2] == r)]
        return ids

    # --- texts

    def split(self, chunk: str) -> list[str]:
        """Byte-alphabet words of a piece of text without special tokens."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        low = chunk.lower()
        if low.isalpha() and low.isascii():
            return [low]
        letters = self.alphabet
        return [w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]) for w in self._pattern.findall(low)]

    def learn(self, chunks: Iterable[str]) -> None:
        """Put the encodings of new chunks in this worker's table."""
        found: dict[str, list] = {}
        need: set[str] = set()
        for c in chunks:
            if "<|" in c and self._special:
                parts: list = []
                for piece in self._special.split(c):
                    parts.extend([self.special[piece]] if piece in self.special else self.split(piece))
                need.update(p for p in parts if isinstance(p, str))
            else:
                parts = self.split(c)
                need.update(parts)
            found[c] = parts
        token = self.token
        done = {w: (" ".join(map(str, i)), " ".join([token[x] for x in i])) for w, i in self.words(need)}
        done.update((i, (str(i), t)) for t, i in self.special.items())
        for c, parts in found.items():
            if len(parts) == 1:
                self._ids[c], self._text[c] = done[parts[0]]
            else:
                self._ids[c] = " ".join([done[p][0] for p in parts])
                self._text[c] = " ".join([done[p][1] for p in parts])
            self._size += A_CHUNK + len(c) + len(self._ids[c]) + len(self._text[c])

    def of_chunks(self, chunks: pa.Array) -> list[pa.Array]:
        """[ids, decoded texts] of distinct chunks. Of those before, a slice at a time leaves only its results."""
        out: list[list[pa.Array]] = [[], []]
        for at in range(0, len(chunks), SLICE):
            if self._size > REMEMBER:
                self.forget()
            some = chunks.slice(at, SLICE).to_pylist()
            known = self._ids
            self.learn([c for c in some if c not in known])
            for col, table in zip(out, (self._ids, self._text)):
                col.append(pa.array(list(map(table.__getitem__, some)), pa.string()))
        return [pa.concat_arrays(col) if col else pa.array([], pa.string()) for col in out]

    def encode_decode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(ids in decimal joined by spaces, decoded texts) of a batch, whose new words share a trie by slices.

        Texts with special tokens, combining marks or rare spaces are looked at whole; others as
        the lower-cased chunks between ASCII spaces, whose encodings this worker remembers."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _WHOLE)
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.ascii_trim_whitespace(pc.if_else(odd, "", texts))))
        offsets, coded = lists.offsets, lists.values.dictionary_encode()
        del lists
        # in sorted order, chunks of one slice share most words and paths
        order = pc.sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int32)
        place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        at = pa.array(place[coded.indices.to_numpy()])
        chunks = coded.dictionary.take(order)
        del coded
        out = [pc.binary_join(pa.ListArray.from_arrays(offsets, parts.take(at)), " ") for parts in self.of_chunks(chunks)]
        if pc.any(odd).as_py():
            whole = texts.filter(odd)
            found: list[list[str]] = [[], []]
            for i, j in pieces(text_bytes(whole)[1], WHOLE_PIECE):
                some = whole.slice(i, j - i).to_pylist()
                self.learn(set(some))
                for col, table in zip(found, (self._ids, self._text)):
                    col.extend([table[t] for t in some])
                for t in set(some):
                    self._size -= A_CHUNK + len(t) + len(self._ids[t]) + len(self._text[t])
                    del self._ids[t], self._text[t]
            out = [pc.replace_with_mask(col, odd, pa.array(f, pa.string())) for col, f in zip(out, found)]
        return out[0], out[1]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> TrieBpe:
    """One table a Python worker."""
    return TrieBpe(path)


def _digests(batches: Iterator[pa.RecordBatch], path: str | None, texts_too: bool) -> Iterator[pa.RecordBatch]:
    bpe = tokenizer(path or default_path())
    sha = lambda col: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in col], pa.string())
    for b in batches:
        _, off = text_bytes(b.column("text"))
        for i, j in pieces(off, PIECE):
            part = b.slice(i, j - i)
            names = [c for c in part.schema.names if c != "text"]
            ids, text = bpe.encode_decode(part.column("text"))
            n = pc.add(pc.count_substring(ids, " "), pc.not_equal(ids, "").cast(pa.int64())).cast(pa.int64())
            more = [ids, text] if texts_too else []
            yield pa.RecordBatch.from_arrays([*map(part.column, names), n, *more, sha(ids), sha(text)], names=[*names, "n_tokens", *(("ids", "decoded") if texts_too else ()), "ids_sha256", "decoded_sha256"])
    bpe.rest()  # the worker may go on to other work


def tokenize(docs: DataFrame, key: list[str], path: str | None = None, texts_too: bool = False) -> DataFrame:
    """``key`` columns with n_tokens, [ids and decoded text,] and their digests.

    ``path`` must name the vocabulary file on every executor; None takes the installed public one."""
    cols = docs.select(*key, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*key).schema)
    more = "ids string, decoded string, " if texts_too else ""
    return cols.mapInArrow(lambda it: _digests(it, path, texts_too), f"{schema}, n_tokens long, {more}ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(read(spark, sf_dir, "documents").select(F.col("doc_id"), "text"), ["doc_id"])
