"""The alignment of two tokenizers against the libraries on whole texts and a plain walk over byte offsets."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm import alignment as A
from llm.bpe import byte_alphabet


def brute(texts):
    a_path, b_path = A.default_paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    byte = {c: k for k, c in enumerate(byte_alphabet())}
    rows = []
    for text in texts:
        groups = []
        if text:
            whole = f" {text}".encode()
            x = a.encode(f" {text}", add_special_tokens=False)
            xs = [(i, bytes(byte[c] for c in t)) for i, t in zip(x.ids, x.tokens)]
            ys = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
            if b"".join(t for _, t in xs) == whole == b"".join(t for _, t in ys):
                ends = [set(np.cumsum([len(t) for _, t in s]).tolist()) for s in (xs, ys)]
                cuts = sorted(ends[0] & ends[1])
                k = m = at_a = at_b = 0
                for cut in cuts:
                    left, right = [], []
                    while at_a < cut:
                        left.append(xs[k][0])
                        at_a, k = at_a + len(xs[k][1]), k + 1
                    while at_b < cut:
                        right.append(ys[m][0])
                        at_b, m = at_b + len(ys[m][1]), m + 1
                    groups.append((left, right))
        rows.append(groups)
    links = [Counter((p, q) for left, right in groups for p in left for q in right) for groups in rows]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for groups, own in zip(rows, links):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(own.values()), sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


ODD = [
    None, "", " ", "  ", "a", " x", "\n", "\n\nfoo  bar \n baz\t\tq \r\n;\r\nx", "It's we'll I'd 'S don't", "<|endoftext|> <s> </s> <unk> [PAD]", "▁a b", "a b　c   d", "é Å ﬁ \x00 \x01 \x1c z", "naïve Straße Ελλάδα 日本語 テスト 🤷🏽‍♂️ 👩‍👩‍👧",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "==========-----____    ", "1234567890 3.14159e-10", "tab\tseparated\tvalues\x0b\x0c.", "trailing space ", "x" * 40 + " " * 40 + "y", "éä", "﻿bom", "ok line",
]


def check(spark, texts, **more):
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, links string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in A.align(docs, **more).collect()}
    want = brute(texts)
    assert set(got) == set(ids)
    for i in ids:
        assert got[i] == want[i], (i, texts[i] if texts[i] is None else texts[i][:80])


@pytest.mark.parametrize("frequent", [A.FREQUENT, 3, 0])
def test_rows_equal_brute_force(spark, frequent):
    rng = np.random.default_rng(2)
    alphabet = list("aé \n\t'.,;0Z日\r") + ["the", " of", "ing", "  "]
    texts = ODD + ["".join(rng.choice(alphabet, int(rng.integers(1, 200)))) for _ in range(60)]
    check(spark, texts, frequent=frequent)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in A.op11_alignment(spark, sf).collect()}
    want = brute([r["text"] for r in rows])
    assert got == {r["doc_id"]: w for r, w in zip(rows, want)}


def test_long_text_and_forgetful_worker(spark, monkeypatch):
    rng = np.random.default_rng(6)
    check(spark, [" ".join(rng.choice(["alpha", "beta,", "Γάμμα", "don't", "x1y2", "\n"], 120_000)), "short", None])
    pair = A.Pair(*A.default_paths())
    monkeypatch.setattr(A, "CHUNKS", 2)
    texts = ["one two three", "four five one", "six one two"]
    for t in texts:
        raw = np.frombuffer(f" {t}".encode(), np.uint8)
        _, chunk, fine = pair.piece(raw, np.array([0, len(raw)]))
        assert fine.all() and ";".join(pair.text[c] for c in chunk) == pair.whole(t)[1]


def test_groups_are_the_shared_cuts():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = (sorted({*rng.integers(1, n + 1, int(rng.integers(1, n + 1))).tolist(), n}) for _ in range(2))
        cuts = sorted(set(a) & set(b))
        assert [(a[j - 1], b[m - 1]) for _, j, _, m in A.shared_groups(a, b)] == [(c, c) for c in cuts]
    assert A.shared_groups([], []) == []


def test_an_empty_table_gives_no_rows(spark):
    assert A.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
