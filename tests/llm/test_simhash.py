"""SimHash near-duplicates against a brute force over all pairs."""

import re

import numpy as np
import xxhash

from llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> i & 1 for x in h) > len(h)) << i for i in range(64))


def components(ids, prints):
    top = list(range(len(ids)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                top[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(ids))]


def test_rows_equal_a_comparison_of_all_pairs(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "Straße", "x" * 90]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    texts = [None, "", " \t\n", "one", "ONE", "one two", "One\tTwo", "a b c", say(3) + "\x0b" + say(400)]
    for _ in range(12):
        base = say(60).split()
        for _ in range(6):  # near copies: a word or two changed
            t = list(base)
            for j in rng.integers(0, len(t), int(rng.integers(0, 3))):
                t[j] = str(rng.choice(vocabulary))
            texts.append("  ".join(t))
    texts.append(" ".join(rng.choice(vocabulary, 250_000)))  # longer than one piece
    ids = [None if k in (4, 20) else int(1000 - k) for k in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id int, text string, fingerprint string").repartition(3)
    got = sorted(((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [fingerprint(t) for t in texts]
    assert got == sorted(zip(ids, prints, components(ids, prints)), key=str)


def _links(spark, values):
    fp = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    return [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(fp).collect()]


def test_links_join_what_brute_force_joins_also_in_large_cells(spark):
    rng = np.random.default_rng(3)
    wild = rng.integers(0, 2**63, 150, dtype=np.uint64)
    close = [int(w) ^ (1 << int(i)) ^ (1 << int(j)) for w in wild[:40] for i, j in rng.integers(0, 64, (4, 2))]
    family = [0xABCD_0123_0000_0000 | int(x) for x in rng.integers(0, 2**32, 300)]  # one cell, far apart
    tight = [0x1234_5678_0000_0000 | (1 << int(i)) | (1 << int(j)) for i, j in rng.integers(0, 30, (200, 2))]
    values = sorted({int(w) for w in wild} | set(close) | set(family) | set(tight))
    found = _links(spark, values)
    assert all(bin(a ^ b).count("1") <= 2 for a, b in found)
    top = {v: v for v in values}

    def root(v):
        while top[v] != v:
            v = top[v]
        return v

    for a, b in found:
        top[root(a)] = root(b)
    mine = {v: root(v) for v in values}
    want = components(list(range(len(values))), values)
    groups = {}
    for v, c in zip(values, want):
        groups.setdefault(c, set()).add(mine[v])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_distances_are_hamming_distances(spark):
    values = [0, 2**64 - 1, 0x0123456789ABCDEF, 1 << 63]
    fp = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    for r in simhash.with_distances(fp).collect():
        v = r["fp"] % 2**64
        assert r["zero"] == bin(v).count("1")
        for g, group in enumerate(simhash.references()):
            for t, p in enumerate(group):
                assert r["zero"] + 8 - 2 * (r["near"][g] >> 4 * t & 15) == bin(v ^ p).count("1")


def test_an_empty_table_gives_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_query_digests(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d"), (2, "A b  c d"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op13_simhash(spark, str(tmp_path)).collect()}
    assert got == {1: (f"{fingerprint('a b c d'):016x}", 1), 2: (f"{fingerprint('a b c d'):016x}", 1), 3: ("0" * 16, 3)}
