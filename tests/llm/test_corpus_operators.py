"""The training-data operators against brute force, and on nulls, empties, repeats, ties and clashing columns."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import bpe, decontaminate, language_id, licenses, line_dedup, near_duplicates, quality_gam, quality_rules, token_counts, toxicity, words
from llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long, p long, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, "s", len(t or ""), 7, 7, 7) for k, t in enumerate(texts)], SCHEMA)


BASE = [f"w{k}" for k in range(40)]
EDGES = [" ".join(BASE), None, "", "   \n\t", "one two", "One TWO", " ".join(BASE), " ".join([*BASE[:39], "changed"]), "é ñ 日本 x", "a " * 5000 + "end"]


def shingle_set(text):
    w = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_word_hashes_follow_words():
    col = pa.array(["ab  AB\tc", None, "", "c ab"])
    raw, off = words.text_bytes(col)
    s, e, row = words.word_spans(raw, off)
    assert [bytes(raw[a:b]) for a, b in zip(s, e)] == [b"ab", b"AB", b"c", b"c", b"ab"] and row.tolist() == [0, 0, 0, 3, 3]
    h = words.hash_spans(raw, s, e, True)
    assert h[0] == h[1] == h[4] and h[2] == h[3] != h[0]


def test_near_duplicates_brute(spark):
    rng = np.random.default_rng(0)
    texts = list(EDGES)
    for _ in range(6):  # groups of variants, some linked only through others
        base = [f"t{rng.integers(10**6)}" for _ in range(60)]
        for _ in range(12):
            v = list(base)
            for k in rng.integers(0, 60, 2):
                v[k] = f"u{rng.integers(10**6)}"
            texts.append(" ".join(v))
    sets = [shingle_set(t) for t in texts]
    part = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = [new if x == old else x for x in part]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(docs(spark, texts)).collect()}
    assert got == {k: (len(s), part[k]) for k, s in enumerate(sets)}


def test_near_duplicates_empty_and_null_id(spark):
    d = docs(spark, [])
    assert near_duplicates.near_duplicates(d).count() == 0
    d = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(d).collect()), key=str)
    assert got == [(3, 1, 3), (3, 1, 3), (None, 1, None)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}


def brute_lines(rows):
    seen, out = [], {}
    for d, t in rows:
        keep = []
        for line in t.split("\n"):
            s = frozenset(WORD.findall(line.translate({k: k + 32 for k in range(65, 91)})))
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                seen.append(s)
                continue
            if s:
                seen.append(s)
            keep.append(line)
        out[d] = "\n".join(keep)
    return out


def test_line_dedup_brute(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"v{k}" for k in range(60)]
    texts = []
    for _ in range(60):
        lines = [" ".join(rng.choice(vocabulary[: rng.integers(4, 60)], rng.integers(1, 12))) for _ in range(4)]
        texts.append("\n".join([*lines, "", "Same line Here"]))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_takes_whole_sets_in_one_pass_over_texts(spark, monkeypatch):
    passes, pairs = [], []
    with_asked, verified = line_dedup._with_asked, line_dedup._verified
    monkeypatch.setattr(line_dedup, "_with_asked", lambda *a: passes.append(1) or with_asked(*a))
    # as if none of the likeliest held, so that the others are verified too
    monkeypatch.setattr(line_dedup, "_verified", lambda *a: pairs.append(1) or (verified(*a).where("false") if len(pairs) == 1 else verified(*a)))
    line_dedup.removed_lines(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert len(pairs) == 2 and len(passes) == 1


def test_line_dedup_finds_candidates_of_several_keys_and_copies_in_one_bucket():
    words_of = [["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "f"], ["x", "y"], ["x", "y", "z", "u", "v"], ["q"]]
    parts = [pa.RecordBatch.from_pydict({"doc_id": [k], "h": pa.array([k], pa.int32()), "text": ["\n".join([" ".join(w), "only" + str(k)])]}) for k, w in enumerate(words_of)]
    packed = pa.concat_tables([pa.Table.from_batches(list(line_dedup._entries(iter([b]), np.zeros(line_dedup.RANGES, np.uint64), 1))) for b in parts])
    got = line_dedup._match(packed)
    gone = line_dedup.unpack(line_dedup.GONE, got.column("gone").drop_null())
    assert set(zip(gone["doc"].tolist(), gone["pos"].tolist())) <= {(1, 0)} and {(r["ydoc"], r["xdoc"]) for r in got.to_pylist() if r["gone"] is None} <= {(2, 0)}


def test_line_dedup_exchanges_asked_texts_only(spark):
    texts = spark.range(-500, 1500).select(F.col("id").alias("doc_id"), F.hash("id").alias("h"), F.lit("a\nb").alias("text"))
    places = texts.where("doc_id in (-500, -3, 0, 1, 1499)").select(F.col("doc_id").alias("doc"), "h", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"))
    got = line_dedup._with_asked(texts, places).collect()
    assert sorted((r["doc_id"], sorted(r["asked"]), r["text"]) for r in got) == [(k, [0, 1], "a\nb") for k in (-500, -3, 0, 1, 1499)]
    some = {r["doc_id"] for r in line_dedup._maybe_asked(texts, places).collect()}
    assert some >= {-500, -3, 0, 1, 1499} and len(some) < 20
    assert not line_dedup._maybe_asked(texts, places.where("false")).collect()


def test_line_dedup_edges(spark):
    d = spark.createDataFrame([(None, "x y\nx y", 1), (1, None, 1), (2, "", 1), (3, "a b\na b", 1), (3, "a b\na b", 1)], "doc_id long, text string, cut long")
    got = sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(d.drop("cut")).collect() if r["doc_id"] != 1)
    assert got == [("2", "", 0), ("3", "a b", 1), ("3", "a b", 1), ("None", "x y\nx y", 0)]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_decontamination_finds_leaks_only(spark):
    item = "Which river runs through the old town of Barrow near the stone bridge today? The river is called the little Wenning and it is short."
    other = " ".join(f"filler{k}" for k in range(300))
    texts = [f"{other} {item} {other}", item.upper(), other, None, "", " ".join(item.split()[:6]) + " " + other]
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, texts), items).collect()}
    assert got == {(0, 1), (1, 1)}
    assert decontaminate.without_contaminated(docs(spark, texts), items).count() == 4
    assert decontaminate.contaminated(docs(spark, texts), items.limit(0)).count() == 0


def test_quality_rules_edges(spark):
    clean = " ".join(["the house and the tree of a man in it"] + [f"word{k}" for k in range(60)])
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, [clean] * 30 + [None, "", "### $$$ *** " * 40, "a b c d e f g h i j " * 10])).collect()}
    assert got[0]["kept"] and got[0]["n_words"] == 70 and got[30]["base_failed"] and got[31]["base_failed"] and not got[32]["kept"]
    assert got[33]["n_repeat_words"] == 100 and got[33]["base_failed"]
    assert quality_rules.judge(docs(spark, [])).count() == 0


def test_language_id_held_out(spark):
    en, de = "the quick brown fox and the lazy dog with this ", "der schnelle braune fuchs und die faule katze nicht "
    d = docs(spark, [en * 3] * 4).unionByName(docs(spark, [de * 3] * 4, "de"))
    model = language_id.train(d)
    rows = docs(spark, ["the dog and the fox", "die katze und der fuchs", None, "12 34", ""])
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(rows, model, ["doc_id"]).collect()}
    assert got == {0: "en", 1: "de", 2: "und", 3: "und", 4: "und"}
    none = language_id.train(d.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(rows, none, ["doc_id"]).collect()} == {"und"}


def test_classifiers_learn_and_survive_empties(spark):
    good, bad = [" ".join(BASE) + f" text {k}." for k in range(80)], [f"BUY!!! ### $$$ {k} " * 10 for k in range(80)]
    rows = spark.createDataFrame([(1, t) for t in good] + [(0, t) for t in bad], "label int, text string")
    model = quality_gam.train(rows)
    s = model.score(quality_gam.text_features(pa.array([good[0] + " more", bad[0] + "###", "", None])))
    assert s[0] > 0.5 > s[1] and np.isfinite(s).all()
    assert np.allclose(quality_gam.train(rows.limit(0)).score(quality_gam.text_features(pa.array(["x", None]))), 0.5)
    toxic = [f"{BASE[k % 40]} you idiot {BASE[(k + 3) % 40]}" for k in range(60)]
    rows = spark.createDataFrame([(0, t) for t in good] + [(1, t) for t in toxic], "label int, text string")
    m = toxicity.train(rows)
    s = m.score(pa.array(["w1 w2 idiot w3", "w1 w2 id-iot w3", " ".join(BASE), "", None]))
    assert s[0] > 0.3 > s[2] and s[1] > s[2] and np.isfinite(s).all()
    assert np.isfinite(toxicity.train(rows.where("label = 0")).score(pa.array(["x"]))).all()


def test_license_inheritance(spark):
    rows = [(1, "p/a/LICENSE", "Released under the MIT License."), (2, "p/a/b/c/x", "plain words"), (3, "p/x", "plain"), (4, "p/a/y", "code\nLicensed under the Apache License, Version 2.0.\nmore"), (5, None, None), (6, "p/a/b/z", "")]
    got = {r["doc_id"]: (r["license"], r["license_dir"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", None), 2: ("MIT", "p/a"), 3: (None, None), 4: ("Apache-2.0", None), 5: (None, None), 6: ("MIT", "p/a")}


def test_ledger_is_idempotent(spark):
    d = docs(spark, ["a b c", None, "d e"])
    ledger = token_counts.Ledger(spark)
    ledger.commit("one", token_counts.signed(d, 1))
    ledger.commit("two", token_counts.signed(d.where("doc_id = 2"), -1))
    ledger.commit("two", token_counts.signed(d.where("doc_id = 2"), -1))
    want = {("words-1", 2, 3), ("marks-2", 2, 3)}
    read = lambda: {(r["version"], r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}
    assert read() == want
    ledger.compact("base")
    assert read() == want


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    rng = np.random.default_rng(2)
    texts = [x for x in EDGES if x is not None] + ["it's we'll Don't", "x<|endoftext|>y", "ΣΑΣ İ ß", "é   　z"] + ["".join(rng.choice(list("abcdeéü'., 12\n"), 40)) for _ in range(300)]
    got = {r["doc_id"]: r for r in bpe.tokenize(docs(spark, [*texts, None]), ["doc_id"], texts_too=True).collect()}
    for k, text in enumerate([*texts, ""]):
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[k]["ids"] == " ".join(map(str, ids)) and got[k]["n_tokens"] == len(ids)
        assert got[k]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_remembers_a_bounded_table_within_a_batch(monkeypatch):
    """One batch of many different words: a worker's table has no more of them than its bound and a slice."""
    tokenizers = pytest.importorskip("tokenizers")
    t, b = tokenizers.Tokenizer.from_file(bpe.default_path()), bpe.TrieBpe(bpe.default_path())
    monkeypatch.setattr(bpe, "REMEMBER", 1 << 20)
    most, learn = [0], b.learn

    def watched(chunks):
        learn(chunks)
        most[0] = max(most[0], len(b._ids))

    monkeypatch.setattr(b, "learn", watched)
    texts = [" ".join(f"w{k * 7919 % 60_000:x}q{k % 7}" for k in range(i, i + 600)) for i in range(0, 60_000, 500)]
    texts += ["", None, "cafe\u0301 \u2003 in \u00e9t\u00e9 " * 3, "cafe\u0301 \u2003 in \u00e9t\u00e9 " * 3, "<|endoftext|> as text", "  "]
    ids, decoded = b.encode_decode(pa.array(texts, pa.string()))
    for text, i, d in zip(texts, ids.to_pylist(), decoded.to_pylist(), strict=True):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert i == " ".join(map(str, want)) and d == t.decode(want, skip_special_tokens=False)
    assert most[0] < 20_000
