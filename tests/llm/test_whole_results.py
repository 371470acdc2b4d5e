"""Inputs on which the training-data operators once returned less than the whole result."""

import numpy as np
import pyarrow as pa
import pytest

from llm import language_id, licenses, near_duplicates, quality_rules, registry, token_counts


@pytest.mark.parametrize("parts", [1, 3])
def test_near_duplicates_of_texts_without_a_word(spark, parts):
    blank = [None, "", "  \n\t", "", None, " "]
    rows = [(k, t) for k, t in enumerate(blank)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(d).collect())
    assert got == [(k, 0, k) for k in range(len(blank))]
    # partitions of blank texts alone beside partitions of words
    d = d.unionByName(spark.createDataFrame([(7, "a b c d e f"), (8, "a b c d e f")], "doc_id long, text string"))
    got = sorted((r["doc_id"], r["component_id"]) for r in near_duplicates.near_duplicates(d).collect())
    assert got == [(k, k) for k in range(len(blank))] + [(7, 7), (8, 7)]


def test_a_second_ledger_goes_on_where_the_first_stopped(spark, tmp_path):
    d = spark.createDataFrame([("s", "en", "a b c"), ("s", "en", "d e")], "source string, lang string, text string")
    more = token_counts.signed(d.limit(1), 1)
    new = lambda: token_counts.Ledger(spark, f"{tmp_path}/ledger")
    read = lambda: {(r["version"], r["n_docs"], r["n_tokens"]) for r in new().totals().collect()}
    assert read() == set()
    new().commit("one", token_counts.signed(d, 1))
    assert read() == {("words-1", 2, 5), ("marks-2", 2, 5)}
    new().commit("two", more)
    new().commit("two", more)
    want = {("words-1", 3, 8), ("marks-2", 3, 8)}
    assert read() == want
    new().compact("base")
    new().commit("two", more)  # folded: a late retry counts nothing
    new().commit("base", more)
    assert read() == want
    new().commit("three", more)
    new().compact("base")
    new().commit("three", more)
    assert read() == {("words-1", 4, 11), ("marks-2", 4, 11)}


def test_language_scores_do_not_depend_on_the_next_text(spark):
    rng = np.random.default_rng(3)
    rows = [(t, lang) for lang, letters in (("a", "abcde "), ("b", "defgh "), ("c", "ghijk ")) for t in ("".join(rng.choice(list(letters), 30)) for _ in range(20))]
    d = spark.createDataFrame(rows, "text string, lang string")
    langs, blocks = language_id.train(d)
    score = lambda x: [tuple(r.values()) for b in language_id._score(iter([pa.record_batch([pa.array(x)], names=["text"])]), langs, blocks) for r in b.to_pylist()]
    texts = ["g", "de", "", "hd", "Re.", None, "eh", "abc", "k"]
    assert score(texts) == [x for t in texts for x in score(pa.array([t], pa.string()))]
    # training counts are the same however rows are cut into tasks
    for other in (language_id.train(d.repartition(5)), language_id.train(d.repartition(1, "lang"))):
        assert other[0] == langs and np.array_equal(np.hstack(other[1]), np.hstack(blocks))


def test_language_id_keeps_every_language(spark):
    rows = [(f"{chr(0x4E00 + k)}" * 9, f"l{k:03}") for k in range(300)]
    d = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.train(d.coalesce(2))
    assert len(model[0]) == 300
    got = [r["lang_pred"] == r["lang"] for r in language_id.identify(d, model, ["lang"]).collect()]
    assert len(got) == 300 and all(got)


def test_wrapped_headers_and_licence_files(spark):
    text = licenses._TEXTS
    comment = lambda x, mark: "\n".join(f"{mark} {y}".rstrip() for y in x.splitlines())
    code = "\nimport numbers\ndef area(width, height):\n    return width * height\n"
    gpl = text["GPL-3.0"].split("author>\n\n", 1)[1].split("\n\nAlso add")[0]
    bsd = text["BSD-3-Clause"].split("\n\n")[1]
    texts = [
        ("MIT", text["MIT"].replace("<year> <copyright holders>", "2020 Some One")), ("MIT", comment(text["MIT"], "#") + code), ("BSD-3-Clause", text["BSD-3-Clause"]),
        ("BSD-3-Clause", "/*\n" + comment(bsd, " *") + "\n */" + code), ("GPL-3.0", comment(gpl, "//") + code), ("GPL-3.0", text["GPL-3.0"]), ("GPL-2.0", text["GPL-2.0"]),
        ("GPL-3.0", "# SPDX-License-Identifier: GPL-3.0-or-later" + code), ("MIT", "// SPDX-License-Identifier: MIT" + code), ("Apache-2.0", text["Apache-2.0"]), (None, code), (None, None), (None, "\n\n"),
    ]
    rows = [(k, f"d{k}/f", t) for k, (_, t) in enumerate(texts)] + [(100, "d0/sub/x", "plain words"), (101, "d5/x", "")]
    got = {r["doc_id"]: (r["license"], r["license_dir"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {**{k: (n, None) for k, (n, _) in enumerate(texts)}, 100: ("MIT", "d0"), 101: ("GPL-3.0", "d5")}


def test_quality_references_leave_the_text_itself_out(spark):
    say = lambda k: " ".join(["the house and the tree of a man in it"] + [f"word{k}x{j}" for j in range(60)])
    odd = " ".join(f"QZ{j}9183746WX" for j in range(300))
    rows = [(k, say(k), "en") for k in range(60)] + [(100, odd, "en"), (101, odd, "xx"), (102, say(102), None)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k]["kept"] for k in range(60))
    assert got[100]["js_chars"] > quality_rules.MAX_CHAR_DISTANCE and not got[100]["kept"]
    for lone in (101, 102):  # nothing to compare with: the base rules alone
        assert got[lone]["js_chars"] is None and got[lone]["js_words"] is None and got[lone]["kept"]


def script_texts(letters, pairs, n, seed):
    """Texts of about 80 characters in two languages that share their letters and differ in which follow which."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        words, total = [], 0
        while total < 80:
            w = [int(rng.integers(0, len(letters)))]
            while len(w) < 6:
                w.append((w[-1] * pairs + int(rng.integers(0, 3))) % len(letters))
            words.append("".join(letters[k] for k in w))
            total += 7
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("first", [0x61, 0x430, 0x915])
def test_languages_of_any_script_are_told_apart_by_their_pairs(spark, first):
    letters = [chr(first + k) for k in range(26)]
    rows = [(lang, t) for lang, p in (("one", 3), ("two", 5)) for t in script_texts(letters, p, 400, p)]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string")
    model = language_id.train(d.where("doc_id % 2 = 0"))
    got = language_id.identify(d.where("doc_id % 2 = 1"), model, ["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_naive_bayes_equals_one_by_dictionaries(spark):
    texts = [("en", "The cat sat on 12 mats."), ("en", "A dog, a log"), ("fr", "L'été où ça va"), ("fr", "Très bien été"), ("hi", "यह एक वाक्य है")]

    def bucket(gram):
        m = 2**32 - 1
        code = lambda c: int.from_bytes((" " if c in "\t\n\x0b\x0c\r" else "0" if c in "0123456789" else c.lower() if c.isascii() else c).encode(), "big")
        x = ((code(gram[0]) + (len(gram) << 24)) * 0x9E3779B1) & m
        for c in gram[1:]:
            x = ((x ^ x >> 15) * 0x85EBCA6B + code(c) * 0x9E3779B1) & m
        x ^= x >> 15
        return ((x * 0x2C1B3C6D) & m) >> 16

    grams = lambda t: [bucket((t + "  ")[i : i + k]) for k in (1, 2, 3) for i in range(len(t))]
    langs = ["en", "fr", "hi"]
    counts = {g: np.bincount([b for lang, t in texts if lang == g for b in grams(t)], minlength=1 << 16) + 0.5 for g in langs}
    logp = {g: np.log(c / c.sum()) for g, c in counts.items()}
    model = language_id.train(spark.createDataFrame(texts, "lang string, text string"))
    for t in ("the mat", "été là", "एक", "Zé 9\n"):
        per = np.array([logp[g][grams(t)].sum() for g in langs]) / len(t)
        p = np.exp(per - per.max())
        p /= p.sum()
        r = language_id.identify(spark.createDataFrame([(1, t)], "doc_id long, text string"), model, ["doc_id"]).first()
        assert r["lang_pred"] == langs[int(p.argmax())] and r["score"] == pytest.approx(p.max(), abs=1e-5)


def test_rows_without_an_id_are_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "One text. " * 9, "en"), (1, "Two texts. " * 9, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op5_quality_gam", "op6_toxicity", "op7_language_id"):
        got = {r["doc_id"]: r["held_out"] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got[None] is False and isinstance(got[1], bool)
