"""Operators that SQL cannot express against plain re-implementations, held-out rows, and odd inputs."""

import math
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm import decontaminate as D
from llm import language_id, line_dedup, near_duplicates, quality_gam, registry, toxicity, words

SF = "/root/testdata/sf0.01"


def item_words(text):
    return [w for w in (x.strip(string.punctuation) for x in text.lower().split()) if w]


def grams(w, k=4):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_contaminated(texts, items):
    """Every passage scored against every item by plain BM25, then the overlaps."""
    bags = {i: Counter(item_words(t)) for i, t in items}
    length = {i: sum(b.values()) for i, b in bags.items()}
    df = Counter(w for b in bags.values() for w in b)
    mean, n = sum(length.values()) / len(bags), len(bags)
    weight = {}
    for i, b in bags.items():
        w = {t: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * (D.K1 + 1) / (c + D.K1 * (1 - D.B + D.B * length[i] / mean)) for t, c in b.items()}
        own = sum(sorted(w.values(), reverse=True)[: D.ATTAINABLE_TERMS])
        weight[i] = {t: v / own for t, v in w.items()}
    parts = {i: tuple(grams(item_words(p)) for p in D._split(t)) for i, t in items}
    found = {}
    for d, text in enumerate(texts):
        w = item_words(text)
        starts = range(0, max(1, len(w) - D.PASSAGE + D.STRIDE), D.STRIDE)
        for s in starts:
            e = min(s + D.PASSAGE, len(w))
            bag = set(w[s:e])
            for i, of in weight.items():
                score = sum(v for t, v in of.items() if t in bag)
                if score >= D.THRESHOLD:
                    seen = grams(w[max(0, s - length[i] - D.GRAM) : e + length[i] + D.GRAM])
                    q, a = (sum(g in seen for g in p) / len(p) if p else 1.0 for p in parts[i])
                    if q >= D.MIN_QUESTION and a >= D.MIN_ANSWER:
                        found[d, i] = max(found.get((d, i), 0), round(q, 6))
    return found


def test_decontamination_equals_plain_bm25(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{k}" for k in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, f"{say(int(rng.integers(10, 60)))}? {say(int(rng.integers(9, 30)))}.") for k in range(60)]
    items.append((60, say(150) + ". " + say(20)))  # longer than a passage
    texts = []
    for k in range(150):
        t = items[int(rng.integers(0, 61))][1].split()
        for j in rng.integers(0, len(t), int(rng.integers(0, 1 + len(t) // 3))):  # from whole to badly damaged
            t[j] = str(rng.choice(vocabulary))
        texts.append(f"{say(int(rng.integers(0, 200)))} {' '.join(t)} {say(int(rng.integers(0, 200)))}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]): round(r["question_overlap"], 6) for r in D.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_contaminated(texts, items)
    assert len(want) > 40 and set(got) == set(want)


def test_short_items_are_matched_exactly(spark):
    items = spark.createDataFrame([(1, "What is five plus six?"), (2, "Eleven"), (3, "what is five plus six"), (4, "")], "item_id long, text string")
    texts = ["He asked: what is FIVE plus six, and left", "eleven", "eleven men", "what is five plus", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, items).collect()}
    assert got == {(0, 1), (0, 3), (1, 2)}
    assert sorted(r["doc_id"] for r in D.without_contaminated(docs, items).collect()) == [2, 3, 4, 5]


@pytest.mark.parametrize("key, label, least", [("op5_quality_gam", "quality", 0.85), ("op6_toxicity", "toxic", 0.9)])
def test_held_out_labels(spark, key, label, least):
    got = registry.QUERIES[key](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    m = 3 if label == "quality" else 4
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").isEmpty()
    assert got.where((F.crc32(F.col("doc_id").cast("string")) % m == (1 if m == 3 else 2)) != F.col("held_out")).isEmpty()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y")).where("y is not null")
    r = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("y")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n")).first()
    assert r["n"] > 20 and r["right"] >= least


def test_held_out_languages(spark):
    got = registry.QUERIES["op7_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    r = got.where("held_out").join(docs, "doc_id").where("lang is not null and length(text) > 60").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n")).first()
    assert r["n"] > 100 and r["right"] >= 0.95


def test_columns_with_clashing_names(spark):
    names = ("cut", "_h", "_doc", "_k", "doc", "h", "row", "p", "s", "label", "_id", "n_lines", "asked")
    d = spark.createDataFrame([(1, "a b c\nx"), (2, "A b c\ny z"), (2, "A b c\ny z"), (None, "a b c"), (3, None)], "doc_id long, text string")
    d = d.select("*", *[F.lit(7).alias(c) for c in names])
    got = line_dedup.dedup_lines(d)
    assert set(names) <= set(got.columns)
    assert sorted(((r["doc_id"], r["text"], r["cut"], r["n_lines"], r["n_removed"]) for r in got.collect()), key=str) == sorted([(1, "a b c\nx", 7, 2, 0), (2, "y z", 7, 2, 1), (2, "y z", 7, 2, 1), (None, "a b c", 7, 1, 0), (3, None, 7, 0, 0)], key=str)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_gam.training_rows(d, labels, "quality", 10).count() == 5
    for model, module in ((quality_gam.train, quality_gam), (toxicity.train, toxicity)):
        rows = quality_gam.training_rows(d, labels, "quality", 10)
        assert module.score(d, model(rows), ["doc_id", "label"]).count() == 5
    assert language_id.identify(d, language_id.train(d.withColumn("lang", F.lit("en"))), ["doc_id", "label"]).count() == 5


def test_near_duplicates_of_ids_with_several_texts(spark):
    base, other = [f"w{k}" for k in range(30)], [f"v{k}" for k in range(3000)]
    near = [*base[:29], "changed"]
    rows = [(5, " ".join(base)), (5, " ".join(other)), (2, " ".join(near)), (9, " ".join(other[:2900])), (5, ""), (11, "alone in the world it is"), (11, "alone in the world it is")]
    want = sorted([(2, 2), (5, 2), (5, 2), (5, 2), (9, 2), (11, 11), (11, 11)])
    for some in (rows, rows[::-1]):
        d = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
        assert sorted((r["doc_id"], r["component_id"]) for r in near_duplicates.near_duplicates(d).collect()) == want


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    text = "the quick brown fox and the lazy dog are here today with nothing else to say at all"
    rows = [(None, text, "en", None, 5, "x"), (None, text, "en", None, 5, "x"), (1, None, None, None, None, None), (2, "", "en", "s", 0, ""), (3, text, "en", "s", 9, "y"), (3, text, "en", "s", 9, "y"), (4, text + " too", None, "s", 9, "y")]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some, ids in ((rows, [None, None, 3]), ([], [])):
        docs = spark.createDataFrame(some, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == list(corpus_pipeline.COLUMNS)
            docs = corpus_pipeline.stash(docs)
        assert sorted((r["doc_id"] for r in docs.collect()), key=str) == sorted(ids, key=str)


def test_items_in_several_blocks_are_found_alike(spark, monkeypatch):
    rows = [(i, " ".join(f"{c}{i % 5}x{k}" for k in range(20) for c in "ab")) for i in range(12)] + [(3, "zero one two"), (3, "zero one two"), (None, "x"), (4, None), (20, "p q r s t")]
    items = spark.createDataFrame(rows, "item_id int, text string")
    texts = [t for _, t in rows if t] + ["before " + rows[2][1] + " after", "nothing of it", "here p q r s t there", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def found():
        return sorted((r["doc_id"], r["item_id"], round(r["score"], 4)) for r in D.contaminated(docs, items).collect())

    whole = found()
    assert {(0, 0), (0, 5), (0, 10), (12, 3), (16, 2), (15, 20), (18, 20)} <= {(d, i) for d, i, _ in whole} and not {14, 17, 19} & {d for d, _, _ in whole}
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 4)
    assert found() == whole


def test_letters_that_stand_alone_are_one_word():
    raw, off = words.text_bytes(pa.array(["an i d i o t, no", "a", "", "b", "x 1 y z"]))
    joined, at = toxicity._joined(raw, off)
    assert [bytes(joined[a:b]).decode() for a, b in zip(at[:-1], at[1:], strict=True)] == ["an idio t, no", "a", "", "b", "x 1 yz"]
