"""Every query of the subpackage on empty tables and on a table of odd rows, one of them over a megabyte long."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from llm import bpe, decontaminate, registry

CLASHING = ("score", "kept", "n_words", "component_id", "fingerprint", "held_out", "n_tokens", "path", "label", "item_id", "h", "n", "t", "w", "predicted", "lang_pred")
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING),
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}
ITEM = "which of these rivers runs north through the old quarter of the town? the smaller one with the three stone bridges does"
PLAIN = "the quick brown fox and the lazy dog are here today with nothing else to say at all"
#: Over 1 MB; the item stands near its end.
LONG = " ".join(f"word{k} and{k % 97}" for k in range(75_000)) + f" {ITEM} the end"
ROWS = [(None, PLAIN), (1, None), (2, ""), (3, PLAIN), (3, PLAIN), (4, LONG)]
BY_ROW = ("op1_line_dedup", "op2_quality_rules", "op4_near_duplicates", "op5_quality_gam", "op6_toxicity", "op7_language_id", "op10_bpe", "op11_alignment", "op13_simhash")


def write(spark, path, tables):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(tables.get(name, []), schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    docs = [(i, t, "en" if t else None, "s", len(t or ""), *[7] * len(CLASHING)) for i, t in ROWS]
    return write(spark, tmp_path_factory.mktemp("odd"), {"documents": docs, "benchmark": [(1, ITEM), (2, ITEM), (3, None), (4, "")], "labels": [(3, 1, 0), (4, 0, 1), (None, 1, 1), (1, None, 0)]})


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, key):
    assert registry.QUERIES[key](spark, empty).collect() == []


@pytest.mark.parametrize("key", sorted({*BY_ROW}))
def test_odd_rows_each_have_a_result(spark, odd, key):
    got = registry.QUERIES[key](spark, odd)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted((i for i, _ in ROWS), key=str)
    of = {r["doc_id"]: r for r in rows}
    empty_sha = hashlib.sha256(b"").hexdigest()
    if key == "op1_line_dedup":
        assert [(of[i]["n_lines"], of[i]["n_removed"], of[i]["kept_sha256"]) for i in (1, 2)] == [(0, 0, empty_sha), (1, 0, empty_sha)]
        assert of[4]["kept_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    elif key == "op2_quality_rules":
        assert (of[4]["n_words"], of[1]["n_words"], of[1]["base_failed"], of[2]["kept"]) == (len(LONG.split()), 0, True, False)
    elif key == "op4_near_duplicates":
        words = LONG.split()
        assert [(of[i]["n_shingles"], of[i]["component_id"]) for i in (1, 2, 3)] == [(0, 1), (0, 2), (len(PLAIN.split()) - 4, 3)]
        assert (of[4]["n_shingles"], of[4]["component_id"]) == (len({tuple(words[k : k + 5]) for k in range(len(words) - 4)}), 4)
    elif key in ("op5_quality_gam", "op6_toxicity"):
        limit = 0.5 if key == "op5_quality_gam" else 0.3
        assert all(r["held_out"] in (True, False) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= limit) for r in rows)
        assert of[1]["score"] == of[2]["score"]
    elif key == "op7_language_id":
        assert (of[1]["lang_pred"], of[2]["lang_pred"], of[None]["held_out"]) == ("und", "und", False)
    elif key == "op10_bpe":
        assert [(of[i]["n_tokens"], of[i]["ids_sha256"]) for i in (1, 2)] == [(0, empty_sha)] * 2 and of[4]["n_tokens"] >= len(LONG.split())
    elif key == "op11_alignment":
        assert [(of[i]["n_a"], of[i]["n_links"], of[i]["groups_sha256"]) for i in (1, 2)] == [(0, 0, "")] * 2 and of[4]["n_a"] > 75_000
    else:
        assert [(of[i]["fingerprint"], of[i]["component_id"]) for i in (1, 2)] == [("0" * 16, 1)] * 2 and of[3]["component_id"] == 3


def test_token_counts_of_odd_rows_are_as_in_sql(spark, odd):
    key = "op9_token_counts"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{odd}/documents.parquet/*.parquet'")
    want = c.sql(registry.ORACLES[key])
    got = registry.QUERIES[key](spark, odd).select(*want.columns)
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain(got.collect()) == plain(want.fetchall())


def test_an_item_in_a_long_text_is_found_under_both_its_ids(spark, odd):
    got = registry.QUERIES["op3_decontaminate"](spark, odd).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(4, 1), (4, 2)]
    assert {(r["question_overlap"], r["answer_overlap"]) for r in got} == {(1.0, 1.0)} and len({r["score"] for r in got}) == 1


def test_licences_and_rows_of_odd_tables(spark, odd):
    got = registry.QUERIES["op8_license_scan"](spark, odd)
    assert len(set(got.columns)) == len(got.columns) and got.count() <= len(ROWS)


def test_bounds_of_items_are_those_of_each_item_by_itself(monkeypatch):
    monkeypatch.setattr(decontaminate, "ATTAINABLE_TERMS", 5)
    items = [(k, " ".join(f"term{(k * j) % 23}" for j in range(1, 4 + 7 * k))) for k in range(1, 8)]
    df = {int(t): 1 for _, text in items for t in set(decontaminate._item_words(text).tolist())}
    together = decontaminate.build_index(items, df, len(items), 20.0)
    for k, item in enumerate(items):
        alone = decontaminate.build_index([item], df, len(items), 20.0)
        assert sorted(together.weight[together.item == k].tolist()) == sorted(alone.weight.tolist())


def test_keys_that_are_called_like_results(spark):
    d = spark.createDataFrame([(1, PLAIN, 7)], "doc_id long, text string, other int")
    got = bpe.tokenize(d.withColumn("h", F.lit(3)), ["doc_id", "other", "h"])
    assert len(set(got.columns)) == len(got.columns) and got.select("doc_id", "other", "h").collect() == [(1, 7, 3)]
