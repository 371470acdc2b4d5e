"""Quality rules by distribution divergence, in DataFrame functions only.

Each text gives two histograms: character classes, and common words of four languages with one
bin for all other words. Both are compared by Jensen-Shannon distance (base 2, so 0 to 1) with
the *reference* of the document's language, which is the sum of those histograms over every other
row of that language in the table (a null language is a language of its own). A distance
counts only for texts of a least length, since short texts stray by chance, and is null where the
reference is smaller than a least size: a text of a language with next to no other text is judged by
the base rules alone. A text is kept if
it passes the base rules and neither distance exceeds its limit.

The text is read once: its features, a few dozen numbers, go to a written table from which the
references (one row a language) and the verdicts are made. Work on repeated 8-word windows is
done within the row, so a text of any length needs no shuffle.

Null and empty texts have no words and fail the base rules. Repeated rows are judged alike. A
null id is passed through. An empty table gives an empty result. A distance equal to its limit is kept. Columns
that the rules do not use are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read, stash

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
MIN_WORDS = 20
#: Texts below these sizes skip the comparison.
MIN_CHARS_COMPARED, MIN_WORDS_COMPARED = 100, 40
#: References below these sizes, the text itself left out, are compared with nothing.
MIN_REFERENCE_CHARS, MIN_REFERENCE_WORDS = 10_000, 2_000
MAX_CHAR_DISTANCE = 0.30
#: The word distance of n words may be this much, and by chance this much / sqrt(n) more.
WORD_DISTANCE, WORD_SPREAD = 0.12, 2.4

# Common function words of English, French, German and Spanish.
COMMON = (
    "the of and to a in is that it for was on are as with be at this from or an by "
    "le la les de des du et un une en que qui dans pour sur est pas par au "
    "der die das und ist den von zu mit nicht auf ein eine dem sich "
    "el los las del y con no se al como una para por es"
).split()
COMMON = list(dict.fromkeys(COMMON))
CHARS = ("upper", "digit", "space", "stop", "symbol", "rest")


def _bind(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, not once an element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur twice, from the hashes of all windows in order."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda ps, k, p: F.coalesce(F.get(ps, k).getField("h") == p["h"], F.lit(False))
    repeated = _bind(pairs, lambda ps: F.filter(ps, lambda p, k: same(ps, k - 1, p) | same(ps, k + 1, p)))
    starts = F.sort_array(F.transform(repeated, lambda p: p["i"]))
    return _bind(starts, lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))


def features(docs: DataFrame) -> DataFrame:
    """The base numbers and both histograms (arrays of long) of each text; other columns are dropped."""
    left = lambda pattern: F.length(F.regexp_replace("t", pattern, ""))
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("t"))
    d = d.select("*", F.filter(F.split("t", SPACE + "+"), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select(
        "doc_id", "lang", "w", F.size("w").alias("n"),
        F.length("t").alias("n_chars"), F.length(F.array_join("w", "")).alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"), left(r"[^\p{Lu}]+").alias("upper"), left(r"[^\p{Nd}]+").alias("digit"), left(r"[^.,;:!?'\"()\-]+").alias("stop"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.concat(F.lit(" "), F.array_join(F.filter("w", lambda x: x.isin(COMMON)), "  "), F.lit(" ")).alias("c"),
    )
    d = d.select("*", F.when(F.col("n") > WINDOW, F.transform(F.sequence(F.lit(1), F.col("n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).alias("h"))
    count = lambda w: ((F.octet_length("c") - F.octet_length(F.replace(F.col("c"), F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)).cast("long")
    d = d.select(
        "doc_id", "lang", "n", "n_chars", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.size(F.array_distinct("h")) < F.size("h"), _covered(F.col("h"))).otherwise(0).alias("n_repeat_words"),
        F.col("upper"), F.col("digit"), F.col("stop"),
        F.array(*[count(w) for w in COMMON]).alias("words"),
    )
    rest = F.col("n_chars") - sum((F.col(c) for c in ("upper", "digit", "stop", "n_symbols")), F.col("n_chars") - F.col("word_chars"))
    return d.select(
        "doc_id", "lang", *[F.col(c).cast("long").alias(a) for c, a in (("n", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("n_dup_lines", "n_dup_lines"), ("n_repeat_words", "n_repeat_words"), ("n_chars", "n_chars"))],
        F.transform(F.array("upper", "digit", F.col("n_chars") - F.col("word_chars"), "stop", "n_symbols", rest), lambda x: x.cast("long")).alias("chars"),
        F.concat("words", F.array((F.col("n") - F.aggregate("words", F.lit(0).cast("long"), lambda a, b: a + b)).cast("long"))).alias("words"),
    )


def references(found: DataFrame) -> DataFrame:
    """One row a language: both histograms and both sizes summed over all its documents."""
    sums = [F.sum(F.get(c, i)).alias(f"{c}{i}") for c, k in (("chars", len(CHARS)), ("words", len(COMMON) + 1)) for i in range(k)]
    rows = found.groupBy("lang").agg(F.sum("n_chars").alias("ref_n_chars"), F.sum("n_words").alias("ref_n_words"), *sums)
    return rows.select("lang", "ref_n_chars", "ref_n_words", *[F.array(*[f"{c}{i}" for i in range(k)]).alias(f"ref_{c}") for c, k in (("chars", len(CHARS)), ("words", len(COMMON) + 1))])


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two histograms; null if either is empty."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        term = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(0.0)
        return (term(x) + term(y)) / 2

    share = lambda c: _bind(total(F.col(c)), lambda s: F.transform(F.col(c), lambda v: F.try_divide(v.cast("double"), s)))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(share(p), share(q), part), F.lit(0.0), lambda a, b: a + b)))


def judge(docs: DataFrame) -> DataFrame:
    """The base numbers of each document of ``docs`` (doc_id, text, lang), both distances, and the verdict."""
    found = stash(features(docs))
    others = lambda c: F.zip_with(f"ref_{c}", c, lambda a, b: a - b)
    enough = lambda size, least, c: F.when(F.col(f"ref_{size}") - F.col(size) >= least, c)
    d = found.join(references(found), "lang").withColumns({"other_chars": others("chars"), "other_words": others("words")})
    d = d.withColumns({"jc": enough("n_chars", MIN_REFERENCE_CHARS, distance("chars", "other_chars")), "jw": enough("n_words", MIN_REFERENCE_WORDS, distance("words", "other_words"))})
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = lambda c, size, least, most: F.coalesce((F.col(size) >= least) & (F.col(c) > most), F.lit(False))
    strange = far("js_chars", "n_chars", MIN_CHARS_COMPARED, F.lit(MAX_CHAR_DISTANCE))
    strange |= far("js_words", "n_words", MIN_WORDS_COMPARED, WORD_DISTANCE + F.try_divide(F.lit(WORD_SPREAD), F.sqrt("n_words")))
    return (
        d.withColumns({"js_chars": F.round("jc", 6), "js_words": F.round("jw", 6)})
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "js_chars", "js_words", (~base & ~strange).alias("kept"))
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


_LIST = ", ".join("'" + w + "'" for w in COMMON)


def _js(p: str, q: str) -> str:
    share = lambda c: f"list_transform({c}, lambda x: x / nullif(list_sum({c}), 0))"
    term = "CASE WHEN {v} > 0 THEN {v} * log2({v} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform(list_zip({share(p)}, {share(q)}), lambda z: ({term.format(v='z[1]')} + {term.format(v='z[2]')}) / 2))))"


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, list_slice(w, i, i + {WINDOW - 1}) AS s FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS k FROM win) WHERE k > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM rep) GROUP BY r),
f AS (SELECT w.r, doc_id, lang, len(w) AS n_words, length(t) AS n_chars, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS up, length(regexp_replace(t, '[^\p{{Nd}}]+', '', 'g')) AS dig,
  length(regexp_replace(t, '[^.,;:!?''"()\-]+', '', 'g')) AS stop,
  list_transform([{_LIST}], lambda c: len(list_filter(w, lambda x: x = c))) AS k
  FROM w LEFT JOIN cov ON w.r = cov.r),
g AS (SELECT *, [up, dig, n_chars - word_chars, stop, n_symbols, word_chars - up - dig - stop - n_symbols]::DOUBLE[] AS chars,
  list_append(k, n_words - list_sum(k)::BIGINT)::DOUBLE[] AS words FROM f),
refs AS (SELECT lang, sum(n_chars) AS all_chars, sum(n_words) AS all_words, [{', '.join(f'sum(chars[{i + 1}])' for i in range(len(CHARS)))}] AS rc, [{', '.join(f'sum(words[{i + 1}])' for i in range(len(COMMON) + 1))}] AS rw FROM g GROUP BY lang),
o AS (SELECT g.*, all_chars - n_chars AS other_chars, all_words - n_words AS other_words, list_transform(list_zip(rc, chars), lambda z: z[1] - z[2]) AS oc, list_transform(list_zip(rw, words), lambda z: z[1] - z[2]) AS ow FROM g JOIN refs USING (lang)),
j AS (SELECT *, CASE WHEN other_chars >= {MIN_REFERENCE_CHARS} THEN round({_js('chars', 'oc')}, 6) END AS js_chars, CASE WHEN other_words >= {MIN_REFERENCE_WORDS} THEN round({_js('words', 'ow')}, 6) END AS js_words FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed, js_chars, js_words,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words)
  AND NOT coalesce(n_chars >= {MIN_CHARS_COMPARED} AND js_chars > {MAX_CHAR_DISTANCE}, false)
  AND NOT coalesce(n_words >= {MIN_WORDS_COMPARED} AND js_words > {WORD_DISTANCE} + {WORD_SPREAD} / sqrt(n_words), false) AS kept
FROM j
"""
