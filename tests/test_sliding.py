"""Sliding statistics put together from parts, against each window worked out by itself."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidemark.functions.columns import by
from tidemark.operators import prices as P
from tidemark.operators import sliding as S

CHAINS = {
    "m": S.Chain(S.MOMENTS, "x", (5, 20, 60)),
    "t": S.Chain(S.TOTAL, "x", (5, 25, 50)),
    "e": S.Chain(S.EXTREMES, "x", (5, 25, 40, 63)),
}


def series():
    rng = np.random.default_rng(5)
    jumps = [float(v) for v in rng.normal(size=150) * np.repeat(10.0 ** rng.integers(-5, 6, 15), 10)]
    holes = [None if rng.random() < 0.3 else float(v) for v in rng.normal(size=90)]
    return {1: jumps, 2: holes, 3: [0.1] * 80, 4: [None] * 7 + [2.0, 3.0, 5.0], 5: [7.0], 6: [1e8, 1e-8] * 40}


def shape(values):
    """(mean, deviation, skewness) in exact numbers up to the roots."""
    v = [Fraction(x) for x in values]
    n = len(v)
    if not n:
        return None, None, None
    mean = sum(v) / n
    m2, m3 = (sum((x - mean) ** k for x in v) for k in (2, 3))
    skew = float(m3) / float(m2) ** 1.5 * n * math.sqrt(n - 1) / (n - 2) if n > 2 and m2 else None
    return float(mean), math.sqrt(float(m2 / (n - 1))) if n > 1 else None, skew


def test_sliding_statistics_equal_those_of_each_window(spark):
    rows = [(k, i, x) for k, xs in series().items() for i, x in enumerate(xs)]
    d = spark.createDataFrame(rows, "k long, i long, x double").repartition(3)
    got = S.slide(d, by("k", order="i"), CHAINS)
    fields = [S.deviation("m", n).alias(f"d{n}") for n in (20, 60)] + [S.skewness("m", 60).alias("s60"), S.mean("t", 50).alias("t50")]
    got = got.select("k", "i", *fields, S.field("m", 60, "mean").alias("m60"), S.field("e", 63, "lo").alias("lo"), S.field("e", 63, "hi").alias("hi"))
    found = {(r.k, r.i): r for r in got.collect()}
    assert len(found) == len(rows)
    for k, xs in series().items():
        for i in range(len(xs)):
            r, last = found[k, i], lambda n: [x for x in xs[max(0, i + 1 - n) : i + 1] if x is not None]  # noqa: B023
            assert (r.lo, r.hi) == ((min(last(63)), max(last(63))) if last(63) else (None, None))
            m60, d60, s60 = shape(last(60))
            for value, wanted in ((r.m60, m60), (r.d60, d60), (r.s60, s60), (r.d20, shape(last(20))[1]), (r.t50, shape(last(50))[0])):
                assert value == (None if wanted is None else pytest.approx(wanted, rel=1e-9, abs=1e-15)), (k, i)


def test_equal_values_have_no_deviation_at_all(spark):
    d = spark.createDataFrame([(1, i, 0.1) for i in range(70)], "k long, i long, x double")
    assert {tuple(r) for r in S.slide(d, by("k", order="i"), CHAINS).where("i > 0").select(S.deviation("m", 60)).collect()} == {(0.0,)}


def test_sizes_must_fit_but_for_extremes():
    assert S.Chain(S.EXTREMES, "x", (4, 7)).back(1) == [0, 3]
    assert S.Chain(S.TOTAL, "x", (4, 8)).back(1) == [0, 4]
    for sizes in ((4, 7), (4, 4)):
        with pytest.raises(ValueError):
            S.Chain(S.TOTAL, "x", sizes)


def test_an_empty_table_has_no_windows(spark):
    assert S.slide(spark.createDataFrame([], "k long, i long, x double"), by("k", order="i"), CHAINS).count() == 0


def test_price_features_take_one_exchange_and_one_sort(spark):
    d = spark.createDataFrame([], "ticker long, date date, high double, low double, volume double, closeadj double")
    plan = P.price_features(d)._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange "), plan.count("Sort [")) == (1, 1)
