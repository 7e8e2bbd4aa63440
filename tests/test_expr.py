import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonflow.functions.expr import compile_expression, erf, names, with_mappings


def one(spark, source, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(compile_expression(source, lambda n: F.col(n)).alias("v")).first()["v"]


def test_arithmetic_follows_numpy(spark):
    assert one(spark, "x % y", x=-1.5, y=1.0) == 0.5
    assert one(spark, "1.0 / x", x=0.0) is None
    assert one(spark, "(x >= 1) * (x < 2) + 0.5", x=1.0) == 1.5
    assert one(spark, "clip(x, 0, 3) ** 2 + where(x > 4, 1, 2)", x=5.0) == 10
    assert one(spark, "arctan2(x, 1) + numpy.pi", x=1.0) == pytest.approx(1.25 * math.pi)
    assert one(spark, "piecewiseLinear(x, [0, 10], [1.0, 2.0])", x=12.0) == 14
    assert one(spark, "round(x)", x=2.5) == 2


def test_erf(spark):
    df = spark.createDataFrame([(x / 4,) for x in range(-12, 13)], ["x"]).select("x", erf(F.col("x")).alias("e"))
    assert all(abs(r.e - math.erf(r.x)) < 2e-7 for r in df.collect())


def test_names_mean_source_then_variable_then_mapping(spark):
    df = spark.createDataFrame([(1.0, 2.0)], ["x", "dx"])
    r = with_mappings(df, {"x": "x + dx", "y": "z * 2", "z": "x + k"}, {"k": 10}).first()
    assert (r.x, r.z, r.y) == (3, 11, 22)
    with pytest.raises(ValueError, match="circular"):
        with_mappings(df, {"a": "b", "b": "c", "c": "a"})
    with pytest.raises(KeyError):
        with_mappings(df, {"a": "nowhere"})


@pytest.mark.parametrize("source", ["__import__('os')", "x.real", "[x for x in y]", "open(x)", "'a'", "lambda: x", "exp(x, base=2)"])
def test_nothing_else_compiles(source):
    with pytest.raises(ValueError):
        compile_expression(source, lambda n: F.col(n))


def test_names():
    assert names("exp(x) + numpy.pi * y") == {"x", "y"}


def test_whole_columns_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.permutation(500) / 7.0
    rows = [(i, float(v) if i % 50 else None, float(i % 3)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "i long, x double, y double").repartition(7)
    maps = {"a": "x - mean(x)", "b": "cumsum(x)", "c": "diff(a * 2)", "d": "max(cumsum(x - mean(x))) + numpy.sum(y)", "e": "min(x) + std(y)"}
    got = sorted(map(tuple, with_mappings(df, maps, order=["i"]).select("i", *maps).collect()))
    v = np.array([np.nan if r[1] is None else r[1] for r in rows])
    a = v - np.nanmean(v)
    want = [a, np.nancumsum(v), np.concatenate([[np.nan], np.diff(a * 2)]), np.full(500, np.nancumsum(v - np.nanmean(v)).max() + sum(r[2] for r in rows)), np.full(500, np.nanmin(v) + np.std([r[2] for r in rows]))]
    for k, w in enumerate(want):
        assert np.allclose([np.nan if g[k + 1] is None else g[k + 1] for g in got], w, equal_nan=True)
    with pytest.raises(ValueError):
        with_mappings(df, {"b": "cumsum(x)"})
    assert with_mappings(df.where("false"), maps, order=["i"]).count() == 0
