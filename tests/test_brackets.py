"""Quantiles by bracketing against numpy; describe and boxplot on odd columns."""
import numpy as np
import pytest

from tidewell.operators import brackets, stats


@pytest.fixture(scope="module")
def mixed(spark):
    """NULLs, a value shared by 40 % of the rows, three distinct values, an empty column."""
    rng = np.random.default_rng(1)
    n = 40_000
    x, y = np.round(rng.normal(size=n), 3), np.where(rng.random(n) < .4, 7.0, rng.random(n) * 10)
    rows = [(None if i % 9 == 0 else float(x[i]), float(y[i]), float(i % 3), None) for i in range(n)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5).cache()


def test_bracketed_quantiles_are_exact(mixed, monkeypatch):
    ps = [0, .01, .25, .5, .75, .999, 1]
    data = {x: [r[x] for r in mixed.select(x).collect() if r[x] is not None] for x in "abc"}
    want = {(x, p): float(np.quantile(v, p)) for x, v in data.items() for p in ps}
    for small, wide in ((20_000, 1 << 60), (10, 0)):
        monkeypatch.setattr(brackets, "SMALL", small)
        monkeypatch.setattr(brackets, "WIDE", wide)
        got = {(r.feature, r.p): r.value for r in brackets.bracketed_quantiles(mixed, list("abcd"), ps).collect()}
        assert got == pytest.approx(want, abs=1e-12)


def test_brackets_keep_few_rows(mixed, monkeypatch):
    kept = []
    real = brackets.cut_lineage
    monkeypatch.setattr(brackets, "cut_lineage", lambda df: kept.append(real(df)) or kept[-1])
    brackets.bracketed_quantiles(mixed, ["a", "b"], [.25, .5, .75])
    assert kept[0].count() < 600  # of 75,000 values


def test_nan_falls_back_to_the_full_ranking(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "a double")
    assert brackets.bracketed_quantiles(df, ["a"], [.5]) is None
    assert stats.quantiles(df, ["a"], [.5]).first().value == 2.0


def test_describe_and_boxplot_skip_empty_columns(mixed, spark):
    got = {r.feature: r for r in stats.describe_numeric(mixed, list("abcd")).collect()}
    assert set(got) == set("abc") and got["b"].p75 == pytest.approx(7.0) and got["c"]["count"] == 40_000
    assert {r.feature for r in stats.boxplot_stats(mixed, ["b", "d"]).collect()} == {"b"}
    none = mixed.where("a > 1e9")
    assert stats.describe_numeric(none, ["a"]).count() == 0 == stats.boxplot_stats(none, ["a"]).count()
