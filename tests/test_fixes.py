"""Wrong answers found in review, each with the case that showed it."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import edit, impute, models, scale, stats
from tidewell.operators.small import small_side
from tidewell.plans.prepare import PrepConfig, prepare
from tidewell.sources import tables
from tidewell.spec import Spec


def test_nan_cells_are_read_as_null(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("id,a,b\nx,NaN,1\ny,2.5,\n")
    got = {r.id: r.a for r in tables.read_table(spark, path).collect()}
    assert got == {"x": None, "y": 2.5}
    spark.createDataFrame([("x", float("nan"))], "id string, a double").write.parquet(str(tmp_path / "p"))
    assert tables.read_table(spark, str(tmp_path / "p"), "parquet").first().a is None


def test_edits_blank_cells_and_have_an_order(spark):
    df = spark.createDataFrame([("1", "a", 1.0), ("2", "b", 2.0)], "id string, t string, v double")
    ch = spark.createDataFrame([("edit", "1", "t", None, 1), ("edit", "2", "v", "9", 2), ("edit", "2", "v", "7", 3)],
                               "op string, id string, col string, value string, seq int")
    got = {r.id: (r.t, r.v) for r in edit.apply_changes(df, ch).collect()}
    assert got == {"1": (None, 1.0), "2": ("b", 7.0)}


def test_duplicate_columns_by_position(spark):
    df = spark.createDataFrame([(1, 2, 2), (2, 1, 1), (3, 3, 3)], "a int, b int, c int")
    assert impute.duplicate_columns(df, ["a", "b", "c"]) == ["c"]


def test_power_lambda_outside_the_first_bracket(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(10, 1, size=400) ** (1 / 8.0) - 1  # (x + 1)^8 is normal
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = scale.fit_power(df, ["x"]).first()["lmbda"]

    def ll(k):
        t = ((x + 1) ** k - 1) / k
        return -len(x) / 2 * math.log(t.var()) + (k - 1) * np.log1p(x).sum()
    grid = np.arange(-20, 30, 0.25) + 0.0005
    best = grid[np.argmax([ll(k) for k in grid])]
    assert best > 4 and abs(lam - best) < 0.5 and ll(lam) >= ll(best) - 0.05


def test_train_teaches_the_other_parts(spark):
    rows = [(str(i), float(i), 2.0 * i if i % 5 else None, "A" if i % 2 else "B") for i in range(1, 101)]
    lab = spark.createDataFrame(rows, "id string, x double, y double, label string")
    unl = spark.createDataFrame([("u1", 200.0, None, None), ("u2", 11.5, None, None)], "id string, x double, y double, label string")
    for method in ("linear", "polynomial"):
        out = prepare(lab, unl, Spec("id", "label"), PrepConfig(filter=False, impute=method, oversample=None))
        for part in ("train", "test", "unlabelled"):
            assert all(abs(r.y - 2 * r.x) < 0.1 for r in out[part].collect()), (method, part)


def test_gram_matrices_equal_plain_products(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    rows = [(*map(float, v), bool(i % 3 == 0)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, __m1 boolean").repartition(3)
    _, places = impute._design(["a", "b", "c"], "polynomial", 2)
    got = impute._grams(df, ["a", "b", "c"], places, {"b": 1})["b"]
    z = np.column_stack([np.ones(60), *[x[:, list(p)].prod(axis=1) for p in places]])[[i for i in range(60) if i % 3]]
    assert np.allclose(got, z.T @ z)


def test_many_polynomial_features_are_allowed(spark):
    rng = np.random.default_rng(2)
    names = [f"f{i}" for i in range(42)]
    df = spark.createDataFrame([(str(i), *map(float, rng.normal(size=41)), None if i == 3 else 1.0, "A") for i in range(60)],
                               "id string, " + ", ".join(f"{n} double" for n in names) + ", label string")
    out = impute.impute(df, Spec("id", "label", tuple(names)), "polynomial", max_iter=1, ridge=1.0)
    assert out.filter(F.col("f41").isNull()).count() == 0


def test_class_absent_from_train_scores_zero(spark):
    rows = [(str(i), float(i % 2), float(i), "AB"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, x double, y double, label string")
    spec = Spec("id", "label", ("x", "y"))
    for family in ("RandomForestGini", "LightGBM", "LR"):
        m = models.fit_model(df, spec, family, classes=["A", "B", "C"])
        p = {r["class"]: r.p for r in models.predict_proba(m, df.limit(1), "id").collect()}
        assert set(p) == {"A", "B", "C"} and p["C"] == pytest.approx(0.0, abs=0.02)


def test_leaderboard_scores_the_metric_it_names(spark):
    rows = [(str(i), float(i % 10 == 0), "A" if i % 10 == 0 or i % 7 == 0 else "B") for i in range(200)]
    df = spark.createDataFrame(rows, "id string, x double, label string")
    spec = Spec("id", "label", ("x",))
    m = models.fit_model(df, spec, "LR")
    board = models.leaderboard([m], spec, test=df, metric="f1_macro", extra_metrics=["accuracy", "mcc", "log_loss"]).first()
    pred = {r.id: r.predicted for r in models.predict(m, df).collect()}
    pairs = [(r[2], pred[r[0]]) for r in rows]
    acc = sum(a == b for a, b in pairs) / len(pairs)
    f1 = np.mean([2 * sum(a == b == k for a, b in pairs) / (sum(a == k for a, _ in pairs) + sum(b == k for _, b in pairs))
                  for k in "AB"])
    assert board.score_test == pytest.approx(f1) and board.accuracy == pytest.approx(acc) and board.eval_metric == "f1_macro"
    assert board.log_loss < 0 and -1 <= board.mcc <= 1
    with pytest.raises(ValueError):
        models.leaderboard([m], spec, test=df, metric="nonsense")


def test_side_tables_leave_no_cache_and_follow_the_input(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a",)] * 3 + [("b",)] * 6, "label string").write.parquet(path)
    assert {r.label for r in stats.filter_min_class(spark.read.parquet(path), "label", 5).collect()} == {"b"}
    spark.createDataFrame([("a",)] * 50 + [("b",)], "label string").write.mode("overwrite").parquet(path)
    assert {r.label for r in stats.filter_min_class(spark.read.parquet(path), "label", 5).collect()} == {"a"}
    small = small_side(spark.range(3).toDF("x"))
    assert not small.is_cached and spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_correlations_with_gaps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3)) + 1e6
    rows = [tuple(None if (i + j) % 9 == 0 else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    got = {(r.col_a, r.col_b): r.corr for r in stats.corr_matrix(
        spark.createDataFrame(rows, "a double, b double, c double").repartition(3), ["a", "b", "c"]).collect()}
    import pandas as pd
    want = pd.DataFrame(rows, columns=list("abc"), dtype=float).corr()
    assert all(got[(a, b)] == pytest.approx(want.loc[a, b], abs=1e-9) for a in "abc" for b in "abc")


def test_bagged_neighbours_keep_their_weights_and_ensembles_reload(spark, tmp_path):
    from tidewell.operators import ensemble
    from tidewell.sources import runs
    rng = np.random.default_rng(5)
    rows = [(str(i), *map(float, rng.normal(size=2) + (i % 2)), "AB"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, x double, y double, label string")
    spec = Spec("id", "label", ("x", "y"))
    near, _ = ensemble.bag(df, spec, "KNeighborsDist", 2)
    assert near.extra["weights"] == "distance"
    tree, lr = models.fit_model(df, spec, "RandomForestGini"), models.fit_model(df, spec, "LR")
    both = models.Trained("W", "WeightedEnsemble", ["A", "B"], ["x", "y"],
                          extra={"members": [(near, 0.5), (lr, 0.5)], "weights": {near.name: 0.5, "LR": 0.5}})
    runs.save_run(str(tmp_path / "run"), {"preset": "medium"}, [near, tree, both], df, df)
    again = runs.load_run(spark, str(tmp_path / "run"))["models"]
    assert set(again) == {near.name, tree.name, "W"}
    probe = df.limit(7)
    for m in (near, tree, both):
        was = {(r.id, r["class"]): r.p for r in models.predict_proba(m, probe).collect()}
        now = {(r.id, r["class"]): r.p for r in models.predict_proba(again[m.name], probe).collect()}
        assert was.keys() == now.keys() and all(was[k] == pytest.approx(now[k]) for k in was)
