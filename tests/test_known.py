"""Hand-worked answers and invariants."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import edit as U
from tidewell.operators import importance as IMP
from tidewell.operators import impute as I
from tidewell.operators import knn as K
from tidewell.operators import metrics as E
from tidewell.operators import models as M
from tidewell.operators import reduce as W
from tidewell.operators import sample as O
from tidewell.operators import scale as N
from tidewell.operators import split as T
from tidewell.operators import stats as G
from tidewell.operators.ranking import group_rank
from tidewell.plans import fixtures as X
from tidewell.spec import Spec
from tests.conftest import MEDIUM, SMALL


def _col(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_scalers_on_1_2_4(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 5.0), ("c", 4.0, 5.0)], "id string, x double, k double")
    std = N.scale(df, ["x", "k"], "standard")[0]
    sd = math.sqrt(42 / 27)
    assert _col(std, "x") == pytest.approx([(1 - 7 / 3) / sd, (2 - 7 / 3) / sd, (4 - 7 / 3) / sd])
    assert _col(std, "k") == pytest.approx([0.0, 0.0, 0.0])
    assert _col(N.scale(df, ["x", "k"], "minmax")[0], "x") == pytest.approx([0, 1 / 3, 1])
    assert _col(N.scale(df, ["x", "k"], "minmax")[0], "k") == pytest.approx([0, 0, 0])
    assert _col(N.scale(df, ["x"], "maxabs")[0], "x") == pytest.approx([0.25, 0.5, 1.0])
    assert _col(N.scale(df, ["x"], "robust")[0], "x") == pytest.approx([-1 / 1.5, 0.0, 2 / 1.5])
    assert _col(N.normalize_rows(df, ["x", "k"], "l1"), "x") == pytest.approx([1 / 6, 2 / 7, 4 / 9])


def test_nan_aware_distance():
    P = np.array([[1.0, np.nan, 3.0]])
    B = np.array([[2.0, 2.0, np.nan], [np.nan, 1.0, np.nan]])
    D = K._pairwise(P, B)
    assert D[0, 0] == pytest.approx(math.sqrt(3.0))
    assert np.isnan(D[0, 1])


def test_confusion_matrix_with_unpredicted_class(spark):
    pairs = spark.createDataFrame([("1", "a", "a"), ("2", "a", "b"), ("3", "b", "b"), ("4", "c", "b")],
                                  "id string, actual string, predicted string")
    cm = {(r["actual"], r["predicted"]): r["n"] for r in E.confusion_matrix(pairs).collect()}
    assert len(cm) == 9 and cm[("c", "c")] == 0 and cm[("c", "b")] == 1 and cm[("a", "a")] == 1
    rep = {r["label"]: r for r in E.classification_report(pairs).collect()}
    assert rep["c"]["precision"] == 0.0 and rep["c"]["recall"] == 0.0
    assert rep["accuracy"]["f1"] == pytest.approx(0.5)
    assert rep["b"]["precision"] == pytest.approx(1 / 3)


def test_t_statistics_match_stored_importance_row():
    mean, sd, n = 0.27313915857605175, 0.018953463384267077, 5
    t = mean / (sd / math.sqrt(n))
    assert IMP.t_sf(t, n - 1) == pytest.approx(2.7644999069204633e-06, rel=1e-6)
    half = IMP.t_ppf(0.995, n - 1) * sd / math.sqrt(n)
    assert mean + half == pytest.approx(0.31216460164896087, rel=1e-9)
    assert mean - half == pytest.approx(0.23411371550314264, rel=1e-9)


def test_group_rank_matches_window_with_hot_group_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        g = "hot" if i % 2 == 0 else f"g{i % 7}"
        v = float(rng.integers(0, 5)) if g == "hot" else float(rng.normal())
        rows.append((f"{i:05d}", g, v))
    df = spark.createDataFrame(rows, "id string, g string, v double")
    ours = group_rank(df, ["g"], ["v", "id"], "rn", "n", partitions=13)
    ref = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    j = ours.join(ref.select("id", "rn2"), "id")
    assert j.filter(F.col("rn") != F.col("rn2")).count() == 0
    assert j.count() == 3000


def test_exact_quantiles_with_ties(spark):
    vals = [1.0, 2.0, 2.0, 2.0, 3.0, 7.0, 7.0, 10.0, 11.0]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(vals)], "id string, x double")
    got = {r["p"]: r["value"] for r in G.quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(float(np.percentile(vals, p * 100)))


def test_split_is_disjoint_with_quotas(spark):
    li = G.filter_min_class(X.li(spark, SMALL))
    tagged = T.assign_split(li, "id", "label", 0.2).cache()
    counts = {(r["label"], r["split"]): r["count"] for r in tagged.groupBy("label", "split").count().collect()}
    for lab in {k[0] for k in counts}:
        n = counts.get((lab, "test"), 0) + counts.get((lab, "train"), 0)
        assert counts.get((lab, "test"), 0) == round(n * 0.2)
    assert tagged.select("id").distinct().count() == tagged.count()


def test_kfold_balances_classes(spark):
    folds = T.kfold(X.emb(spark, SMALL), 5, 2)
    per = folds.groupBy("label", "repeat", "fold").count()
    spread = per.groupBy("label", "repeat").agg((F.max("count") - F.min("count")).alias("d"))
    assert spread.agg(F.max("d")).collect()[0][0] <= 1


def test_oversampling_reaches_the_majority(spark):
    e = X.emb(spark, SMALL)
    top = G.class_counts(e).agg(F.max("n")).collect()[0][0]
    for out in (O.oversample_random(e, X.EMB_SPEC), O.smote(e, X.EMB_SPEC, 3)):
        c = G.class_counts(out).collect()
        assert all(r["n"] == top for r in c)


def test_smote_points_lie_inside_class_box(spark):
    e = X.emb(spark, SMALL)
    out = O.smote(e, X.EMB_SPEC, 3)
    box = e.groupBy("label").agg(*[F.min(f).alias(f"lo_{f}") for f in X.EMB_FEATURES],
                                 *[F.max(f).alias(f"hi_{f}") for f in X.EMB_FEATURES])
    j = out.filter("synthetic").join(box, "label")
    bad = None
    for f in X.EMB_FEATURES:
        cond = (F.col(f) < F.col(f"lo_{f}") - 1e-9) | (F.col(f) > F.col(f"hi_{f}") + 1e-9)
        bad = cond if bad is None else bad | cond
    assert j.filter(bad).count() == 0


def test_explode_count_two_levels(spark):
    df = spark.createDataFrame([("a", 10), ("b", 0), ("c", 3)], "id string, n int")
    out = O.explode_count(df, "n", "copy", chunk=4)
    got = {(r["id"], r["copy"]) for r in out.collect()}
    assert got == {("a", i) for i in range(10)} | {("c", i) for i in range(3)}


def test_model_probabilities_sum_to_one(spark):
    e = X.emb(spark, SMALL)
    for fam in ("RandomForestGini", "LR", "KNeighborsUnif", "LightGBMXT"):
        m = M.fit_model(e, X.EMB_SPEC, fam)
        s = M.predict_proba(m, e).groupBy("id").agg(F.sum("p").alias("s"))
        assert s.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_importance_of_unused_column_is_zero(spark):
    e = X.emb(spark, SMALL).withColumn("const", F.lit(1.0))
    spec = Spec("id", "label", tuple(X.EMB_FEATURES) + ("const",))
    m = M.fit_model(e, spec, "LR")
    imp = {r["feature"]: r for r in IMP.feature_importance(m, e, spec, 3).collect()}
    assert imp["const"]["importance"] == 0.0


def test_results_do_not_depend_on_shuffle_partitions(spark):
    li = X.li(spark, SMALL)
    a = T.assign_split(li, "id", "label", 0.2)
    base = {(r["id"], r["split"]) for r in a.collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        b = {(r["id"], r["split"]) for r in T.assign_split(li, "id", "label", 0.2).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert base == b


def test_apply_changes_order(spark):
    df = spark.createDataFrame([("1", "x", 1.0), ("2", "y", 2.0)], "id string, name string, v double")
    ch = spark.createDataFrame([("edit", "1", "v", "9.5"), ("delete", "2", None, None),
                                ("add", "3", "name", "z"), ("add", "3", "v", "3.0")],
                               "op string, id string, col string, value string")
    got = {r["id"]: (r["name"], r["v"]) for r in U.apply_changes(df, ch).collect()}
    assert got == {"1": ("x", 9.5), "3": ("z", 3.0)}


def test_power_lambda_close_to_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.lognormal(0, 0.7, 400)
    df = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(x)], "id string, x double")
    lam = N.fit_power(df, ["x"]).collect()[0]["lmbda"]

    def yj(v, l):
        return ((v + 1) ** l - 1) / l if abs(l) > 1e-12 else np.log1p(v)

    def ll(l):
        t = yj(x, l)
        return -len(x) / 2 * np.log(t.var()) + (l - 1) * np.sum(np.log1p(x))
    grid = np.linspace(-3, 3, 6001)
    best = grid[np.argmax([ll(g) for g in grid])]
    assert lam == pytest.approx(best, abs=0.01)


def test_quantile_transform_uniform(spark):
    vals = [float(v) for v in [3, 1, 4, 1, 5, 9, 2, 6, 5, 3]]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(vals)], "id string, x double")
    out, params = N.scale(df, ["x"], "quantile", n_quantiles=5)
    q = np.percentile(vals, np.linspace(0, 100, 5))
    r = np.linspace(0, 1, 5)
    exp = 0.5 * (np.interp(vals, q, r) - np.interp([-v for v in vals], -q[::-1], -r[::-1]))
    got = [row["x"] for row in out.orderBy(F.col("id").cast("int")).collect()]
    assert got == pytest.approx(list(exp))


def test_linear_imputation_recovers_linear_column(spark):
    rows = [(str(i), float(i), (2.0 * i + 1.0) if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, a double, b double")
    out = I.impute_iterative(df, Spec("id", "label", ("a", "b")), "linear", max_iter=3)
    for r in out.collect():
        assert r["b"] == pytest.approx(2.0 * r["a"] + 1.0, rel=1e-4)


def test_reduce_proportion_keeps_all_when_m_equals_n(spark):
    e = X.emb(spark, SMALL)
    assert W.reduce_per_class(e, X.EMB_SPEC, 1.0, "proportion").count() == e.count()


def test_normal_ppf():
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    df = s.createDataFrame([(p,) for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.99)], "u double")
    got = [r[0] for r in df.select(N._norm_ppf(F.col("u"))).collect()]
    exp = [statistics.NormalDist().inv_cdf(p) for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.99)]
    assert got == pytest.approx(exp, abs=1e-7)


def test_auc_of_perfect_scores(spark):
    truth = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "id string, label string")
    probs = spark.createDataFrame([("1", "a", 0.9), ("1", "b", 0.1), ("2", "a", 0.8), ("2", "b", 0.2),
                                   ("3", "a", 0.3), ("3", "b", 0.7)], "id string, class string, p double")
    auc = {r["class"]: r["auc"] for r in E.roc_auc_ovr(probs, truth).collect()}
    assert auc["a"] == 1.0 and auc["b"] == 1.0 and auc[None] == 1.0


def test_distinct_sf_medium_available():
    import os
    assert os.path.exists(f"{MEDIUM}/lineitem.parquet")


def test_smotenc_invariants(spark):
    d = X.dcat(spark, SMALL)
    out = O.smotenc(d, Spec("id", "label", ("n_chars", "n_words")), ["lang", "source"], 3)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert len(set(counts.values())) == 1
    syn = out.filter("synthetic")
    box = d.groupBy("label").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    assert syn.join(box, "label").filter((F.col("n_chars") < F.col("lo") - 1e-9) |
                                         (F.col("n_chars") > F.col("hi") + 1e-9)).count() == 0
    langs = {r[0] for r in d.select("lang").distinct().collect()}
    assert {r[0] for r in syn.select("lang").distinct().collect()} <= langs


def test_preset_good_bags_stacks_and_refits(spark):
    from tidewell.operators import ensemble as ENS
    e = X.emb(spark, SMALL)
    models, val = ENS.fit_preset(e, X.EMB_SPEC, "good", families=["LR"], ensemble_steps=3)
    names = [m.name for m in models]
    assert names == ["LR_BAG_L1", "LR_BAG_L2", "WeightedEnsemble_L2", "LR_FULL"]
    board = M.leaderboard(models, X.EMB_SPEC, test=e, val=val).collect()
    assert all(0.0 <= r["score_test"] <= 1.0 for r in board)


def test_polynomial_imputation_recovers_square(spark):
    rows = [(str(i), float(i) / 10, (float(i) / 10) ** 2 + 1.0 if i % 6 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, a double, b double")
    out = I.impute_iterative(df, Spec("id", "label", ("a", "b")), "polynomial", max_iter=3)
    for r in out.collect():
        assert r["b"] == pytest.approx(r["a"] ** 2 + 1.0, rel=1e-3, abs=1e-3)


def test_check_stacking_reports_both_scores(spark):
    from tidewell.operators import ensemble as ENS
    r = ENS.check_stacking(X.emb(spark, SMALL), X.EMB_SPEC, ["LR"], n_folds=2)
    assert set(r) == {"use_stacking", "score_l1", "score_l2"}
    assert 0.0 <= r["score_l1"] <= 1.0 and 0.0 <= r["score_l2"] <= 1.0


def test_many_quantiles_against_numpy(spark):
    rng = np.random.default_rng(7)
    vals = list(np.round(rng.normal(size=700), 1))  # many ties
    df = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(vals)], "id string, x double")
    probs = [k / 100 for k in range(101)]
    got = {round(r["p"], 6): r["value"] for r in G.quantiles(df, ["x"], probs).collect()}
    assert len(got) == 101
    for p in probs:
        assert got[round(p, 6)] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-9)


def test_select_rows_by_key(spark):
    e = X.emb(spark, SMALL)
    ids = [r["id"] for r in e.orderBy("id").limit(3).collect()]
    got = U.select_rows(e, ids, ["e0", "label"])
    assert sorted(r["id"] for r in got.collect()) == sorted(ids)
    assert got.columns == ["id", "e0", "label"]


def test_value_ordered_rank_does_not_depend_on_partitions(spark):
    e = X.emb(spark, SMALL)
    base = {r["id"] for r in W.reduce_per_class(e, X.EMB_SPEC, 0.8, "proportion").collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        other = {r["id"] for r in W.reduce_per_class(e, X.EMB_SPEC, 0.8, "proportion").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert base == other
