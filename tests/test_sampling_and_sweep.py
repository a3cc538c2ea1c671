"""Cluster shares, kernel support vectors, importance by self-join and the resumable sweep."""

import math
import statistics
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewell.operators import importance as IMP
from tidewell.operators import models as M
from tidewell.operators import sample as O
from tidewell.operators import stats as G
from tidewell.plans import fixtures as X
from tidewell.plans.teacher import sweep
from tidewell.spec import Spec

SPEC = Spec("id", "label", ("x", "y"))


def _rings(spark, n=240, seed=4):
    """A disc of the small class inside a ring of the large one: no line separates them."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        inner = i % 4 == 0
        r, a = (rng.uniform(0, 1.0) if inner else rng.uniform(2.0, 3.0)), rng.uniform(0, 2 * math.pi)
        rows.append((f"{i:04d}", "in" if inner else "out", float(r * math.cos(a)), float(r * math.sin(a))))
    return spark.createDataFrame(rows, "id string, label string, x double, y double")


def test_fourier_features_approach_the_kernel(spark):
    from pyspark.ml.functions import vector_to_array
    df = _rings(spark, 60)
    rows = O.fourier_features(df, ["x", "y"], 4096, gamma=0.7).select("x", "y", vector_to_array("__v").alias("v")).collect()
    pts, z = np.array([(r.x, r.y) for r in rows]), np.array([r.v for r in rows])
    kernel = np.exp(-0.7 * ((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 0.1


def test_kernel_margins_separate_what_no_line_does(spark):
    df = _rings(spark)
    vec = O.fourier_features(df, SPEC.feats)
    got = O.rbf_margins(vec, "label", "in", df.count()).select("label", "__margin").collect()
    assert sum((r["__margin"] > 0) == (r["label"] == "in") for r in got) / len(got) > 0.95


def test_svm_smote_extrapolates_from_safe_seeds(spark):
    df = _rings(spark)
    out = O.svm_smote(df, SPEC, k=3, m=5)
    made = out.filter("synthetic").collect()
    counts = {r["label"]: r["n"] for r in G.class_counts(out).collect()}
    assert counts["in"] == counts["out"] == 180
    at = {r["id"]: (r["x"], r["y"]) for r in df.collect()}
    cls = {r["id"] for r in df.filter("label = 'in'").collect()}
    # every seed here is safe: a step of at most half the distance, away from one of its three neighbours
    for r in made:
        seed = r["id"].rsplit("#", 1)[0]
        p = np.array(at[seed])
        near = sorted((float(np.hypot(*(np.array(at[j]) - p))), j) for j in cls if j != seed)[:3]
        step = np.array([r["x"], r["y"]]) - p
        u = [-(step @ (np.array(at[j]) - p)) / d ** 2 for d, j in near if np.allclose(
            step * d, -np.hypot(*step) * (np.array(at[j]) - p), atol=1e-9)]
        assert any(-1e-9 <= x <= 0.5 + 1e-9 for x in u)
    assert O.svm_smote(df.filter("label = 'in'"), SPEC).filter("synthetic").count() == 0


def _clustered(spark):
    rng = np.random.default_rng(9)
    rows = [(f"b{i}", "big", float(rng.normal()), float(rng.normal()), i % 2) for i in range(100)]
    rows += [(f"s{i}", "small", float(rng.normal()), float(rng.normal()), 0) for i in range(12)]
    rows += [(f"t{i}", "small", float(5 * rng.normal()), float(5 * rng.normal()), 1) for i in range(12)]
    rows += [("u0", "small", 0.0, 0.0, 2), *[(f"v{i}", "big", 1.0, float(i), 2) for i in range(3)]]
    return spark.createDataFrame(rows, "id string, label string, x double, y double, k int")


def test_cluster_shares_follow_sparsity(spark):
    df = _clustered(spark)
    got = {(r["label"], r["k"]): r["need"] for r in O.cluster_needs(df, SPEC, "k", threshold=0.05).collect()}
    assert set(got) == {("small", 0), ("small", 1)} and sum(got.values()) == 103 - 25
    w = {}
    for k in (0, 1):
        pts = [(r["x"], r["y"]) for r in df.filter(f"label = 'small' AND k = {k}").collect()]
        spread = math.sqrt(2 * sum(statistics.variance(a) for a in zip(*pts)))
        pairs = [math.dist(a, b) ** 2 for i, a in enumerate(pts) for b in pts[:i]]
        assert spread == pytest.approx(math.sqrt(statistics.mean(pairs)))
        w[k] = spread ** (0.16 * math.log(len(pts), 1.6) ** 1.8) / len(pts)
    assert abs(got[("small", 0)] - 78 * w[0] / sum(w.values())) < 1
    assert O.cluster_needs(df, SPEC, "k", threshold=0.9).count() == 0


def test_kmeans_smote_reaches_the_majority_inside_clusters(spark):
    df = _clustered(spark).drop("k")
    for clusters in (1, 3):
        out = O.kmeans_smote(df, SPEC, 3, clusters, threshold=0.0)
        assert {r["n"] for r in G.class_counts(out).collect()} == {103}
        assert out.select("id").distinct().count() == 206
    none = O.kmeans_smote(df, SPEC, 3, 2, threshold=1.1)
    assert none.filter("synthetic").count() == 0 and none.count() == df.count()


def test_permuted_scores_move_rows_once_a_shuffle(spark):
    rows = [(str(i), "a" if i % 2 else "b", float(i % 2), float(i % 5)) for i in range(80)]
    df = spark.createDataFrame(rows, "id string, label string, x double, y double")
    m = M.fit_model(df, SPEC, "LR")
    scores = IMP.permuted_scores(m, df, SPEC, shuffles=3)
    got = {(r["feature"], r["shuffle"]): r["score"] for r in scores.collect()}
    assert set(got) == {(f, s) for f in ("x", "y") for s in range(3)}
    assert all(got["y", s] == 1.0 for s in range(3)) and all(got["x", s] < 0.9 for s in range(3))
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    # single features appear above the join, not below it
    assert plan.index("feature#") < plan.index("Join Inner")


def test_sweep_resumes_without_running_finished_cells(spark):
    path, ran = tempfile.mkdtemp(prefix="sweep-") + "/s", []
    e = X.emb(spark, SMALL)

    def cell(a, b):
        ran.append((a, b))
        if (a, b) == ("q", "0.80") and len(ran) < 4:
            raise RuntimeError("stopped midway")
        return spark.createDataFrame([(f"{a}-{b}", e.count())], "model string, n bigint")

    grid = {"a": ["p", "q"], "b": ["0.80", "0.9"]}
    with pytest.raises(RuntimeError):
        sweep(grid, cell, path, spark)
    assert ran == [("p", "0.80"), ("p", "0.9"), ("q", "0.80")]
    # a cell whose board was written but not listed is written anew, not twice
    spark.createDataFrame([("half", 0, "q", "0.9")], "model string, n bigint, a string, b string").write.mode(
        "append").partitionBy("a", "b").parquet(f"{path}/boards")
    out = sweep(grid, cell, path, spark)
    assert ran[3:] == [("q", "0.80"), ("q", "0.9")]
    assert {(r["model"], r["a"], r["b"]) for r in out.collect()} == {
        (f"{a}-{b}", a, b) for a in "pq" for b in ("0.80", "0.9")} and out.count() == 4
    assert sweep({"a": ["p"], "b": ["0.9"]}, cell, path, spark).count() == 1 and len(ran) == 5
