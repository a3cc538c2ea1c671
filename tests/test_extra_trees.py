"""Extra-trees: whole sample, random thresholds of random features, the same trees however rows are dealt."""

import numpy as np
import pytest

from tidewell.operators import extratrees as X
from tidewell.operators import models as M
from tidewell.spec import Spec

FEATS = ("a", "b", "same")
SPEC = Spec("id", "label", FEATS)


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(3).normal(size=(240, 2))
    y = np.where(x[:, 0] * x[:, 1] > 0, "N", "P")  # no single cut helps
    rows = [(f"r{i}", str(y[i]), float(x[i, 0]), float(x[i, 1]), 7.0) for i in range(len(x))]
    return spark.createDataFrame(rows, "id string, label string, a double, b double, same double").cache(), x, y


def nodes(m):
    """Per tree its (depth-first) splits."""
    return [t.toDebugString.split("\n", 1)[1] for t in m.model.stages[-1].trees]


@pytest.fixture(scope="module")
def fitted(points):
    return M.fit_model(points[0], SPEC, "ExtraTreesGini")


def test_thresholds_are_drawn_between_a_nodes_values(fitted, points):
    _, x, _ = points
    roots = []
    for t in fitted.model.stages[-1].trees:
        split = t._call_java("rootNode").split()
        f, cut = split.featureIndex(), split.threshold()
        assert f in (0, 1) and x[:, f].min() <= cut < x[:, f].max()  # a constant feature is not drawn
        roots.append((f, cut))
    # neither the bounds of 32 bins nor half-way points: nearly every tree has a cut of its own
    assert len(set(roots)) > 95
    # m = 2 of the 2 features that vary: each feature's root cuts spread over most of its range
    cuts = np.array([cut for _, cut in roots])
    assert cuts.std() > 0.3


def test_fits_what_no_single_cut_tells(fitted, points):
    df, _, _ = points
    assert M.accuracy(fitted, df, SPEC) > 0.97


def test_same_trees_whatever_the_partitions_and_groups(fitted, points, monkeypatch):
    df, _, _ = points
    monkeypatch.setattr(X, "MOST_BYTES", 8 * 6 * 64)
    monkeypatch.setattr(X, "BLOCK", 64)
    monkeypatch.setattr(X, "LOOK", 50)
    assert nodes(M.fit_model(df.repartition(7), SPEC, "ExtraTreesGini")) == nodes(fitted)


def test_leaves_hold_the_rows_that_reach_them(points):
    df, x, y = points
    data = df.selectExpr("a x0", "b x1", "CAST(label = 'P' AS double) y", "1.0D w")
    levels = X.grow(data, 2, 2, "entropy", 3, 4, 2, 9)
    feat = {(t, n): (f, v) for lv in levels for t, n, f, v in zip(lv["tree"], lv["node"], lv["feature"], lv["cut"])}
    want = {}
    for t in range(3):
        for row, label in zip(x, y):
            n = 1
            while True:
                want.setdefault((t, n), np.zeros(2))[int(label == "P")] += 1
                f, v = feat[t, n]
                if f < 0:
                    break
                n = 2 * n + int(row[f] > v)
    got = {(t, n): cnt for lv in levels for t, n, cnt in zip(lv["tree"], lv["node"], lv["counts"])}
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in got)
    assert max(n for _, n in got) < 32  # depth 4


def test_weights_and_saving(spark, points, tmp_path):
    df, _, _ = points
    heavy = df.withColumn("__w", (df.label == "P").cast("double") * 0.999 + 0.001)
    m = M.fit_model(heavy, SPEC, "ExtraTreesEntr", weight_col="__w")
    root = m.model.stages[-1].trees[0]._call_java("rootNode")
    stats = list(root.impurityStats().stats())
    assert stats[1] > 100 * stats[0]
    M.save_model(m, str(tmp_path / "m"), spark)
    back = M.load_model(spark, str(tmp_path / "m"))
    key = lambda r: (r["id"], r["class"])
    assert sorted(M.predict_proba(m, df).collect(), key=key) == sorted(M.predict_proba(back, df).collect(), key=key)


def test_selection_ends_at_its_best_step(spark, monkeypatch):
    """Only one member is right on all rows: later steps cannot add to the first."""
    from tidewell.operators import ensemble as ENS
    from tidewell.plans import queries_models as Q
    val = spark.createDataFrame([(f"r{i}", "AB"[i % 2], float(i % 2)) for i in range(8)], "id string, label string, a double")
    sure = M.fit_model(val, Spec("id", "label", ("a",)), "LR", "sure")
    members = [sure, M.fit_model(val, Spec("id", "label", ("a",)), "RandomForestGini", "too")]
    assert ENS.greedy_weights(members, val, Spec("id", "label", ("a",)), 4, use_best=True) == {"sure": 1.0}
    seen = {}
    monkeypatch.setattr(Q, "emb_split", lambda *a: (val, val))
    monkeypatch.setattr(Q.TS, "fit_teacher", lambda *a, **k: seen.update(k) or (members, val))
    Q.q_teacher(spark, "").count()
    assert seen == {"use_best": True}


def test_weights_are_parts_of_the_steps_taken(spark, monkeypatch):
    """Two steps of one member and one of another (2/3, 1/3) when no later step does better."""
    from pyspark.sql import functions as F
    from tidewell.operators import ensemble as ENS
    rows = spark.createDataFrame([("r0", "A"), ("r1", "B"), ("r2", "B")], "id string, label string")
    p = {"x": {"r0": 0.9, "r1": 0.45, "r2": 0.7}, "y": {"r0": 0.2, "r1": 0.6, "r2": 0.1}}

    def vector(m, df, id_col="id", out="__pv"):
        own = F.create_map(*[v for k, q in p[m.name].items() for v in (F.lit(k), F.lit(q))])[F.col(id_col)]
        return df.withColumn(out, F.array(own, 1 - own))
    monkeypatch.setattr(ENS.M, "proba_vector", vector)
    models = [M.Trained(n, "LR", ["A", "B"], []) for n in p]
    spec = Spec("id", "label", ())
    # x: r0, r1; x + x, x + y: r0, r1 or r0, r2; x + y + ...: scores tell where it ends
    every, best = ENS.greedy_weights(models, rows, spec, 6), ENS.greedy_weights(models, rows, spec, 6, use_best=True)

    def score(w):
        said = {r: sum(w.get(n, 0) * p[n][r] for n in p) for r in ("r0", "r1", "r2")}
        return sum((said[r] >= 0.5) == (r == "r0") for r in said)
    assert score(best) >= score(every) and sum(best.values()) == pytest.approx(1)
    assert all((w * 6) % 1 == 0 for w in every.values())
