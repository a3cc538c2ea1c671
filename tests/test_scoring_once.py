"""Models score a row once, whatever the number of classes (no model inside a lambda)."""

from tidewell.operators import importance as IMP
from tidewell.operators import models as M
from tidewell.spec import Spec

SPEC = Spec("id", "label", ("a", "b"))


def rows(spark, n=60):
    return spark.createDataFrame([(f"r{i}", "ABC"[i % 3], float(i % 3) + i / 100, float(i % 7)) for i in range(n)],
                                 "id string, label string, a double, b double")


def lambdas_with_models(df):
    text = df._jdf.queryExecution().optimizedPlan().toString()
    found = []
    for part in text.split("lambdafunction(")[1:]:
        depth, end = 1, 0
        while depth and end < len(part):
            depth += {"(": 1, ")": -1}.get(part[end], 0)
            end += 1
        found += [part[:end]] if "UDF" in part[:end] else []
    return found


def test_no_model_is_scored_inside_a_lambda(spark):
    df = rows(spark)
    lr, forest = M.fit_model(df, SPEC, "LR"), M.fit_model(df, SPEC, "RandomForestGini")
    both = M.Trained("W", "WeightedEnsemble", lr.classes, lr.features, None, extra={"members": [(lr, 0.75), (forest, 0.25)]})
    for m in (lr, forest, both):
        assert not lambdas_with_models(M.proba_vector(m, df).select("id", "__pv"))
    one = {r["id"]: r for r in M.proba_vector(both, M.proba_vector(forest, M.proba_vector(lr, df, out="p"), out="q")).collect()}
    for r in one.values():
        assert all(abs(x - (0.75 * p + 0.25 * q)) < 1e-12 for x, p, q in zip(r["__pv"], r["p"], r["q"])) and len(r["__pv"]) == 3


def test_class_without_train_rows_scores_zero(spark):
    m = M.fit_model(rows(spark), SPEC, "LR", classes=["A", "B", "C", "D", "E"])
    assert all(len(r["__pv"]) == 5 and r["__pv"][3:] == [0.0, 0.0] for r in M.proba_vector(m, rows(spark, 4)).collect())


def test_permuted_rows_are_spread_before_they_multiply(spark):
    df = rows(spark)
    m = M.fit_model(df, SPEC, "LR")
    scores = IMP.permuted_scores(m, df, SPEC, None, 2)
    assert "RepartitionByExpression" in scores._jdf.queryExecution().optimizedPlan().toString()
    assert scores.count() == 4
