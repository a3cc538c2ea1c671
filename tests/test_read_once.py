"""Costly inputs that several later steps read are computed once."""
import numpy as np
from pyspark.sql import functions as F

import tidewell.session as session
from tidewell.operators import distill as D
from tidewell.operators import models as M
from tidewell.operators import stats as G
from tidewell.plans.prepare import PrepConfig, prepare
from tidewell.spec import Spec

SPEC = Spec("id", "label", ("a", "b"))


def plan(df):
    return df._jdf.queryExecution().toString()


def labelled(spark, n=60):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(f"r{i}", "A" if i % 2 else "B", float(x + i % 2), float(y))
                                  for i, (x, y) in enumerate(rng.normal(size=(n, 2)))], "id string, label string, a double, b double")


def test_soft_and_hard_students_share_one_scored_pool(spark, monkeypatch):
    train = labelled(spark)
    teacher = M.fit_model(train, SPEC, "LR")
    cut, searches = session.cut_lineage, []

    def counted(df):
        searches.append("CoGroups" in plan(df))
        return cut(df)
    monkeypatch.setattr(session, "cut_lineage", counted)
    students = D.distill(teacher, train, SPEC, ["LR", "NeuralNetTorch"], mode="soft", augment="munge")
    assert sum(searches) == 1
    assert [s.name for s in students] == ["LR_DSTL", "NeuralNetTorch_DSTL"]


def test_prepare_reads_its_inputs_once(spark, monkeypatch):
    rows = labelled(spark)
    side = rows.select("id", (F.col("a") * 2).alias("c"))
    seen, whole = [], G.filter_min_class
    monkeypatch.setattr(G, "filter_min_class", lambda df, *a: (seen.append(plan(df)), whole(df, *a))[1])
    joined = rows.hint("merge").join(side, "id")
    out = prepare(joined, joined.limit(5), Spec("id", "label"), PrepConfig(scaler="standard"))
    assert "Join" not in seen[0]
    assert out["train"].count() == 48 and out["unlabelled"].count() == 5
