"""Models are fit on no more partitions than pay: forests send a table of all open nodes from each."""

import pytest
from pyspark.ml import Pipeline

from tidewell.operators import distill as D
from tidewell.operators import models as M
from tidewell.spec import Spec

SPEC = Spec("id", "label", ("a", "b"))


@pytest.fixture()
def parts(spark, monkeypatch):
    """Partitions of the tables that pipelines were fit on."""
    seen, fit = [], Pipeline.fit

    def noted(self, data, *more):
        seen.append(data.rdd.getNumPartitions())
        return fit(self, data, *more)
    monkeypatch.setattr(Pipeline, "fit", noted)
    return seen


def rows(spark, parts):
    return spark.createDataFrame([(f"r{i}", "AB"[i % 2], float(i % 2) + i / 100, float(i % 7)) for i in range(90)],
                                 "id string, label string, a double, b double").repartition(parts)


def test_forest_takes_many_partitions_together(spark, parts):
    cores = spark.sparkContext.defaultParallelism
    m = M.fit_model(rows(spark, 3 * cores), SPEC, "RandomForestGini")
    M.fit_model(rows(spark, 2), SPEC, "RandomForestGini")
    assert parts == [cores, 2]
    assert M.accuracy(m, rows(spark, 3), SPEC) > 0.9


def test_students_take_many_partitions_together(spark, parts):
    cores = spark.sparkContext.defaultParallelism
    teacher = M.fit_model(rows(spark, 2), SPEC, "LR")
    D.distill(teacher, rows(spark, 3 * cores), SPEC, ["LR", "RandomForestEntr"])
    assert parts == [2, cores, cores]
