"""Oversampling settings and categorical columns through ``prepare``; row picking; importance selection."""
import pytest
from pyspark.sql import functions as F

from tidewell.operators import edit, importance
from tidewell.plans.prepare import PrepConfig, prepare
from tidewell.spec import Spec


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(f"r{i}", "A" if i % 4 else "B", float(i % 17), float(i % 5) if i % 11 else None, "xyz"[i % 3], "uv"[i % 2]) for i in range(80)]
    return spark.createDataFrame(rows, "id string, label string, a double, b double, c string, d string")


def test_smotenc_and_smoten_through_prepare(cells):
    cfg = PrepConfig(oversample="smotenc", scaler="standard", oversample_kw={"categorical": ["c"], "k_neighbors": 2})
    train = prepare(cells.drop("d"), None, Spec("id", "label"), cfg)["train"]
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    assert counts["A"] == counts["B"] and {r[0] for r in train.select("c").distinct().collect()} == {"x", "y", "z"}
    assert train.where("a is null or b is null").count() == 0
    cfg = PrepConfig(oversample="smoten", oversample_kw={"categorical": ["c", "d"]})
    train = prepare(cells.select("id", "label", "c", "d"), None, Spec("id", "label", ()), cfg)["train"]
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    assert counts["A"] == counts["B"]
    with pytest.raises(ValueError):
        prepare(cells, None, Spec("id", "label"), PrepConfig(oversample="smoten"))


def test_select_rows_by_list_and_table(cells):
    picked = edit.select_rows(cells, ["r3", "r5", "r5", "none"], ["a"])
    assert sorted(tuple(r) for r in picked.collect()) == [("r3", 3.0), ("r5", 5.0)]
    assert edit.select_rows(cells, cells.where("label = 'B'").select("id")).count() == 20


def test_no_feature_passes_gives_an_empty_board(cells, spark):
    imp = spark.createDataFrame([("a", 0.001), ("b", 0.0)], "feature string, importance double")
    board = importance.fit_per_model_subset(cells, cells, Spec("id", "label", ("a", "b")), {"RandomForestGini": imp}, 0.005)
    assert board.count() == 0 and "score_test" in board.columns
