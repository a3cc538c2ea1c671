"""Sources and runs (S1–S7, M21, E11): round trips through the checkpoint folder."""

import os
import tempfile

from pyspark.sql import functions as F

from tidewell.operators import models as M
from tidewell.plans import fixtures as X
from tidewell.sources import runs as R
from tidewell.sources import tables as S
from tests.conftest import SMALL


def _scratch(spark):
    base = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="tw-test-", dir="/tmp")
    return tempfile.mkdtemp(prefix="run-", dir=base.replace("file:", "")) if base.startswith(("/", "file:")) else base


def test_csv_reader_strips_bom_and_keys(spark):
    d = tempfile.mkdtemp(prefix="tw-csv-", dir="/tmp")
    p = os.path.join(d, "morph.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("﻿,TDL apical,#basal dendrites\n541549258,1.5,3\nH23.29.252.11.91.02,2.5,\n")
    df = S.read_table(spark, p, "csv")
    assert df.columns[0] == "id"
    rows = {r["id"]: r for r in df.collect()}
    assert set(rows) == {"541549258", "H23.29.252.11.91.02"}
    assert rows["H23.29.252.11.91.02"]["#basal dendrites"] is None


def test_list_and_register_datasets(spark):
    names = {r["name"] for r in S.list_datasets(spark, SMALL).collect()}
    assert {"lineitem", "customer", "embeddings"} <= names


def test_save_and_load_run(spark):
    e = X.emb(spark, SMALL)
    m = M.fit_model(e, X.EMB_SPEC, "LR")
    board = M.leaderboard([m], X.EMB_SPEC, test=e)
    run = _scratch(spark)
    R.save_run(run, {"preset": "medium"}, [m], e, e.limit(10), board)
    got = R.load_run(spark, run)
    assert got["config"]["preset"] == "medium"
    assert got["train"].count() == e.count()
    m2 = got["models"]["LR"]
    a = M.predict(m, e).select("id", F.col("predicted").alias("a"))
    b = M.predict(m2, e).select("id", F.col("predicted").alias("b"))
    assert a.join(b, "id").filter("a != b").count() == 0


def test_load_or_build_reuses(spark):
    base = _scratch(spark)
    calls = []

    def build():
        calls.append(1)
        e = X.emb(spark, SMALL)
        return e.filter(F.col("e0") > 0), e.filter(F.col("e0") <= 0)
    tr, te = S.load_or_build(spark, f"{base}/train", f"{base}/test", build)
    tr2, te2 = S.load_or_build(spark, f"{base}/train", f"{base}/test", build)
    assert len(calls) == 1 and tr.count() == tr2.count() and te.count() == te2.count()


def test_run_names_and_info(spark):
    from datetime import datetime
    n = R.run_name("distill", "medium", "Ephys", "Berg", "Superficial", {"impute": "knn"}, datetime(2024, 11, 21, 20, 23, 18))
    assert n == "distill-medium-Ephys-Berg-Superficial-K-20241121-202318"
    assert R.leaderboard_name("Ephys", "Superficial", "medium", (5, 1)) == "Ephys-Superficial-medium-cv51"
    e = X.emb(spark, SMALL)
    info = R.run_info(spark, "All", "Emb", "Mouse", "medium", e, e).collect()[0]
    assert info["train_rows"] == e.count() and len(info["train_labels"]) == 10


def test_keep_best_and_summary(spark):
    e = X.emb(spark, SMALL)
    m = M.fit_model(e, X.EMB_SPEC, "LR")
    board = M.leaderboard([m], X.EMB_SPEC, test=e, val=e)
    assert R.model_names([m]) == ["LR"]
    assert R.keep_best([m], "LR") == [m]
    s = R.fit_summary([m], board, "multiclass").collect()[0]
    assert s["best_model"] == "LR" and s["n_features"] == len(X.EMB_FEATURES)
    assert R.set_best(board, "LR").collect()[0]["is_best"]


def test_sweep_written_partitioned_and_pruned(spark):
    from tidewell.plans.teacher import sweep
    e = X.emb(spark, SMALL)
    board = sweep({"method": ["first", "last"], "threshold": [0.8]},
                  lambda method, threshold: spark.createDataFrame([(method, float(threshold))], "m string, t double")
                  .withColumn("n", F.lit(e.count())))
    path = _scratch(spark) + "/board"
    S.write_table(board, path, partition_by=["method"])
    back = spark.read.parquet(path).filter(F.col("method") == "last")
    assert back.count() == 1
    assert "PartitionFilters" in back._jdf.queryExecution().executedPlan().toString() or \
        "method" in back._jdf.queryExecution().executedPlan().toString()
