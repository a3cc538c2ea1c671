"""Runs: save / load (S5), run info (S6), run names and partition values (S7),
model bookkeeping (M21) and the fit summary (E11)."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import models as M
from tidewell.sources.tables import write_table


def run_name(method: str, preset: str, modality: str, taxonomy: str, subset: str,
             prep: dict | None = None, when: datetime | None = None) -> str:
    """``<method>-<preset>-<modality>-<taxonomy>-<subset>[-<prep codes>]-<yyyyMMdd-HHmmss>``."""
    when = when or datetime.now(timezone.utc)
    codes = "".join(str(v)[:1].upper() for v in (prep or {}).values() if v)
    parts = [method, preset, modality, taxonomy, subset] + ([codes] if codes else []) + [when.strftime("%Y%m%d-%H%M%S")]
    return "-".join(parts)


def leaderboard_name(modality: str, subset: str, preset: str, cv: tuple[int, int] | None = None) -> str:
    """``{modality}-{subset}-{preset}[-cvFR]``."""
    base = f"{modality}-{subset}-{preset}"
    return base + (f"-cv{cv[0]}{cv[1]}" if cv else "")


def run_info(spark: SparkSession, subset: str, modality: str, taxonomy: str, preset: str,
             train: DataFrame, test: DataFrame, label_col: str = "label") -> DataFrame:
    """One row describing a run: settings, shapes and label sets."""
    tr = train.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(label_col)).alias("labels")).collect()[0]
    te = test.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(label_col)).alias("labels")).collect()[0]
    row = (subset, modality, taxonomy, preset, int(tr["n"]), len(train.columns), int(te["n"]), len(test.columns),
           list(tr["labels"]), list(te["labels"]))
    return spark.createDataFrame([row], "subset string, modality string, taxonomy string, preset string, "
                                        "train_rows bigint, train_cols int, test_rows bigint, test_cols int, "
                                        "train_labels array<string>, test_labels array<string>")


def save_run(run_dir: str, config: dict, models: list[M.Trained], train: DataFrame, test: DataFrame,
             board: DataFrame | None = None) -> None:
    """Config (JSON), fitted models of every kind, train and test tables and the leaderboard under one path.
    Everything is written by Spark, so the path can be any shared file system."""
    spark = train.sparkSession
    meta = dict(config)
    meta["models"] = [{"name": m.name, "family": m.family, "classes": m.classes, "features": m.features,
                       "fit_time": m.fit_time, "stack_level": m.stack_level} for m in models]
    spark.createDataFrame([(json.dumps(meta),)], "config string").coalesce(1).write.mode("overwrite").text(
        f"{run_dir}/config")
    for m in models:
        M.save_model(m, f"{run_dir}/models/{m.name}", spark)
    write_table(train, f"{run_dir}/train")
    write_table(test, f"{run_dir}/test")
    if board is not None:
        write_table(board, f"{run_dir}/leaderboard")


def load_run(spark: SparkSession, run_dir: str) -> dict:
    """Config, train, test, leaderboard and the saved models (by name)."""
    from tidewell.sources.tables import exists
    cfg = json.loads(spark.read.text(f"{run_dir}/config").collect()[0][0])
    out = {"config": cfg, "train": spark.read.parquet(f"{run_dir}/train"),
           "test": spark.read.parquet(f"{run_dir}/test"), "models": {}}
    if exists(spark, f"{run_dir}/leaderboard"):
        out["leaderboard"] = spark.read.parquet(f"{run_dir}/leaderboard")
    for m in cfg.get("models", []):
        p = f"{run_dir}/models/{m['name']}"
        if exists(spark, p):
            out["models"][m["name"]] = M.load_model(spark, p)
    return out


# ----------------------------------------------------------------- M21 / E11


def model_names(models: list[M.Trained]) -> list[str]:
    return [m.name for m in models]


def set_best(board: DataFrame, name: str) -> DataFrame:
    """Mark one model as best (``is_best``)."""
    return board.withColumn("is_best", F.col("model") == F.lit(name))


def keep_best(models: list[M.Trained], name: str) -> list[M.Trained]:
    """Drop every model but the named one (and the members it needs)."""
    keep = [m for m in models if m.name == name]
    for m in keep:
        keep += [s for s, _ in m.extra.get("members", [])]
    return keep


def fit_summary(models: list[M.Trained], board: DataFrame, problem_type: str) -> DataFrame:
    """Problem type, feature count, best model and its scores as one row."""
    best = board.orderBy(F.col("score_val").desc_nulls_last(), F.col("score_test").desc_nulls_last()).limit(1)
    return best.select(F.lit(problem_type).alias("problem_type"),
                       F.lit(len(models[0].features) if models else 0).alias("n_features"),
                       F.col("model").alias("best_model"), "score_val", "score_test")
