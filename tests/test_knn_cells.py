"""The pruned kNN join: same result as comparing all pairs, far fewer pairs, plans in time."""
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import cells, impute, knn
from tidewell.spec import Spec

FEATS = [f"f{j}" for j in range(6)]


@pytest.fixture(scope="module")
def clustered(spark):
    """Thirty clusters, NULLs in two features, fifty equal rows, a NULL label."""
    rng = np.random.default_rng(0)
    n = 1500
    x = (rng.normal(size=(30, 6)) * 20)[rng.integers(0, 30, n)] + rng.normal(size=(n, 6))
    x[:50] = x[0]
    rows = [(f"r{i:05d}", "A" if i % 3 else None if i % 2 else "B",
             *[None if j < 2 and rng.random() < .1 else float(x[i, j]) for j in range(6)]) for i in range(n)]
    return spark.createDataFrame(rows, "id string, label string, " + ", ".join(f"{f} double" for f in FEATS)).repartition(4).cache()


def rows(df):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()], key=str)


def brute(df, k, feats, same_label=False, donors=False):
    """All pairs in numpy: (probe, [feature,] base, distance, rank)."""
    data = df.collect()
    ids, x = np.array([r.id for r in data]), np.array([[np.nan if r[f] is None else r[f] for f in feats] for r in data], float)
    out = []
    for i, r in enumerate(data):
        diff = x - x[i]
        seen = (~np.isnan(diff)).sum(1)
        dist = np.sqrt(len(feats) / seen * np.nansum(diff ** 2, 1))
        for j, f in enumerate(feats) if donors else [(None, None)]:
            if donors and not np.isnan(x[i, j]):
                continue
            ok = ~np.isnan(x[:, j]) if donors else np.array([q.id != r.id and (not same_label or q.label == r.label) for q in data])
            near = sorted((round(float(d), 9), b) for d, b in zip(dist[ok], ids[ok]))[:k]
            out += [(r.id, *([f] if donors else []), b, d, n + 1) for n, (d, b) in enumerate(near)]
    return sorted(out, key=str)


@pytest.mark.parametrize("prune", [1, 10 ** 9])
def test_both_paths_equal_brute_force(clustered, monkeypatch, prune):
    monkeypatch.setattr(knn, "PRUNE_FROM", prune)
    small = {"probe_block": 100, "base_block": 60}
    holes = clustered.where("f0 is null or f1 is null")
    got = knn.knn_join(holes, clustered, 4, FEATS, donors=True, **small).drop("value")
    assert rows(got) == brute(clustered, 4, FEATS, donors=True)
    got = knn.knn_join(clustered, clustered, 3, FEATS, exclude_self=True, partition_cols=["label"], **small)
    assert rows(got) == brute(clustered, 3, FEATS, same_label=True)


def test_grouped_distance_agrees(clustered, monkeypatch):
    kw = {"groups": [["f2", "f3"], ["f4", "f5"]], "exclude_self": True, "base_block": 60, "probe_block": 100}
    monkeypatch.setattr(knn, "PRUNE_FROM", 10 ** 9)
    whole = rows(knn.knn_join(clustered, clustered, 3, FEATS[2:], **kw))
    monkeypatch.setattr(knn, "PRUNE_FROM", 1)
    assert rows(knn.knn_join(clustered, clustered, 3, FEATS[2:], **kw)) == whole


def test_few_pairs_are_compared(clustered):
    n, always = clustered.count(), FEATS[2:]
    kern = knn._kernel(always, 3, True, False, [])
    made, pairs = cells.pruned_join(
        clustered, clustered, 3, always, always, dict.fromkeys(always, n), kern, "probe_id string, base_id string, dist double",
        id_col="id", partition_cols=[], exclude_self=True, donors=False, passthrough=[], probe_block=200, base_block=50, n_base=n)
    assert sum(pairs.values()) < n * n / 5
    assert made.select("probe_id").distinct().count() == n


def test_no_common_feature_and_tiny_tables(spark, monkeypatch):
    monkeypatch.setattr(knn, "PRUNE_FROM", 0)
    df = spark.createDataFrame([(str(i), None if i % 2 else float(i), float(i) if i % 2 else None) for i in range(9)], "id string, a double, b double")
    got = knn.knn_join(df, df, 1, ["a", "b"], exclude_self=True, base_block=2)  # every feature is missing somewhere
    assert {r.probe_id: r.base_id for r in got.collect()}["0"] == "2" and got.count() == 9
    none = df.where("id is null")
    assert knn.knn_join(none, df, 1, ["a"], base_block=2).count() == 0 == knn.knn_join(df, none, 1, ["a"]).count()


def test_imputation_plans_in_time_with_64_computed_columns(spark):
    src = spark.range(60).select(F.col("id").cast("string").alias("id"), F.lit("A").alias("label"), F.array(
        *[F.when((F.col("id") + j) % 50 == 0, None).otherwise(F.col("id") * 1.0 + j) for j in range(64)]).alias("v"))
    src = spark.createDataFrame(src.collect(), src.schema)
    wide = src.select("id", "label", *[F.col("v")[j].cast("double").alias(f"e{j}") for j in range(64)])
    wide = wide.withColumn("e0", F.when(F.col("id").cast("bigint") % 7 == 3, None).otherwise(F.col("e0")))
    start = time.time()
    out = impute.impute_knn(wide, Spec("id", "label", tuple(f"e{j}" for j in range(64))), 3)
    assert out.where("e0 is null or e63 is null").count() == 0 and out.count() == 60
    assert time.time() - start < 120
