"""Cells behind the plane between two pivots are ruled out; the neighbours are those of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import cells, knn

FEATS = [f"f{i}" for i in range(8)]


@pytest.fixture(scope="module")
def twins(spark):
    x = np.random.default_rng(5).normal(size=(1500, 8))
    rows = [(f"{t}{i}", *map(float, r)) for t in "ab" for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ["id", *FEATS]).repartition(4).cache(), np.repeat(x[None], 2, 0).reshape(-1, 8)


def test_planes_rule_cells_out(twins):
    rows, _ = twins
    n = rows.count()
    kern = knn._kernel(FEATS, 1, True, False, [])
    made, pairs = cells.pruned_join(rows, rows, 1, FEATS, FEATS, dict.fromkeys(FEATS, n), kern,
                                    "probe_id string, base_id string, dist double", id_col="id", partition_cols=[],
                                    exclude_self=True, donors=False, passthrough=[], probe_block=64, base_block=64, n_base=n)
    # a row's twin lies in its own cell: of the others' rows hardly any can matter
    assert pairs["second"] < 0.05 * n * n
    got = {r["probe_id"]: (r["base_id"], r["dist"]) for r in knn._nearest(made, 1, False).collect()}
    assert got == {f"{t}{i}": (f"{o}{i}", 0.0) for t, o in ("ab", "ba") for i in range(1500)}


def test_same_neighbours_as_all_pairs(spark, twins):
    rows, x = twins
    base = rows.where(F.col("id").startswith("a"))
    rng = np.random.default_rng(6)
    far = np.concatenate([rng.normal(size=(200, 8)) * 2, [[1e160] + [0.0] * 7], [[1e-200] * 8]])
    probes = spark.createDataFrame([(f"p{i}", *map(float, r)) for i, r in enumerate(far)], ["id", *FEATS])
    got = knn.knn_join(probes, base, 5, FEATS, probe_block=32, base_block=64).collect()
    found = {(r["probe_id"], r["nn_rank"]): r["base_id"] for r in got}
    for i, p in enumerate(far):
        with np.errstate(over="ignore"):
            d = np.sqrt(((x[:1500] - p) ** 2).sum(1))
        want = sorted((v, f"a{j}") for j, v in enumerate(d.tolist()) if np.isfinite(v))[:5]
        for k, (_, b) in enumerate(want, start=1):
            assert found[f"p{i}", k] == b
        assert not want or len([1 for q in found if q[0] == f"p{i}"]) == len(want)


def test_bounds_stay_below_distances():
    rng = np.random.default_rng(7)
    pivots, y, p = rng.normal(size=(40, 3)), rng.normal(size=(3000, 3)), rng.normal(size=(50, 3)) * 2
    d, cell = cells._to_pivots(p, pivots), cells._to_pivots(y, pivots).argmin(1)
    apart = cells._to_pivots(pivots, pivots)
    for i in range(len(pivots)):
        own = y[cell == i]
        if not len(own):
            continue
        least = cells._to_pivots(p, own).min(1)
        hi = np.array([cells._to_pivots(own, pivots[i:i + 1]).max()])
        for j in range(len(pivots)):
            bound = cells._planes(d[:, [i]], hi, d[:, j], np.full((len(p), 1), apart[j, i]))[:, 0]
            assert (bound <= least).all()
