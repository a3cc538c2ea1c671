"""The kNN kernel: same rows as comparing term by term, in a fraction of its time; searches run once."""
import time

import numpy as np
import pandas as pd
import pytest

from tidewell.operators import knn, sample
from tidewell.spec import Spec


def table(rng, n, d, id_col, holes=0, digits=None):
    x = rng.normal(size=(n, d)) * 10 ** rng.uniform(-3, 6, d) + 1e5
    if digits is not None:
        x = np.round(rng.normal(size=(n, d)) * 2, digits)
    for j in range(holes):
        x[rng.random(n) < .3, j] = np.nan
    out = pd.DataFrame(x, columns=[f"f{i}" for i in range(d)])
    out[id_col] = [f"r{i % (n - 5)}" for i in rng.permutation(n)]  # five ids come twice
    return out


def term_by_term(left, right, feats, k, exclude_self, donors):
    right = right.sort_values("__bid", kind="stable").reset_index(drop=True)
    P, B = left[feats].to_numpy(), right[feats].to_numpy()
    pid, bid = left["__pid"].to_numpy(), right["__bid"].to_numpy()
    D = knn._pairwise(P, B)
    if exclude_self:
        D[pid[:, None] == bid[None, :]] = np.nan
    out = []
    for j, f in enumerate(feats) if donors else [(None, None)]:
        for i in range(len(P)):
            if donors and not np.isnan(P[i, j]):
                continue
            ok = np.flatnonzero(~np.isnan(D[i]) & (~np.isnan(B[:, j]) if donors else True))
            for q in ok[np.argsort(D[i, ok], kind="stable")][:k]:
                out.append((pid[i], *([f] if donors else []), bid[q], D[i, q], *([B[q, j]] if donors else [])))
    return sorted(out)


@pytest.mark.parametrize("d,holes,digits,donors,exclude", [
    (64, 0, None, False, True), (64, 3, None, True, False), (2, 0, 0, False, True), (3, 3, 0, False, False),
    (4, 4, 0, True, False), (1, 1, 0, False, True)])
@pytest.mark.parametrize("k", [1, 10])
def test_kernel_equals_term_by_term(monkeypatch, d, holes, digits, donors, exclude, k):
    monkeypatch.setattr(knn, "SCREEN_CELLS", 30_000)
    rng = np.random.default_rng(d + holes)
    left, right = table(rng, 150, d, "__pid", holes, digits), table(rng, 700, d, "__bid", holes, digits)
    feats = [f"f{i}" for i in range(d)]
    got = knn._kernel(feats, k, exclude, donors, [])(left, right)
    assert sorted(got.itertuples(index=False, name=None)) == term_by_term(left, right, feats, k, exclude, donors)


def test_values_beyond_the_screen():
    left = pd.DataFrame({"f0": [1e200, 0.0], "__pid": ["a", "b"]})
    right = pd.DataFrame({"f0": [np.inf, 1e200, 1.0], "__bid": ["x", "y", "z"]})
    got = knn._kernel(["f0"], 2, False, False, [])(left, right)
    assert list(got.itertuples(index=False, name=None)) == [("a", "y", 0.0), ("b", "z", 1.0)]


def test_kernel_takes_a_fraction_of_the_time():
    rng = np.random.default_rng(0)
    left, right = table(rng, 1024, 64, "__pid"), table(rng, 4096, 64, "__bid")
    feats = [f"f{i}" for i in range(64)]
    t = time.process_time()
    knn._pairwise(left[feats].to_numpy()[:128], right[feats].to_numpy())
    plain = 8 * (time.process_time() - t)
    run = knn._kernel(feats, 10, True, False, [])
    took = []
    for _ in range(3):
        t = time.process_time()
        run(left, right)
        took.append(time.process_time() - t)
    assert min(took) < plain / 2  # threads of the matrix product count too


def test_blocks_grow_with_the_rows():
    """Copies of a row that are sent: eight at most until blocks fill a task's memory, not one per 2,048 rows."""
    feats = [f"f{i}" for i in range(64)]
    for n in (30_000, 200_000):
        assert knn._blocks(n, knn._side(n, 2048, feats)) <= 8
    assert knn._side(10 ** 9, 2048, feats) * 64 * 8 <= knn.MOST_BYTES


def test_other_class_share_is_searched_once(spark):
    """Sums, ranks and joins read the counts; the search must not run for each of them."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(f"r{i}", "A" if i % 4 else "B", *map(float, rng.normal(size=3))) for i in range(60)],
                               "id string, label string, a double, b double, c double")
    share = sample._other_class_share(df, df.filter("label = 'B'"), Spec("id", "label", ("a", "b", "c")), 5)
    assert "CoGroups" not in share._jdf.queryExecution().toString()
    assert share.count() == 15 and {r.n_nn for r in share.collect()} == {5}
