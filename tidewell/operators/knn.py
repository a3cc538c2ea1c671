"""Exact k-nearest-neighbour join (the kernel of I1, O2–O8, M12 and the kNN model).

Small bases (up to ``PRUNE_FROM`` blocks) and bases of many features (``PRUNE_FEATURES``): probe
rows are hashed into chunks and base rows into blocks, both sized from counts, and every chunk
meets every block of its partition (``partition_cols``, e.g. the class).  Larger bases of few
features go through ``cells``: a probe visits only the blocks that a triangle-inequality bound
cannot rule out, with the same result.  Either way ``cogroup`` meets a chunk and a block in one
task.  It takes squared distances from one matrix product over ``SCREEN_CELLS`` pairs at a time
and measures, term by term, those pairs that rounding errors leave in question; it emits only its
local top-k, so the merge per probe (a window over at most blocks·k rows) never sees all pairs.

Distance: NaN-aware Euclidean — over coordinates present on both sides,
sqrt(d / present · Σ (a-b)²); no common coordinate → no distance (the pair is
skipped).  Ties are broken by base id.  A base whose rows lack every feature somewhere
leaves no coordinate to bound by, and is compared as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import c
from tidewell.operators.cells import pruned_join

#: blocks of the base from which pruning pays for its extra passes
PRUNE_FROM = 4
#: features from which distances are too much alike for bounds to rule blocks out
PRUNE_FEATURES = 16
#: bytes of one side's features in a task, and pairs that a task compares at once
MOST_BYTES, SCREEN_CELLS = 16 << 20, 2 << 20
PC, BB = "__pc", "__bb"


def _pairwise(P: np.ndarray, B: np.ndarray) -> np.ndarray:
    """NaN-aware Euclidean distances (m × n); NaN where no coordinate is shared."""
    m, d = P.shape
    n = B.shape[0]
    acc = np.zeros((m, n))
    cnt = np.zeros((m, n))
    for j in range(d):
        diff = P[:, j][:, None] - B[:, j][None, :]
        ok = ~np.isnan(diff)
        acc += np.where(ok, diff * diff, 0.0)
        cnt += ok
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = np.sqrt((d / cnt) * acc)
    dist[cnt == 0] = np.nan
    return dist


def _pairwise_groups(P: np.ndarray, B: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """sqrt(Σ_g (Σ_{j∈g} |a_j − b_j|)²): an L1 distance inside each group of columns (one
    categorical feature embedded as its class-probability vector), L2 across groups."""
    out = np.zeros((P.shape[0], B.shape[0]))
    for g in groups:
        l1 = np.zeros_like(out)
        for j in g:
            l1 += np.abs(P[:, j][:, None] - B[:, j][None, :])
        out += l1 * l1
    return np.sqrt(out)


def _exact(P: np.ndarray, B: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The distances of :func:`_pairwise` for pairs of rows, term by term in the same order."""
    d = P.shape[1]
    acc, cnt = np.zeros(len(rows)), np.zeros(len(rows))
    for j in range(d):
        diff = P[rows, j] - B[cols, j]
        ok = ~np.isnan(diff)
        acc += np.where(ok, diff * diff, 0.0)
        cnt += ok
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = np.sqrt((d / cnt) * acc)
    dist[cnt == 0] = np.nan
    return dist


class _Screen:
    """Squared distances by one matrix product, and how far they may be off.

    Features that both sides have everywhere need no mask; the others are multiplied by
    the other side's mask of present cells, so a pair's sum runs over what both have."""

    def __init__(self, P: np.ndarray, B: np.ndarray):
        d = P.shape[1]
        gone_p, gone_b = np.isnan(P), np.isnan(B)
        h = np.flatnonzero(gone_p.any(0) | gone_b.any(0))
        whole = np.setdiff1d(np.arange(d), h)
        # distances do not change with the origin; rounding errors are smallest at the centre
        n = np.maximum((~gone_b).sum(0), 1)
        mid = np.where(gone_b, 0.0, B).sum(0) / n
        a, b = np.where(gone_p, 0.0, P - mid), np.where(gone_b, 0.0, B - mid)
        one = np.ones
        self.left = np.column_stack([-2 * a, a[:, h] ** 2, ~gone_p[:, h], (a[:, whole] ** 2).sum(1), one(len(a))])
        self.right = np.column_stack([b, ~gone_b[:, h], b[:, h] ** 2, one(len(b)), (b[:, whole] ** 2).sum(1)]).T.copy()
        self.some = (~gone_p[:, h]).astype(float), (~gone_b[:, h]).astype(float).T.copy()
        self.d, self.h, self.whole = d, len(h), len(whole)
        far = np.sqrt((a * a).sum(1)) + np.sqrt((b * b).sum(1).max())
        self.slack = 16 * (self.left.shape[1] + 8) * np.finfo(float).eps * far * far

    def __call__(self, part: slice) -> tuple[np.ndarray, np.ndarray]:
        near = self.left[part] @ self.right
        slack = self.slack[part]
        if self.h:
            cnt = self.some[0][part] @ self.some[1]
            cnt += self.whole
            with np.errstate(divide="ignore", invalid="ignore"):
                near *= self.d / cnt
            near[cnt < 0.5] = np.inf
            slack = slack * (self.d / max(1.0, float(cnt.min(initial=self.d))))
        return near, slack


def _limits(near: np.ndarray, k: int) -> np.ndarray:
    """Per row a value that at least k entries (or all) do not exceed: the k-th smallest of the
    least entries of at least k disjoint sets of columns."""
    m, n = near.shape
    if n <= k:
        return np.full(m, np.inf)
    sets = n // 16
    if sets >= 4 * k:
        head = near[:, :sets * 16].reshape(m, 16, sets)
        near = head.min(axis=1)
    return np.partition(near, k - 1, axis=1)[:, k - 1]


def _few_alike(B: np.ndarray, bid: np.ndarray, k: int) -> np.ndarray:
    """Of base rows (sorted by id) with equal features, only the first can be among the nearest:
    as many as k and the rows that share one id."""
    n = len(B)
    if n <= 4 * k:
        return np.arange(n)
    times = int(np.unique(bid.astype(str), return_counts=True)[1].max())
    whole = np.ascontiguousarray(np.where(np.isnan(B), np.nan, B)).view(np.dtype((np.void, B.shape[1] * 8))).ravel()
    _, kind = np.unique(whole, return_inverse=True)
    order = np.argsort(kind, kind="stable")
    first = np.r_[True, kind[order][1:] != kind[order][:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    return np.sort(order[np.arange(n) - start < k + times])


def _own_pairs(pid: np.ndarray, bid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (probe, base row) of one id."""
    code = pd.factorize(np.concatenate([pid, bid]))[0]
    p, b = code[:len(pid)], code[len(pid):]
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], p, "left"), np.searchsorted(b[order], p, "right")
    n = hi - lo
    rows = np.repeat(np.arange(len(p)), n)
    return rows, order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def _kernel(features: Sequence[str], k: int, exclude_self: bool, donors: bool, passthrough: Sequence[str],
            groups: list[list[int]] | None = None):
    feats = list(features)

    def nearest(near, slack, kk, exact):
        """(rows, columns, distances) of each row's kk nearest, ties by column."""
        if slack is None:  # ``near`` holds the distances themselves
            order = np.argsort(near, axis=1, kind="stable")[:, :kk]
            rows, cols = np.repeat(np.arange(len(near)), order.shape[1]), order.ravel()
            return rows, cols, near[rows, cols]
        # whoever may be among the nearest by the matrix product is measured term by term
        rows, cols = np.nonzero(near <= (_limits(near, kk) + 2 * slack)[:, None])
        dist = exact(rows, cols)
        dist = np.where(np.isnan(dist) | np.isinf(near[rows, cols]), np.inf, dist)
        order = np.lexsort((cols, dist, rows))
        rows, cols, dist = rows[order], cols[order], dist[order]
        first = np.searchsorted(rows, rows, "left")
        keep = np.arange(len(rows)) - first < kk
        return rows[keep], cols[keep], dist[keep]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _empty(donors, passthrough)
        right = right.sort_values("__bid", kind="stable").reset_index(drop=True)
        P = left[feats].to_numpy(dtype=float, na_value=np.nan)
        B = right[feats].to_numpy(dtype=float, na_value=np.nan)
        pid = left["__pid"].to_numpy()
        bid = right["__bid"].to_numpy()
        # values whose squares leave the range of doubles are compared term by term
        screen = None
        if feats and not groups and not any((np.abs(x) > 1e120).any() for x in (P, B)):
            keep = _few_alike(B, bid, k)
            if len(keep) < len(B):
                B, bid, right = B[keep], bid[keep], right.iloc[keep]
            screen = _Screen(P, B)
        own = _own_pairs(pid, bid) if exclude_self else None
        out = []
        step = max(1, SCREEN_CELLS // len(B))
        for at in range(0, len(P), step):
            part = slice(at, min(len(P), at + step))
            p = P[part]
            if screen is None:
                D, slack = _pairwise_groups(p, B, groups) if groups else _pairwise(p, B), None
                D = np.where(np.isnan(D), np.inf, D)
            else:
                D, slack = screen(part)
            if own is not None:
                a, b = np.searchsorted(own[0], [part.start, part.stop])
                D[own[0][a:b] - at, own[1][a:b]] = np.inf
            if not donors:
                rows, cols, dd = nearest(D, slack, min(k, len(B)), lambda r, q: _exact(p, B, r, q))
                ok = np.isfinite(dd)
                rows, cols = rows[ok] + at, cols[ok]
                res = pd.DataFrame({"probe_id": pid[rows], "base_id": bid[cols], "dist": dd[ok]})
                for name in passthrough:
                    res[name] = right[name].to_numpy()[cols]
                out.append(res)
                continue
            # donors: per missing feature of a probe, the k nearest base rows having that feature
            for j, name in enumerate(feats):
                need, have = np.flatnonzero(np.isnan(p[:, j])), np.flatnonzero(~np.isnan(B[:, j]))
                if not len(need) or not len(have):
                    continue
                rows, cols, dd = nearest(D[np.ix_(need, have)], None if slack is None else slack[need], min(k, len(have)),
                                         lambda r, q: _exact(p, B, need[r], have[q]))
                ok = np.isfinite(dd)
                rows, cols = need[rows[ok]] + at, have[cols[ok]]
                out.append(pd.DataFrame({"probe_id": pid[rows], "feature": name, "base_id": bid[cols],
                                         "dist": dd[ok], "value": B[cols, j]}))
        return pd.concat(out, ignore_index=True) if out else _empty(donors, passthrough)

    return run


def _empty(donors: bool, passthrough=()) -> pd.DataFrame:
    if donors:
        return pd.DataFrame({"probe_id": pd.Series(dtype=str), "feature": pd.Series(dtype=str),
                             "base_id": pd.Series(dtype=str), "dist": pd.Series(dtype=float),
                             "value": pd.Series(dtype=float)})
    d = {"probe_id": pd.Series(dtype=str), "base_id": pd.Series(dtype=str), "dist": pd.Series(dtype=float)}
    for p in passthrough:
        d[p] = pd.Series(dtype=object)
    return pd.DataFrame(d)


def _blocks(n: int, block: int) -> int:
    return max(1, math.ceil(n / block))


def knn_join(probe: DataFrame, base: DataFrame, k: int, features: Sequence[str], *,
             id_col: str = "id", partition_cols: Sequence[str] = (), exclude_self: bool = False,
             donors: bool = False, base_passthrough: Sequence[str] = (),
             probe_block: int = 1024, base_block: int = 2048,
             groups: list[list[str]] | None = None) -> DataFrame:
    """k nearest base rows per probe row (per partition value).

    ``groups`` switches to the grouped distance of :func:`_pairwise_groups`.
    Returns (probe_id, base_id, dist, nn_rank[, passthrough...]) — or with ``donors``,
    (probe_id, feature, base_id, dist, value, nn_rank): for each NULL feature of a
    probe, its k nearest base rows that have the feature.
    """
    feats = list(features)
    parts = list(partition_cols)
    if donors:
        schema = "probe_id string, feature string, base_id string, dist double, value double"
    else:
        pt = "".join(f", {p} {base.schema[p].dataType.simpleString()}" for p in base_passthrough)
        schema = "probe_id string, base_id string, dist double" + pt
    gidx = [[feats.index(x) for x in g] for g in groups] if groups else None
    kern = _kernel(feats, k, exclude_self, donors, base_passthrough, gidx)
    n_base, have = _present(base, feats)
    if n_base > PRUNE_FROM * base_block:
        n_probe, also = _present(probe, feats)
        always = [x for x in feats if have[x] == n_base and also[x] == n_probe]
        if always and len(always) < PRUNE_FEATURES:
            made, _ = pruned_join(probe, base, k, feats, always, have, kern, schema, id_col=id_col, partition_cols=parts,
                                  exclude_self=exclude_self, donors=donors, passthrough=base_passthrough,
                                  probe_block=probe_block, base_block=base_block, n_base=n_base)
            return _nearest(made, k, donors)
    else:
        n_probe = probe.count()
    # rows that meet: the largest combination of partition values decides
    if parts:
        n_probe, n_base = _largest(probe, parts), _largest(base, parts)
    npc, nb = _blocks(n_probe, _side(n_probe, probe_block, feats)), _blocks(n_base, _side(n_base, base_block, feats))

    def prep(df, own, other_n, tag):
        # fresh aliases: probe and base may come from one DataFrame (self join)
        x = df.select(*[c(p).alias(p) for p in parts], c(id_col).cast("string").alias(tag),
                      *[c(f).cast("double").alias(f) for f in feats],
                      *([c(p).alias(p) for p in base_passthrough] if tag == "__bid" else []))
        # both sides' numbers are INT: cogroup hashes a BIGINT differently and would lose pairs
        x = x.withColumn(own[0], F.pmod(F.xxhash64(F.col(tag)), F.lit(own[1])).cast("int"))
        return x.withColumn(other_n[0], F.explode(F.sequence(F.lit(0), F.lit(other_n[1] - 1))))

    P = prep(probe, (PC, npc), (BB, nb), "__pid")
    B = prep(base, (BB, nb), (PC, npc), "__bid")
    key = [*parts, PC, BB]
    return _nearest(P.groupBy(*key).cogroup(B.groupBy(*key)).applyInPandas(kern, schema), k, donors)


def _largest(df: DataFrame, parts: Sequence[str]) -> int:
    got = df.groupBy(*[c(p) for p in parts]).count().agg(F.max("count").alias("n")).first()
    return got["n"] or 0


def _side(n: int, least: int, feats: Sequence[str]) -> int:
    """Rows of a chunk or block: an eighth of the rows, so that what is sent grows with the rows,
    until a task's memory ends that; never below ``least``."""
    return max(least, min(math.ceil(n / 8), MOST_BYTES // (8 * max(1, len(feats)))))


def _present(df: DataFrame, feats: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Rows, and rows that have each feature."""
    got = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(~F.isnan(c(x).cast("double")), 1)).alias(f"f{i}")
                                                for i, x in enumerate(feats)]).first()
    return got["n"], {x: got[f"f{i}"] for i, x in enumerate(feats)}


def _nearest(local: DataFrame, k: int, donors: bool) -> DataFrame:
    """The k nearest of what the tasks found, per probe (and missing feature)."""
    per = ["probe_id", "feature"] if donors else ["probe_id"]
    w = Window.partitionBy(*per).orderBy("dist", "base_id")
    merged = local.withColumn("nn_rank", F.row_number().over(w)).filter(F.col("nn_rank") <= k)
    return merged.withColumn("nn_rank", F.col("nn_rank").cast("bigint"))
