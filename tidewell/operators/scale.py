"""Scalers (N1–N7): ``fit`` returns a small parameter table (one row per feature);
``apply`` turns it into literals, so scaling is a projection inside whole-stage codegen.

NULL cells stay NULL.  Semantics follow the usual definitions: population standard
deviation, zero spread → divisor 1 (standard, max-abs, robust), constant column → 0
(min-max).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import c
from tidewell.operators.stats import quantiles

METHODS = ("standard", "maxabs", "minmax", "normalizer", "power", "quantile", "robust")


def _params_from_row(spark, row, cols, names):
    data = [(x, *[None if row[f"{n}{i}"] is None else float(row[f"{n}{i}"]) for n in names])
            for i, x in enumerate(cols)]
    return spark.createDataFrame(data, "feature string, " + ", ".join(f"{n} double" for n in names))


def fit_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """N1 fit: (feature, mean, scale) with scale = population std, or 1 when it is 0."""
    row = df.agg(*[F.avg(c(x)).alias(f"mean{i}") for i, x in enumerate(cols)],
                 *[F.stddev_pop(c(x)).alias(f"std{i}") for i, x in enumerate(cols)]).collect()[0]
    p = _params_from_row(df.sparkSession, row, cols, ["mean", "std"])
    return p.select("feature", "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("scale"))


def fit_maxabs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """N2 fit: (feature, scale) with scale = max |x|, or 1 when it is 0."""
    row = df.agg(*[F.max(F.abs(c(x))).alias(f"m{i}") for i, x in enumerate(cols)]).collect()[0]
    p = _params_from_row(df.sparkSession, row, cols, ["m"])
    return p.select("feature", F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")).alias("scale"))


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """N3 fit: (feature, min, max)."""
    row = df.agg(*[F.min(c(x)).alias(f"min{i}") for i, x in enumerate(cols)],
                 *[F.max(c(x)).alias(f"max{i}") for i, x in enumerate(cols)]).collect()[0]
    return _params_from_row(df.sparkSession, row, cols, ["min", "max"])


def fit_robust(df: DataFrame, cols: Sequence[str], q_range=(25.0, 75.0), approx: bool = False) -> DataFrame:
    """N7 fit: (feature, center, scale) = median, IQR (1 when 0), exact by default."""
    lo, hi = q_range[0] / 100.0, q_range[1] / 100.0
    qs = quantiles(df, cols, [lo, 0.5, hi], approx=approx)
    wide = qs.groupBy("feature").agg(
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("center"),
        (F.max(F.when(F.col("p") == hi, F.col("value")))
         - F.max(F.when(F.col("p") == lo, F.col("value")))).alias("iqr"))
    return wide.select("feature", "center", F.when(F.col("iqr") == 0, 1.0).otherwise(F.col("iqr")).alias("scale"))


def _lit_params(params: DataFrame) -> dict[str, dict]:
    return {r["feature"]: r.asDict() for r in params.collect()}


def apply_affine(df: DataFrame, params: DataFrame, center: str | None, scale: str | None) -> DataFrame:
    """x → (x - center) / scale per feature, from a parameter table."""
    p = _lit_params(params)
    out = {}
    for x, r in p.items():
        e = c(x).cast("double")
        if center:
            e = e - F.lit(r[center])
        if scale:
            e = e / F.lit(r[scale])
        out[x] = e
    return df.withColumns(out)


def apply_minmax(df: DataFrame, params: DataFrame) -> DataFrame:
    p = _lit_params(params)
    out = {}
    for x, r in p.items():
        rng = (r["max"] - r["min"]) if r["max"] is not None else None
        if rng is None:
            out[x] = c(x).cast("double")
        elif rng == 0:
            out[x] = F.when(c(x).isNull(), None).otherwise(F.lit(0.0))
        else:
            out[x] = (c(x) - F.lit(r["min"])) / F.lit(rng)
    return df.withColumns(out)


def normalize_rows(df: DataFrame, cols: Sequence[str], norm: str = "l2") -> DataFrame:
    """Each row divided by its l1 / l2 / max norm (NULL cells skipped; zero norm → unchanged)."""
    xs = [F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in cols]
    if norm == "l1":
        n = sum((F.abs(v) for v in xs[1:]), F.abs(xs[0]))
    elif norm == "l2":
        n = F.sqrt(sum((v * v for v in xs[1:]), xs[0] * xs[0]))
    elif norm == "max":
        n = F.greatest(*[F.abs(v) for v in xs]) if len(xs) > 1 else F.abs(xs[0])
    else:
        raise ValueError("norm must be l1, l2 or max")
    df = df.withColumn("__norm", F.when(n == 0, 1.0).otherwise(n))
    return df.withColumns({x: c(x) / F.col("__norm") for x in cols}).drop("__norm")


# ----------------------------------------------------------------- power (Yeo-Johnson / Box-Cox)


def _yj(x: Column, lam: float) -> Column:
    pos = x >= 0
    if abs(lam) < 1e-12:
        p = F.log1p(x)
    else:
        p = (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    if abs(lam - 2) < 1e-12:
        n = -F.log1p(-x)
    else:
        n = -(F.pow(1 - x, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(pos, p).otherwise(n)


def _bc(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


def _np_transform(v: np.ndarray, lam: float, method: str) -> np.ndarray:
    """``_yj`` / ``_bc`` of an array, without the values for which SQL has NULL."""
    with np.errstate(all="ignore"):
        if method != "yeo-johnson":
            return np.log(v[~(v <= 0)]) if abs(lam) < 1e-12 else (np.power(v, lam) - 1) / lam
        out, pos = np.empty_like(v), v >= 0
        x = v[pos]
        out[pos] = np.log1p(x) if abs(lam) < 1e-12 else (np.power(x + 1, lam) - 1) / lam
        x = v[~pos]
        out[~pos] = -np.log1p(-x) if abs(lam - 2) < 1e-12 else -(np.power(1 - x, 2 - lam) - 1) / (2 - lam)
        return out


def _pooled(a: tuple, b: tuple) -> tuple:
    """Count, mean and sum of squared deviations of two parts together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + d * d * (a[0] * (b[0] / n))


def _power_moments(df: DataFrame, lams: dict[str, list[float]], method: str) -> dict[tuple[str, int], tuple]:
    """(feature, place of λ) → (count, mean, squared deviations) of the transformed column, and
    (feature, -1) → (count of values, Σ of the log Jacobian).

    A task adds up all transforms of its rows by numpy, block by block: a hundred central
    moments in one SQL aggregate are too wide for generated code, and each would compute its
    transform several times."""
    cols = list(lams)

    def run(batches):
        held: dict[tuple, tuple] = {}
        for batch in batches:
            for i, x in enumerate(cols):
                v = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                with np.errstate(all="ignore"):
                    jac = np.sign(v) * np.log1p(np.abs(v)) if method == "yeo-johnson" else np.log(v[~(v <= 0)])
                    n, s, _ = held.get((i, -1), (0, 0.0, 0.0))
                    held[i, -1] = (n + len(v), s + float(jac.sum()), 0.0)
                    for k, lam in enumerate(lams[x]):
                        t = _np_transform(v, lam, method)
                        if len(t):
                            mean = t.mean()
                            part = (len(t), float(mean), float(np.square(t - mean).sum()))
                            held[i, k] = _pooled(held.get((i, k), (0, 0.0, 0.0)), part)
        rows = [(i, k, *m) for (i, k), m in held.items()]
        if rows:
            types = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows), types)], names=list("fknms"))

    def add(key, pdf):
        import pandas as pd
        total = (0, 0.0, 0.0)
        for n, m, s in zip(pdf["n"], pdf["m"], pdf["s"]):
            total = (total[0] + n, total[1] + m, 0.0) if key[1] < 0 else _pooled(total, (n, m, s))
        return pd.DataFrame([(*key, *total)], columns=list("fknms"))

    schema = "f int, k int, n long, m double, s double"
    made = df.select(*[c(x).cast("double") for x in cols]).mapInArrow(run, schema)
    held = lambda v: math.nan if v is None else v  # pandas hands NaN on as NULL
    return {(cols[r["f"]], r["k"]): (r["n"], held(r["m"]), held(r["s"]))
            for r in made.groupBy("f", "k").applyInPandas(add, schema).collect()}  # one row per feature and λ


#: bracket moves at most (each doubles the bracket: λ beyond any double transform)
MOVES = 20


def fit_power(df: DataFrame, cols: Sequence[str], method: str = "yeo-johnson",
              grid=(-3.0, 3.0), steps: int = 25, passes: int = 3) -> DataFrame:
    """N5 fit: per-feature λ maximising the profile log-likelihood, then the mean and
    population std of the transformed column (standardise).

    Each pass evaluates ``steps`` λ values for every feature in one pass over the rows (the central
    second moment of each transform, n, and Σ sign(x)·log1p|x| or Σ log x).  While the best λ
    of a feature is at an end of its bracket the bracket moves there and doubles; otherwise
    the next pass zooms in.  ``passes`` counts the zooming passes of the slowest feature.
    """
    tf = _yj if method == "yeo-johnson" else _bc
    lo_hi = {x: grid for x in cols}
    best = {}
    left = dict.fromkeys(cols, passes)
    for _ in range(passes + MOVES):
        if not any(left.values()):
            break
        lams = {}
        for x in cols:
            if left[x]:
                lo, hi = lo_hi[x]
                lams[x] = [lo + (hi - lo) * k / (steps - 1) for k in range(steps)]
        moments = _power_moments(df, lams, method)
        for x in lams:
            n, jac, _ = moments.get((x, -1), (0, None, None))
            if n == 0:
                best.setdefault(x, 1.0)
                left[x] = 0
                continue
            scores = []
            for k, lam in enumerate(lams[x]):
                count, _, dev = moments.get((x, k), (0, None, None))
                var = dev / count if count else None
                fine = var is not None and 0 < var < math.inf
                scores.append((-n / 2 * math.log(var) + (lam - 1) * jac if fine else -math.inf, lam))
            ll, lam = max(scores)
            best[x] = lam
            lo, hi = lo_hi[x]
            if lam in (lams[x][0], lams[x][-1]) and ll > -math.inf:
                side = -1 if lam == lams[x][0] else 1
                lo_hi[x] = tuple(sorted((lam - side * (hi - lo) / 4, lam + side * (hi - lo) * 2)))
            else:
                step = (hi - lo) / (steps - 1)
                lo_hi[x] = (lam - step, lam + step)
                left[x] -= 1
    moments = df.agg(*[F.avg(tf(c(x).cast("double"), best[x])).alias(f"m{i}") for i, x in enumerate(cols)],
                     *[F.stddev_pop(tf(c(x).cast("double"), best[x])).alias(f"s{i}") for i, x in enumerate(cols)]
                     ).collect()[0]
    data = [(x, float(best[x]), moments[f"m{i}"], (moments[f"s{i}"] or 1.0) or 1.0) for i, x in enumerate(cols)]
    return df.sparkSession.createDataFrame(data, "feature string, lmbda double, mean double, scale double")


def apply_power(df: DataFrame, params: DataFrame, method: str = "yeo-johnson") -> DataFrame:
    tf = _yj if method == "yeo-johnson" else _bc
    p = _lit_params(params)
    return df.withColumns({x: (tf(c(x).cast("double"), r["lmbda"]) - F.lit(r["mean"])) / F.lit(r["scale"])
                           for x, r in p.items()})


# ----------------------------------------------------------------- quantile transform


def fit_quantile(df: DataFrame, cols: Sequence[str], n_quantiles: int = 1000, approx: bool = False) -> DataFrame:
    """N6 fit: (feature, k, ref, q) — min(n_quantiles, n) reference points k/(m-1) and
    the exact linear-interpolated quantiles at them."""
    n = df.count()
    m = max(2, min(n_quantiles, n))
    probs = [k / (m - 1) for k in range(m)]
    qs = quantiles(df, cols, probs, approx=approx)
    return qs.select("feature", F.col("p").alias("ref"), F.col("value").alias("q"))


def apply_quantile(df: DataFrame, params: DataFrame, output: str = "uniform") -> DataFrame:
    """x → the mean of the forward and backward linear interpolations of the reference
    grid over the quantile points (ties of quantiles are handled symmetrically);
    'normal' maps through the standard normal quantile, clipped to ±5.2.

    The segment of a value is found by ``Bucketizer`` (a binary search in the JVM over the
    distinct quantile points); the interpolation reads literal arrays, so the expression
    size does not grow with the number of points."""
    from pyspark.ml.feature import Bucketizer
    rows = params.orderBy("feature", "ref").collect()  # ≤ n_quantiles rows per feature
    per: dict[str, list] = {}
    for r in rows:
        per.setdefault(r["feature"], []).append((float(r["q"]), float(r["ref"])))
    feats = list(per)
    tmp = {x: f"__qb_in{i}" for i, x in enumerate(feats)}
    bucket = {x: f"__qb{i}" for i, x in enumerate(feats)}
    splits = []
    for x in feats:
        uniq = sorted({q for q, _ in per[x]})
        splits.append([-float("inf")] + uniq + [float("inf")])
    staged = df.withColumns({tmp[x]: F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in feats})
    staged = Bucketizer(splitsArray=splits, inputCols=[tmp[x] for x in feats],
                        outputCols=[bucket[x] for x in feats]).transform(staged)
    out = {}
    for x, sp in zip(feats, splits):
        q = [a for a, _ in per[x]]
        r = [b for _, b in per[x]]
        uniq = sp[1:-1]
        first = {}
        last = {}
        for j, v in enumerate(q):
            first.setdefault(v, j)
            last[v] = j
        out[x] = _interp_sym_bucketed(c(x).cast("double"), F.col(bucket[x]).cast("int"), q, r, uniq,
                                      [first[u] for u in uniq], [last[u] for u in uniq])
    res = staged.withColumns(out).drop(*tmp.values(), *bucket.values())
    if output == "normal":
        res = res.withColumns({x: _norm_ppf(F.col(x)) for x in feats})
    return res


def _interp_sym_bucketed(x: Column, b: Column, q: list[float], r: list[float], uniq: list[float],
                         first: list[int], last: list[int]) -> Column:
    """0.5·(forward + backward) np.interp of x over (q, r), given the bucket b of x among the
    distinct points (b = 0: below the first; b = t+1: uniq[t] ≤ x < uniq[t+1])."""
    m = len(q)
    # one text per array, folded to one literal: the plan does not grow with the number of points
    arr = lambda vals: F.split(F.lit(",".join(repr(float(v)) for v in vals)), ",").cast("array<double>")
    iarr = lambda vals: F.split(F.lit(",".join(str(int(v)) for v in vals)), ",").cast("array<int>")
    q_arr, r_arr, u_arr = arr(q), arr(r), arr(uniq)
    f_arr, l_arr = iarr(first), iarr(last)
    # forward: k = #points ≤ x
    k = F.when(b == 0, F.lit(0)).otherwise(F.element_at(l_arr, b) + 1)
    qa, qb = F.element_at(q_arr, k), F.element_at(q_arr, k + 1)
    ra, rb = F.element_at(r_arr, k), F.element_at(r_arr, k + 1)
    fwd = (F.when(k == 0, F.lit(r[0])).when(k >= m, F.lit(r[-1]))
            .otherwise(ra + (x - qa) * (rb - ra) / (qb - qa)))
    # backward, on the negated reversed grid: k' = #points ≥ x = m - #points < x
    eq = (b > 0) & (F.element_at(u_arr, F.greatest(b, F.lit(1))) == x)
    less = F.when(b == 0, F.lit(0)).when(eq, F.element_at(f_arr, F.greatest(b, F.lit(1)))) \
            .otherwise(F.element_at(l_arr, F.greatest(b, F.lit(1))) + 1)
    kb = F.lit(m) - less
    ia, ib = F.lit(m) - kb + 1, F.lit(m) - kb          # 1-based positions of q_{m-k'}, q_{m-k'-1}
    na, nb = -F.element_at(q_arr, ia), -F.element_at(q_arr, ib)
    fa, fb = -F.element_at(r_arr, ia), -F.element_at(r_arr, ib)
    bval = (F.when(kb == 0, F.lit(-r[-1])).when(kb >= m, F.lit(-r[0]))
             .otherwise(fa + ((-x) - na) * (fb - fa) / (nb - na)))
    return F.when(x.isNull(), None).otherwise(0.5 * (fwd + (-bval)))


def _norm_ppf(u: Column) -> Column:
    """Standard normal quantile by Acklam's rational approximation (|rel err| < 1.2e-9)."""
    # fixed coefficients of the published approximation
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
    cc = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
          -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
    eps = 1e-7
    p = F.least(F.greatest(u, F.lit(eps)), F.lit(1 - eps))

    def poly(coef, t):
        e = F.lit(coef[0])
        for k in coef[1:]:
            e = e * t + F.lit(k)
        return e
    ql = F.sqrt(-2 * F.log(p))
    low = poly(cc, ql) / (poly(d, ql) * ql + 1)
    qh = F.sqrt(-2 * F.log(1 - p))
    high = -poly(cc, qh) / (poly(d, qh) * qh + 1)
    qm = p - 0.5
    rr = qm * qm
    mid = poly(a, rr) * qm / (poly(b, rr) * rr + 1)
    z = F.when(p < 0.02425, low).when(p > 1 - 0.02425, high).otherwise(mid)
    return F.when(u.isNull(), None).otherwise(F.least(F.greatest(z, F.lit(-5.2)), F.lit(5.2)))


# ----------------------------------------------------------------- one entry point


def fit(df: DataFrame, cols: Sequence[str], method: str = "standard", **kw) -> DataFrame:
    if method == "standard":
        return fit_standard(df, cols)
    if method == "maxabs":
        return fit_maxabs(df, cols)
    if method == "minmax":
        return fit_minmax(df, cols)
    if method == "robust":
        return fit_robust(df, cols, kw.get("quantile_range", (25.0, 75.0)), kw.get("approx", False))
    if method == "power":
        return fit_power(df, cols, kw.get("method", "yeo-johnson"))
    if method == "quantile":
        return fit_quantile(df, cols, kw.get("n_quantiles", 1000), kw.get("approx", False))
    if method == "normalizer":
        return df.sparkSession.createDataFrame([(x, kw.get("norm", "l2")) for x in cols], "feature string, norm string")
    raise ValueError(f"unknown scaling method {method!r}; known are {', '.join(METHODS)}")


def apply(df: DataFrame, params: DataFrame, method: str = "standard", **kw) -> DataFrame:
    if method == "standard":
        return apply_affine(df, params, "mean", "scale")
    if method == "maxabs":
        return apply_affine(df, params, None, "scale")
    if method == "robust":
        return apply_affine(df, params, "center", "scale")
    if method == "minmax":
        return apply_minmax(df, params)
    if method == "power":
        return apply_power(df, params, kw.get("method", "yeo-johnson"))
    if method == "quantile":
        return apply_quantile(df, params, kw.get("output_distribution", "uniform"))
    if method == "normalizer":
        rows = params.collect()
        return normalize_rows(df, [r["feature"] for r in rows], rows[0]["norm"] if rows else "l2")
    raise ValueError(f"unknown scaling method {method!r}; known are {', '.join(METHODS)}")


def scale(df: DataFrame, cols: Sequence[str], method: str = "standard", fit_on: DataFrame | None = None, **kw):
    """Fit on ``fit_on`` (default: ``df``) and apply to ``df``; returns (scaled, params)."""
    params = fit(fit_on if fit_on is not None else df, cols, method, **kw)
    return apply(df, params, method, **kw), params
