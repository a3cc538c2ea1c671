"""Permutation feature importance (E9, E10) and importance-driven selection.

For every shuffle s, each evaluation row meets the row whose dense number is
(own number + shift(s)) mod n, with the shift a digest in [1, n-1] — a permutation
without a driver-side shuffle.  That self-join moves each row once a shuffle; feature f
then takes the partner's value in the scoring task, so rows of single features never
travel.  The rows of all (feature, shuffle) pairs are scored in one ``transform``; accuracy per pair
is one grouped aggregate.  Statistics over the shuffles: mean drop, sample
standard deviation, one-sided t-test p-value and the 99 % t interval.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import c, hash_text, hash_uniform
from tidewell.operators import models as M
from tidewell.operators.ranking import group_rank
from tidewell.spec import Spec


# ----------------------------------------------------------------- Student t on the driver

def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    cc, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        cc = 1.0 + aa / cc if abs(1.0 + aa / cc) > 1e-300 else 1e-300
        h *= d * cc
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        cc = 1.0 + aa / cc if abs(1.0 + aa / cc) > 1e-300 else 1e-300
        de = d * cc
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return h


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbeta) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbeta) * _betacf(b, a, 1 - x) / b


def t_sf(t: float, df: int) -> float:
    """P(T > t) for Student's t with ``df`` degrees of freedom."""
    x = df / (df + t * t)
    tail = 0.5 * _betainc(df / 2.0, 0.5, x)
    return tail if t > 0 else 1.0 - tail


def t_ppf(q: float, df: int) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1.0 - t_sf(mid, df) < q:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def importance_stats(scores: DataFrame, base_score: float) -> DataFrame:
    """Statistics of (feature, shuffle, score) rows: importance = mean(base − score),
    stddev (sample), p_value (one-sided t), n, p99_high, p99_low."""
    drops = scores.withColumn("__d", F.lit(base_score) - F.col("score"))
    agg = drops.groupBy("feature").agg(F.avg("__d").alias("importance"), F.stddev_samp("__d").alias("stddev"),
                                       F.count(F.lit(1)).alias("n"))
    rows = agg.collect()  # one row per feature
    out = []
    for r in rows:
        n, mean, sd = int(r["n"]), r["importance"], r["stddev"]
        if n > 1 and sd and sd > 0:
            t = mean / (sd / math.sqrt(n))
            p = t_sf(t, n - 1)
            half = t_ppf(0.995, n - 1) * sd / math.sqrt(n)
        else:
            p, half = (0.5 if not mean else (0.0 if mean > 0 else 1.0)), 0.0
        out.append((r["feature"], float(mean), float(sd or 0.0), float(p), n, float(mean + half), float(mean - half)))
    return scores.sparkSession.createDataFrame(
        out, "feature string, importance double, stddev double, p_value double, n int, p99_high double, p99_low double")


def permuted_scores(m: M.Trained, df: DataFrame, spec: Spec, features: list[str] | None = None,
                    shuffles: int = 5, seed: int = 42) -> DataFrame:
    """(feature, shuffle, score) — accuracy with one feature permuted."""
    feats = list(features or m.features)
    base = df.select(c(spec.id_col).cast("string").alias(spec.id_col), *[c(x) for x in m.features],
                     c(spec.label_col).alias("__y")).withColumn("__h", hash_text(spec.id_col, seed, "perm"))
    numbered = group_rank(base, [], ["__h", spec.id_col], rank_col="__rn", count_col="__n", hash_ordered=True) \
        .withColumn("__rn", F.col("__rn") - 1)
    shift = 1 + F.floor(hash_uniform(F.col("shuffle").cast("string"), seed, "shift") * (F.col("__n") - 1))
    ex = numbered.withColumn("shuffle", F.explode(F.array(*[F.lit(s) for s in range(shuffles)])))
    ex = ex.withColumn("__src", F.pmod(F.col("__rn") + shift.cast("bigint"), F.col("__n")))
    donor = numbered.select(F.col("__rn").alias("__src"), F.struct(*[c(f).alias(f"v{i}") for i, f in enumerate(feats)])
                            .alias("__vals"))
    # a row becomes one per feature: spread before that, as the join's few bytes would end in few tasks
    sc = df.sparkSession.sparkContext
    j = ex.join(donor, "__src").repartition(4 * sc.defaultParallelism, "__rn", "shuffle").withColumn("feature", F.explode(F.array(*[F.lit(f) for f in feats])))
    swapped = j.withColumns({f: F.when(F.col("feature") == F.lit(f), F.col("__vals")[f"v{i}"]).otherwise(c(f))
                             for i, f in enumerate(feats)})
    swapped = swapped.withColumn(spec.id_col, F.concat_ws("|", c(spec.id_col), F.col("feature"),
                                                          F.col("shuffle").cast("string")))
    # scored on the permuted rows themselves: the label travels with them, no join back
    scored = M.with_prediction(m, swapped.select(c(spec.id_col), *[c(x) for x in m.features], "feature", "shuffle",
                                                 "__y"), spec.id_col, "__pred", "__pmax")
    return scored.groupBy("feature", "shuffle").agg(
        F.avg((F.col("__pred") == F.col("__y")).cast("double")).alias("score"))


def feature_importance(m: M.Trained, df: DataFrame, spec: Spec, shuffles: int = 5, seed: int = 42) -> DataFrame:
    """Permutation importance table of one model."""
    base = M.accuracy(m, df, spec)
    return importance_stats(permuted_scores(m, df, spec, None, shuffles, seed), base)


def importance_all_models(models: list[M.Trained], df: DataFrame, spec: Spec, shuffles: int = 5) -> DataFrame:
    """E9 for every model, stacked with a ``model`` column."""
    out = None
    for m in models:
        t = feature_importance(m, df, spec, shuffles).withColumn("model", F.lit(m.name))
        out = t if out is None else out.unionByName(t)
    return out


def select_by_importance(imp: DataFrame, threshold: float = 0.005, mode: str = "abs") -> list[str]:
    """Features with importance > t or < −t (``abs``), or ≠ 0 (``nonzero``)."""
    cond = (F.col("importance") != 0) if mode == "nonzero" else (F.abs(F.col("importance")) > threshold)
    return [r["feature"] for r in imp.filter(cond).select("feature").collect()]


def fit_per_model_subset(train: DataFrame, test: DataFrame, spec: Spec, importances: dict[str, DataFrame],
                         threshold: float = 0.005) -> DataFrame:
    """Each family refit on its own selected features; leaderboards appended,
    ensembles left out, sorted by test score.  A family of which no feature passes the
    threshold is left out; if none is left, the result is empty."""
    boards = M.leaderboard([], spec, test=test)
    for family, imp in importances.items():
        feats = select_by_importance(imp, threshold)
        if not feats:
            continue
        s2 = spec.with_features(feats)
        m = M.fit_model(train, s2, family)
        b = M.leaderboard([m], s2, test=test)
        boards = boards.unionByName(b)
    return boards.filter(~F.col("model").contains("Ensemble")).orderBy(F.col("score_test").desc())
