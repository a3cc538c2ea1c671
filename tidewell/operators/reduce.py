"""Training-set reduction (W2–W4) and ranking helpers.

Per class: distance of each row to the class centroid, exact rank by
(distance, id) with the sliced group rank (a large class is numbered by many
tasks), then a rank filter.  m = bround(n · t) is Python's half-even rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import c, row_max
from tidewell.operators.ranking import group_rank
from tidewell.operators.stats import distance_to_centroid, quantiles
from tidewell.spec import Spec

METHODS = ("first", "last", "proportion")


def rank_by_centroid_distance(df: DataFrame, spec: Spec, p: float = 2.0) -> DataFrame:
    """Adds distance, rn (1 = nearest; ties by id) and n (class size)."""
    d = distance_to_centroid(df, spec, p, "distance")
    # the count, the sample, the numbering and the slice totals read the distances: join the centroids once
    return group_rank(d, [spec.label_col], ["distance", spec.id_col], rank_col="rn", count_col="n",
                      hash_ordered=False, materialize=True)


def reduce_per_class(df: DataFrame, spec: Spec, threshold: float = 0.8, method: str = "first",
                     p: float = 2.0) -> DataFrame:
    """W2 first: the bround(n·t) rows nearest the centroid; W3 last: the bround(n·t)
    farthest; W4 proportion: with step = bround(n / (n − m)), drop ranks 1, 1+step,
    1+2·step, … (not exactly m rows kept; n = m keeps everything)."""
    r = rank_by_centroid_distance(df, spec, p)
    m = F.bround(F.col("n") * F.lit(float(threshold)))
    if method == "first":
        keep = F.col("rn") <= m
    elif method == "last":
        keep = F.col("rn") > F.col("n") - m
    elif method == "proportion":
        step = F.bround(F.col("n") / (F.col("n") - m))
        keep = F.when(F.col("n") == m, True).otherwise(((F.col("rn") - 1) % step) != 0)
    else:
        raise ValueError(f"unknown method {method!r}; known are {', '.join(METHODS)}")
    return r.filter(keep).drop("distance", "rn", "n")


def rank_models(board: DataFrame, first: str = "score_test", second: str = "score_val") -> DataFrame:
    """Leaderboard ordered by two scores, best first."""
    return board.orderBy(F.col(first).desc_nulls_last(), F.col(second).desc_nulls_last(), F.col("model"))


def name_contains(board: DataFrame, text: str = "DSTL", col: str = "model") -> DataFrame:
    """Models whose name contains ``text``."""
    return board.filter(F.col(col).contains(text))


def best_student(board: DataFrame, text: str = "DSTL") -> DataFrame:
    """The first distilled model after W5 (a one-row top-1 report)."""
    return rank_models(name_contains(board, text)).limit(1)


def describe_stat(df: DataFrame, col: str, stat: str | None):
    """The value of a describe() statistic of one column: min, 25%, mean, 50%, 75%, max."""
    if stat is None:
        return None
    if stat in ("min", "max", "mean"):
        fn = {"min": F.min, "max": F.max, "mean": F.avg}[stat]
        return df.agg(fn(c(col)).alias("v")).collect()[0]["v"]
    p = {"25%": 0.25, "50%": 0.5, "75%": 0.75}[stat]
    return quantiles(df, [col], [p]).collect()[0]["value"]


def quantile_cut(df: DataFrame, prob_cols: list[str] | str, stat: str | None = "75%",
                 out_col: str = "p_max") -> DataFrame:
    """Keep rows whose highest class probability is ≥ the given statistic of that
    row maximum over the whole table (None keeps everything).  The statistic is one
    scalar aggregate, applied as a literal."""
    cols = [prob_cols] if isinstance(prob_cols, str) else list(prob_cols)
    with_max = df.withColumn(out_col, row_max(cols))
    v = describe_stat(with_max, out_col, stat)
    return with_max if v is None else with_max.filter(F.col(out_col) >= F.lit(v))


def in_band(df: DataFrame, col: str, lo_q: float = 0.25, hi_q: float = 0.75) -> DataFrame:
    """Keep rows whose value lies between two of its quantiles (inclusive)."""
    qs = {r["p"]: r["value"] for r in quantiles(df, [col], [lo_q, hi_q]).collect()}
    return df.filter(c(col).between(F.lit(qs[lo_q]), F.lit(qs[hi_q])))
