"""Class counts, filters and descriptive statistics.

Global statistics are single aggregates with map-side partial aggregation;
per-class statistics group on the label (one row per class survives the
shuffle).  Exact quantiles come from a range-partitioned rank
(:func:`tidewell.operators.ranking.group_rank`) rather than the ``percentile``
aggregate, which would pull every distinct value of a column into one task;
``approx=True`` switches to ``percentile_approx`` (bounded sketch, one pass).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.columns import c, minkowski, null_count
from tidewell.operators.brackets import MOST_POSITIONS, bracketed_quantiles
from tidewell.operators.ranking import group_rank
from tidewell.operators.small import small_side
from tidewell.spec import NUMERIC_TYPES, Spec, q

# --------------------------------------------------------------------- classes


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """G1: rows per class (label, n)."""
    return df.groupBy(c(label_col).alias(label_col)).agg(F.count(F.lit(1)).alias("n"))


def class_shares(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows and share per class (label, n, share).  The window runs over the
    per-class table (one row per class), never over the data."""
    counts = class_counts(df, label_col)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def filter_min_class(df: DataFrame, label_col: str = "label", min_rows: int = 5) -> DataFrame:
    """Drop classes with fewer than ``min_rows`` rows; NULL labels go too.

    Counts are a partial aggregate; the kept-class list (one row per class) is
    semi-joined back as a broadcast behind a row-count check (``small_side``).
    """
    keep = (df.filter(c(label_col).isNotNull())
              .groupBy(c(label_col).alias(label_col)).agg(F.count(F.lit(1)).alias("__n"))
              .filter(F.col("__n") >= min_rows).select(label_col))
    return df.join(small_side(keep), on=label_col, how="left_semi")


def filter_null_share(df: DataFrame, id_col: str = "id", share: float = 0.2) -> DataFrame:
    """Keep rows whose NULL count over all columns but the key (label included)
    is at most ``share`` × that number of columns."""
    cols = [x for x in df.columns if x != id_col]
    return df.filter(null_count(cols) <= F.lit(share * len(cols)))


def distinct_values(df: DataFrame, col: str = "label") -> DataFrame:
    """The sorted distinct values of a column."""
    return df.select(c(col).alias(col)).distinct().orderBy(col)


# --------------------------------------------------------------------- shape & schema


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("bigint"))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def select_by_type(df: DataFrame, kind: str = "numeric", exclude: Sequence[str] = ()) -> DataFrame:
    """The numeric, or the other (string / boolean / ...) columns."""
    nums = set(numeric_columns(df))
    keep = [x for x in df.columns if x not in exclude and ((x in nums) == (kind == "numeric"))]
    return df.select(*[c(x) for x in keep])


def schema_info(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null) — one aggregate, then a stack to long form."""
    counts = df.agg(*[F.count(c(x)).alias(f"__c{i}") for i, x in enumerate(df.columns)])
    rows = [F.struct(F.lit(x).alias("feature"), F.lit(f.dataType.simpleString()).alias("dtype"),
                     F.col(f"__c{i}").alias("non_null"))
            for i, (x, f) in enumerate(zip(df.columns, df.schema.fields))]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# --------------------------------------------------------------------- long form & quantiles


def to_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
            name_col: str = "feature", value_col: str = "value") -> DataFrame:
    """Unpivot feature columns into (keep..., column, value DOUBLE); NULL values are dropped."""
    return (df.select(*[c(k) for k in keep],
                      F.explode(F.array(*[F.struct(F.lit(x).alias(name_col),
                                                   c(x).cast("double").alias(value_col))
                                          for x in cols])).alias("__kv"))
              .select(*[c(k) for k in keep], f"__kv.{name_col}", f"__kv.{value_col}")
              .filter(F.col(value_col).isNotNull()))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              group_cols: Sequence[str] = (), approx: bool = False,
              accuracy: int = 10000) -> DataFrame:
    """Linear-interpolated quantiles per (group..., column): columns group..., column, p, value.

    Exact: without groups, up to ``MOST_POSITIONS`` positions are found by bracketing
    (:mod:`tidewell.operators.brackets`).  Otherwise values are ranked per (group, column)
    with a range-partitioned rank; only the two order statistics around each position
    survive a filter, so no task holds a whole column.  ``approx`` uses ``percentile_approx`` (no
    interpolation, bounded memory, single pass).
    """
    groups = list(group_cols)
    if not groups and not approx and cols and len(set(probs)) <= MOST_POSITIONS:
        found = bracketed_quantiles(df, list(cols), probs)
        if found is not None:
            return found
    long = to_long(df, cols, groups)
    key = [*groups, "feature"]
    if approx:
        agg = long.groupBy(*key).agg(
            F.percentile_approx("value", list(probs), accuracy).alias("__qs"))
        return (agg.select(*key, F.posexplode("__qs").alias("__i", "value"))
                   .withColumn("p", F.element_at(F.array(*[F.lit(float(p)) for p in probs]),
                                                 F.col("__i") + 1))
                   .select(*key, "p", "value"))
    # distinct values with multiplicities: copies of one value collapse in the partial
    # aggregate, and (group, value) is a total order for the weighted rank
    dv = long.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("__c"))
    ranked = group_rank(dv, key, ["value"], rank_col="__cum", count_col="__n", weight_col="__c",
                        hash_ordered=False, materialize=True)
    # a distinct value covers ranks (a, b] = (__cum - __c, __cum]; position p needs ranks
    # floor(h)+1 and ceil(h)+1 with h = (n-1)·p, and only p in ((a-1)/(n-1), b/(n-1)) can hit
    # them.  The sorted probabilities are searched by a binary search, so each distinct value
    # emits just the few positions it covers (about two rows per probability in all), never
    # one row per probability.
    ps = sorted({float(p) for p in probs})
    probs_arr = F.array(*[F.lit(p) for p in ps])
    den = F.greatest(F.col("__n") - 1, F.lit(1)).cast("double")
    a = F.col("__cum") - F.col("__c")
    # #probabilities ≤ bound, by Bucketizer's binary search (splits: -inf, p0, …, +inf)
    from pyspark.ml.feature import Bucketizer
    bounded = ranked.withColumns({"__blo": (a - 1) / den, "__bhi": F.col("__cum") / den})
    bounded = Bucketizer(splitsArray=[[-float("inf")] + ps + [float("inf")]] * 2, inputCols=["__blo", "__bhi"],
                         outputCols=["__klo", "__khi"]).transform(bounded)
    i0 = F.greatest(F.col("__klo").cast("int") - 1, F.lit(0))
    i1 = F.least(F.col("__khi").cast("int") + 1, F.lit(len(ps)))
    cand = (bounded.filter(i1 > i0)
                  .withColumn("__i", F.explode(F.sequence(i0, i1 - 1)))
                  .withColumn("p", F.element_at(probs_arr, F.col("__i") + 1))
                  .withColumn("__h", (F.col("__n") - 1) * F.col("p"))
                  .withColumn("__lo", (F.floor("__h") + 1).cast("bigint"))
                  .withColumn("__hi", (F.ceil("__h") + 1).cast("bigint")))
    covers = lambda r: (F.col("__cum") - F.col("__c") < F.col(r)) & (F.col(r) <= F.col("__cum"))
    hits = cand.filter(covers("__lo") | covers("__hi"))
    out = (hits.groupBy(*key, "p", "__h", "__lo")
               .agg(F.max(F.when(covers("__lo"), F.col("value"))).alias("__vlo"),
                    F.max(F.when(covers("__hi"), F.col("value"))).alias("__vhi")))
    frac = F.col("__h") - (F.col("__lo") - 1)
    return out.select(*key, "p", (F.col("__vlo") + frac * (F.col("__vhi") - F.col("__vlo"))).alias("value"))


def _wide_quantiles(qs: DataFrame, key: Sequence[str], names: dict[float, str]) -> DataFrame:
    aggs = [F.max(F.when(F.col("p") == F.lit(p), F.col("value"))).alias(n) for p, n in names.items()]
    return qs.groupBy(*key).agg(*aggs)


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Per column count, mean, std (sample), min, p25, p50, p75, max."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    v = {i: c(x).cast("double") for i, x in enumerate(cols)}
    made = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[fn(e).alias(f"{k}{i}") for i, e in v.items() for k, fn in made.items()]).first()  # one aggregate for all columns
    moments = df.sparkSession.createDataFrame(
        [(x, *[row[f"{k}{i}"] for k in made]) for i, x in enumerate(cols) if row[f"count{i}"]],
        "feature string, count long, mean double, std double, min double, max double")
    qs = _wide_quantiles(quantiles(df, cols, [0.25, 0.5, 0.75], approx=approx), ["feature"],
                         {0.25: "p25", 0.5: "p50", 0.75: "p75"})
    return moments.join(qs, on="feature", how="left").select(
        "feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def medians(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, median)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    return quantiles(df, cols, [0.5], approx=approx).select("feature", F.col("value").alias("median"))


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column count (non-null), distinct, mode (most frequent; ties → smallest), freq."""
    long = (df.select(F.explode(F.array(*[F.struct(F.lit(x).alias("feature"),
                                                   c(x).cast("string").alias("value"))
                                          for x in cols])).alias("kv"))
              .select("kv.feature", "kv.value").filter(F.col("value").isNotNull()))
    per_value = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return per_value.groupBy("feature").agg(
        F.sum("cnt").alias("count"), F.count(F.lit(1)).alias("n_distinct"),
        F.min_by("value", F.struct((-F.col("cnt")).alias("k"), F.col("value").alias("v"))).alias("mode"),
        F.max("cnt").alias("freq"))


def profile(df: DataFrame, exclude: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """One row per column: dtype, numeric summary (NULL for non-numeric) and
    categorical summary (NULL for numeric)."""
    nums = numeric_columns(df, exclude)
    cats = [x for x in df.columns if x not in nums and x not in exclude]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    spark = df.sparkSession
    tdf = spark.createDataFrame([(k, v) for k, v in types.items() if k not in exclude],
                                "feature string, dtype string")
    out = tdf
    if nums:
        out = out.join(describe_numeric(df, nums, approx=approx), on="feature", how="left")
    if cats:
        out = out.join(describe_categorical(df, cats).withColumnRenamed("count", "count_cat"),
                       on="feature", how="left")
    return out


def extremes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Flag columns ``<col>__is_max``, ``__is_min``, ``__is_null`` per cell.

    The per-column min/max is one aggregate row; its values become literals,
    so the flagging is a pure projection."""
    stats = df.agg(*[F.min(c(x)).alias(f"mn{i}") for i, x in enumerate(cols)],
                   *[F.max(c(x)).alias(f"mx{i}") for i, x in enumerate(cols)]).collect()[0]
    extra = {}
    for i, x in enumerate(cols):
        extra[f"{x}__is_max"] = F.coalesce(c(x) == F.lit(stats[f"mx{i}"]), F.lit(False))
        extra[f"{x}__is_min"] = F.coalesce(c(x) == F.lit(stats[f"mn{i}"]), F.lit(False))
        extra[f"{x}__is_null"] = c(x).isNull()
    return df.withColumns(extra)


def boxplot_stats(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """q1, median, q3, iqr, whiskers (furthest values within 1.5·IQR), outlier count."""
    qs = _wide_quantiles(quantiles(df, cols, [0.25, 0.5, 0.75], approx=approx), ["feature"],
                         {0.25: "q1", 0.5: "median", 0.75: "q3"})
    # one row per column: its fences become literals of one aggregate over all columns
    box = {r["feature"]: r for r in qs.collect()}
    aggs = []
    for i, x in enumerate(x for x in cols if x in box):
        r, v = box[x], c(x).cast("double")
        lo, hi = (F.lit(e) for e in (r["q1"] - 1.5 * (r["q3"] - r["q1"]), r["q3"] + 1.5 * (r["q3"] - r["q1"])))
        aggs += [F.min(F.when(v >= lo, v)).alias(f"l{i}"), F.max(F.when(v <= hi, v)).alias(f"h{i}"), F.count(F.when((v < lo) | (v > hi), 1)).alias(f"n{i}")]
    got = df.agg(*aggs).first() if aggs else None
    rows = [(x, *[box[x][k] for k in ("q1", "median", "q3")], got[f"l{i}"], got[f"h{i}"], got[f"n{i}"], box[x]["q3"] - box[x]["q1"])
            for i, x in enumerate(x for x in cols if x in box)]
    return df.sparkSession.createDataFrame(rows, "feature string, q1 double, median double, q3 double, whisker_low double, "
                                                 "whisker_high double, n_outliers long, iqr double")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """``bins`` equal-width bins over [min, max]; the max falls in the last bin;
    empty bins are present (bin, lo, hi, n)."""
    mm = df.agg(F.min(c(col)).alias("mn"), F.max(c(col)).alias("mx")).collect()[0]
    mn, mx = mm["mn"], mm["mx"]
    spark = df.sparkSession
    if mn is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n bigint")
    width = (mx - mn) / bins if mx > mn else 1.0
    lo = float(mn) if mx > mn else float(mn) - 0.5
    width = (float(mx) - float(mn)) / bins if mx > mn else 1.0 / bins
    b = F.least(F.floor((c(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(c(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (edges.join(counts, on="bin", how="left")
                 .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                         F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair (col_a, col_b, corr); pairwise
    complete rows.  Tasks add block products of the centred columns and their masks; one row
    of sums per column leaves a task, and the sums are added by column."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    cols = list(cols)
    d = len(cols)
    row = df.agg(*[F.avg(c(x).cast("double")).alias(f"m{i}") for i, x in enumerate(cols)]).first()
    mean = np.array([row[i] if row[i] is not None else 0.0 for i in range(d)], float)

    def run(batches):
        total = np.zeros((4, d, d))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)]).astype(float) - mean
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            m = there.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()),
                                          pa.array([total[:, a].tobytes() for a in range(d)], pa.binary())], names=["a", "v"])

    def add(key, pdf):
        return pd.DataFrame({"a": [key[0]], "v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})

    sums = (df.select(*[c(x).cast("double").alias(f"x{i}") for i, x in enumerate(cols)]).mapInArrow(run, "a int, v binary")
            .groupBy("a").applyInPandas(add, "a int, v binary").collect())  # one row per column
    held = np.zeros((4, d, d))
    for r in sums:
        held[:, r["a"]] = np.frombuffer(r["v"]).reshape(4, d)
    n, sx, sxx, sxy = held
    with np.errstate(all="ignore"):
        cov = sxy - sx * sx.T / n
        var = sxx - sx * sx / n
        corr = cov / np.sqrt(var * var.T)
    rows = [(cols[a], cols[b], None if np.isnan(corr[a, b]) else float(corr[a, b])) for a in range(d) for b in range(d)]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


def centroids(df: DataFrame, spec: Spec) -> DataFrame:
    """Per-class mean of each feature, NULLs skipped (label, features...)."""
    return df.groupBy(c(spec.label_col).alias(spec.label_col)).agg(
        *[F.avg(c(x)).alias(x) for x in spec.feats])


def distance_to_centroid(df: DataFrame, spec: Spec, p: float = 2.0, out_col: str = "distance") -> DataFrame:
    """Minkowski distance of each row to its class centroid (NULL terms skipped).
    The centroid table has one row per class."""
    cen = centroids(df, spec)
    cen = small_side(cen.select(c(spec.label_col).alias("__lbl"),
                                *[c(x).alias(f"__m{i}") for i, x in enumerate(spec.feats)]))
    j = df.join(cen, df[q(spec.label_col)].eqNullSafe(cen["__lbl"]), "inner")
    dist = minkowski([c(x) for x in spec.feats], [F.col(f"__m{i}") for i in range(len(spec.feats))], p)
    return j.withColumn(out_col, dist).drop("__lbl", *[f"__m{i}" for i in range(len(spec.feats))])


def with_row_max(df: DataFrame, cols: Sequence[str], out_col: str = "p_max") -> DataFrame:
    """The largest of ``cols`` per row."""
    return df.withColumn(out_col, F.greatest(*[c(x) for x in cols]) if len(cols) > 1 else c(cols[0]))


# --------------------------------------------------------------------- misc


def infer_problem_type(df: DataFrame, label_col: str = "label", most_classes: int = 20) -> DataFrame:
    """E12: 'binary' (2 classes), 'multiclass' (string, or integer with up to ``most_classes``
    values), 'regression' (floating label, or more integer values)."""
    dtype = df.schema[label_col].dataType
    n = df.agg(F.count_distinct(c(label_col)).alias("n_classes"))
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        kind = F.when(F.col("n_classes") == 2, "binary").otherwise("regression")
    elif isinstance(dtype, NUMERIC_TYPES):
        kind = (F.when(F.col("n_classes") == 2, "binary")
                 .when(F.col("n_classes") <= most_classes, "multiclass").otherwise("regression"))
    else:
        kind = F.when(F.col("n_classes") == 2, "binary").otherwise("multiclass")
    return n.withColumn("problem_type", kind)
