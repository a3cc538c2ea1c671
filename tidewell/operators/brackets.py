"""Exact quantiles of many columns by bracketing: no row is exploded, no column is sorted.

1. One aggregate sketches every column (``percentile_approx``) a little below and above each
   wanted position; the sketch's rank error is at most rows / ``ACCURACY``, so the wanted
   order statistics lie between the two values.
2. One pass counts the values below each bracket and keeps the distinct values inside with
   their multiplicities: about six in ten thousand rows, and a value that a third of the
   rows share is one row of a task's output.
3. A running sum over the values inside, started at the count below, gives the order
   statistics; the counts prove that they lie inside (otherwise the caller ranks all values).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import c
from tidewell.operators.ranking import group_rank
from tidewell.session import cut_lineage

ACCURACY = 10_000
#: distance of a bracket's ends from the position, as a share of the rows: the sketch's error twice and rounding
MARGIN = 3 / ACCURACY
#: up to here a bracket is the whole column
SMALL = 20_000
#: from here the values of one bracket are ranked in slices
WIDE = 5_000_000_000
#: positions per column; with more the brackets would cover the column
MOST_POSITIONS = 32


def bracketed_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame | None:
    """(feature, p, value): linear-interpolated quantiles of the non-NULL values of each column
    (columns without values are left out), or None if NaN values or a sketch that missed call
    for the full ranking."""
    ps = sorted({float(p) for p in probs})
    spark = df.sparkSession
    ends = [min(1.0, max(0.0, x)) for p in ps for x in (p - MARGIN, p + MARGIN)]
    values = {i: c(x).cast("double") for i, x in enumerate(cols)}
    seen = df.agg(*[F.count(v).alias(f"n{i}") for i, v in values.items()],
                  *[F.count(F.when(F.isnan(v), 1)).alias(f"x{i}") for i, v in values.items()],
                  *[F.percentile_approx(v, ends, ACCURACY).alias(f"q{i}") for i, v in values.items()]).first()
    if any(seen[f"x{i}"] for i in values):
        return None
    lo, hi = np.full((len(cols), len(ps)), -np.inf), np.full((len(cols), len(ps)), np.inf)
    for i in values:
        if seen[f"n{i}"] > SMALL:
            for j, p in enumerate(ps):
                if p > MARGIN:
                    lo[i, j] = seen[f"q{i}"][2 * j]
                if p < 1 - MARGIN:
                    hi[i, j] = seen[f"q{i}"][2 * j + 1]
    limits = spark.sparkContext.broadcast((lo, hi))

    def inside(batches):
        lo, hi = limits.value
        below = np.zeros(lo.shape, np.int64)
        for batch in batches:
            rows = []
            for i in range(len(lo)):
                col = batch.column(i)
                v = col.drop_null().to_numpy(zero_copy_only=False)
                for j in range(lo.shape[1]):
                    under = v < lo[i, j]
                    below[i, j] += np.count_nonzero(under)
                    some, n = np.unique(v[~under & (v <= hi[i, j])], return_counts=True)
                    rows.append((np.full(len(n), i), np.full(len(n), j), some, n))
            f, j, v, n = (np.concatenate(x) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.float64()), pa.array(n, pa.int64())],
                                             names=["f", "j", "v", "n"])
        f, j = np.indices(lo.shape)
        yield pa.RecordBatch.from_arrays([pa.array(f.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.nulls(lo.size, pa.float64()),
                                          pa.array(below.ravel(), pa.int64())], names=["f", "j", "v", "n"])

    kept = cut_lineage(df.select(*[v.alias(f"v{i}") for i, v in values.items()])
                       .mapInArrow(inside, "f int, j int, v double, n long").groupBy("f", "j", "v").agg(F.sum("n").alias("n")))
    totals = kept.groupBy("f", "j").agg(F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("below"),
                                        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("inside")).collect()
    places = []
    for r in totals:  # one row per column and position
        n, p = seen[f"n{r['f']}"], ps[r["j"]]
        if n:
            h = (n - 1) * p
            if not (r["below"] <= math.floor(h) and math.ceil(h) + 1 <= r["below"] + r["inside"]):
                return None
            places.append((r["f"], r["j"], cols[r["f"]], p, h, math.floor(h) + 1, math.ceil(h) + 1, r["below"]))
    table = spark.createDataFrame(places, "f int, j int, feature string, p double, h double, first long, last long, below long")
    found = kept.where("v IS NOT NULL")
    if max((seen[f"n{i}"] for i in values), default=0) > WIDE:
        ranked = group_rank(found, ["f", "j"], ["v"], rank_col="upto", weight_col="n", hash_ordered=False)
    else:
        ranked = found.withColumn("upto", F.sum("n").over(Window.partitionBy("f", "j").orderBy("v")))
    ranked = ranked.join(F.broadcast(table), ["f", "j"])

    def at(rank):
        return F.max(F.when((F.col("below") + F.col("upto") - F.col("n") < F.col(rank)) & (F.col(rank) <= F.col("below") + F.col("upto")), F.col("v")))
    out = ranked.groupBy("feature", "p", "h", "first").agg(at("first").alias("a"), at("last").alias("b"))
    return out.select("feature", "p", (F.col("a") + (F.col("h") - (F.col("first") - 1)) * (F.col("b") - F.col("a"))).alias("value"))
