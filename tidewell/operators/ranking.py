"""Exact per-group row numbers without a hot partition.

``row_number() OVER (PARTITION BY label ORDER BY ...)`` sends a whole class to
one task; with three classes, a third of the table lands in one task.  Here
every row gets a *slice* number that is a pure function of its order key and
never decreases along the order.  Rows are numbered inside (group, slice) —
many small windows — and a tiny table of per-(group, slice) counts gives every
slice its offset.

Slices come from the order key itself, never from ``spark_partition_id``:
a value derived from the row is the same in every branch of a plan and after
any recomputation (Spark's range partitioner seeds its sample by RDD id, so two
branches over one range shuffle can disagree).

* hash orders (the first order column is 32 hex chars of md5): the slice is the
  hash prefix scaled to ``partitions`` — uniform, no sampling pass;
* other orders: ``partitions - 1`` bounds on the whole order key, picked from a
  seeded sample (at most ``partitions × 32`` rows reach the driver), in two
  levels so a row is compared with about 2·√partitions bounds.  The order key
  ends in a unique id, so even one value shared by a third of the rows is cut
  into many slices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "__tw_slice"
LOCAL_RN = "__tw_local_rn"
OFFSET = "__tw_offset"


def default_partitions(df: DataFrame) -> int:
    try:
        return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # pragma: no cover
        return 200


def _hash_slice(h: Column, parts: int) -> Column:
    # first 8 hex digits → [0, 2^32), scaled to [0, parts): monotone in the hash text
    return F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("double") * parts / 4294967296.0).cast("int")


def _sample_bounds(df: DataFrame, names: list[str], parts: int, seed: int = 42) -> list[tuple]:
    n = df.count()
    if n == 0 or parts <= 1:
        return []
    frac = min(1.0, parts * 32.0 / n)
    rows = df.select(*names).sample(False, frac, seed).collect()
    keys = sorted((tuple(r) for r in rows), key=_sort_key)
    if not keys:
        return []
    step = len(keys) / parts
    out = []
    for i in range(1, parts):
        b = keys[min(len(keys) - 1, int(i * step))]
        if not out or _sort_key(b) > _sort_key(out[-1]):
            out.append(b)
    return out


def _sort_key(t):
    # Spark ascending order: NULLs first; strings by code point (= UTF-8 byte order)
    return tuple((0, 0) if v is None else (1, v) for v in t)


def _struct_lit(b, names, types):
    return F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(b, names, types)])


def _bounded_slice(df: DataFrame, names: list[str], bounds: list[tuple]) -> Column:
    """slice = number of bounds ≤ key, searched in two levels (coarse, then fine)."""
    if not bounds:
        return F.lit(0)
    types = [df.schema[n].dataType.simpleString() for n in names]
    arr_type = "array<struct<" + ",".join(f"{n}:{t}" for n, t in zip(names, types)) + ">>"
    key = F.struct(*[F.col(n).alias(n) for n in names])
    width = max(1, int(math.sqrt(len(bounds))))
    coarse = bounds[width - 1::width]
    coarse_arr = F.array(*[_struct_lit(b, names, types) for b in coarse])
    ci = F.size(F.filter(coarse_arr, lambda b: b <= key))
    # fine bounds of coarse bucket g: those strictly between coarse g-1 and coarse g
    fine = []
    for g in range(len(coarse) + 1):
        lo = g * width
        hi = min(len(bounds), lo + width - 1) if g < len(coarse) else len(bounds)
        fine.append(F.array(*[_struct_lit(b, names, types) for b in bounds[lo:hi]]) if hi > lo
                    else F.array().cast(arr_type))
    fi = F.size(F.filter(F.element_at(F.array(*fine), ci + 1), lambda b: b <= key))
    return (ci * width + fi).cast("int")


def group_rank(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
               rank_col: str = "rn", count_col: str | None = None,
               partitions: int | None = None, hash_ordered: bool | None = None,
               weight_col: str | None = None, extra_sums: Sequence[str] = (),
               materialize: bool = False) -> DataFrame:
    """Add ``rank_col`` = 1-based row number within ``group_cols`` by ascending
    ``order_cols`` (column names forming a total order, e.g. ending in a unique id),
    and optionally ``count_col`` = group size.  With ``weight_col`` the rank is the
    running sum of the weights (inclusive) and the size is the total weight.  Each column
    ``w`` of ``extra_sums`` adds ``cum_<w>`` (inclusive running sum in the same order) and
    ``tot_<w>`` (group total).  ``materialize`` checkpoints the input first, for inputs
    that are expensive to recompute (the sample, the numbering and the slice counts
    each read it)."""
    parts = partitions or default_partitions(df)
    if materialize:
        from tidewell.session import cut_lineage
        df = cut_lineage(df)
    groups = list(group_cols)
    order = list(order_cols)
    if hash_ordered is None:
        first = df.schema[order[0]]
        hash_ordered = first.dataType.simpleString() == "string" and order[0].startswith("__h")
    if hash_ordered:
        tagged = df.withColumn(SLICE, _hash_slice(F.col(order[0]), parts))
    else:
        bounds = _sample_bounds(df, order, parts)
        tagged = df.withColumn(SLICE, _bounded_slice(df, order, bounds))
    w_local = Window.partitionBy(*groups, SLICE).orderBy(*order)
    w_run = w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if weight_col:
        numbered = tagged.withColumn(LOCAL_RN, F.sum(F.col(weight_col)).over(w_run))
        slice_aggs = [F.sum(F.col(weight_col)).alias("__tw_n")]
    else:
        numbered = tagged.withColumn(LOCAL_RN, F.row_number().over(w_local))
        slice_aggs = [F.count(F.lit(1)).alias("__tw_n")]
    extra = list(extra_sums)
    numbered = numbered.withColumns({f"__tw_l_{w}": F.sum(F.col(w)).over(w_run) for w in extra})
    slice_aggs += [F.sum(F.col(w)).alias(f"__tw_s_{w}") for w in extra]
    # slice totals: a second, column-pruned read of the input (group and order columns
    # only) with map-side partial aggregation, so only (group, slice) counts shuffle
    slices = tagged.groupBy(*groups, SLICE).agg(*slice_aggs)
    w_cum = Window.partitionBy(*groups).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*groups)
    offsets = slices.withColumn(OFFSET, F.coalesce(F.sum("__tw_n").over(w_cum), F.lit(0)))
    offsets = offsets.withColumns({f"__tw_o_{w}": F.coalesce(F.sum(f"__tw_s_{w}").over(w_cum), F.lit(0))
                                   for w in extra})
    offsets = offsets.withColumns({f"tot_{w}": F.sum(f"__tw_s_{w}").over(w_all) for w in extra})
    if count_col:
        offsets = offsets.withColumn(count_col, F.sum("__tw_n").over(w_all))
    offsets = offsets.drop("__tw_n", *[f"__tw_s_{w}" for w in extra])
    # NULL groups are groups too: join null-safely on renamed copies
    ren = {g: f"__tw_g{i}" for i, g in enumerate(groups)}
    ren[SLICE] = SLICE + "_o"
    offsets = offsets.withColumnsRenamed(ren)
    cond = [F.col(SLICE) == F.col(SLICE + "_o")] + [F.col(g).eqNullSafe(F.col(ren[g])) for g in groups]
    out = (numbered.join(offsets, on=cond, how="inner")
                   .withColumn(rank_col, (F.col(OFFSET) + F.col(LOCAL_RN)).cast("bigint")))
    out = out.withColumns({f"cum_{w}": F.col(f"__tw_o_{w}") + F.col(f"__tw_l_{w}") for w in extra})
    return out.drop(SLICE, LOCAL_RN, OFFSET, *ren.values(), *[f"__tw_o_{w}" for w in extra],
                    *[f"__tw_l_{w}" for w in extra])


def group_counts(df: DataFrame, group_cols: Sequence[str], count_col: str = "n") -> DataFrame:
    """Rows per group (map-side partial aggregation, no window)."""
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias(count_col))
