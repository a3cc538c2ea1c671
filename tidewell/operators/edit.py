"""Set operations and edits.

A change set is a long table (op, id, col, value[, seq]): ``op`` is 'edit', 'delete' or
'add'; values are text and are cast to the target column's type, and a NULL value blanks
the cell.  Of several changes of one cell the last by ``seq`` counts (without ``seq``, the
greatest value, so that reruns agree).  Edits apply first, then deletes, then additions —
one plan: a pivot of the edits joined by key, an anti join for the deletes, a union for the
additions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import c
from tidewell.spec import q


def append_rows(*dfs: DataFrame) -> DataFrame:
    """Stack by column name; missing columns become NULL; duplicates kept."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def union_keep(confident: DataFrame, pool: DataFrame, classes: Sequence[str], label_col: str = "label",
               id_col: str = "id", dedupe: bool = False) -> DataFrame:
    """Confident rows plus every pool row of the chosen classes; a row in both sets
    appears twice unless ``dedupe`` (then the first by key is kept)."""
    out = confident.unionByName(pool.filter(c(label_col).isin(*classes)))
    return out.dropDuplicates([id_col]) if dedupe else out


def _last_change(changes: DataFrame):
    """The winning change of a cell as a struct: present means changed, even to NULL."""
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    return F.max(F.struct(seq.alias("seq"), F.col("value").isNotNull().alias("set"), F.col("value").alias("value")))


def apply_changes(df: DataFrame, changes: DataFrame, id_col: str = "id") -> DataFrame:
    """Edits, then deletes, then additions from a long change table."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cols = [x for x in df.columns if x != id_col]
    edits = changes.filter(F.col("op") == "edit")
    wide = (edits.groupBy(F.col("id").alias("__eid")).pivot("col", cols)
                 .agg(_last_change(changes)))
    wide = wide.select("__eid", *[F.col(q(x)).alias(f"__e_{i}") for i, x in enumerate(cols)])
    j = df.join(wide, df[q(id_col)].cast("string") == wide["__eid"], "left")
    edited = j.select(c(id_col), *[F.when(F.col(f"__e_{i}").isNotNull(), F.col(f"__e_{i}.value").cast(types[x]))
                                   .otherwise(c(x)).alias(x) for i, x in enumerate(cols)])
    dels = changes.filter(F.col("op") == "delete").select(F.col("id").alias("__did"))
    kept = edited.join(dels, edited[q(id_col)].cast("string") == dels["__did"], "left_anti")
    adds = changes.filter(F.col("op") == "add")
    added = (adds.groupBy("id").pivot("col", cols).agg(_last_change(changes)))
    added = added.select(F.col("id").cast(types[id_col]).alias(id_col),
                         *[F.col(q(x))["value"].cast(types[x]).alias(x) for x in cols])
    return kept.unionByName(added)


def align_columns(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Full outer join on the key (column-wise concatenation on an equal index)."""
    return left.join(right, on=key, how="full_outer")


def select_columns(df: DataFrame, cols: Sequence[str], label_col: str = "label", id_col: str = "id") -> DataFrame:
    """The key, the listed features and the label."""
    keep = [id_col] + [x for x in cols if x not in (id_col, label_col)] + [label_col]
    return df.select(*[c(x) for x in keep if x in df.columns])


def select_rows(df: DataFrame, ids: Sequence[str] | DataFrame, cols: Sequence[str] | None = None, id_col: str = "id") -> DataFrame:
    """P10: rows picked by key (and optionally some columns) for an ad-hoc summary.  ``ids`` is a
    list or a table with the key column; either way a semi join picks the rows."""
    if not isinstance(ids, DataFrame):
        ids = df.sparkSession.createDataFrame([(i,) for i in ids], "__id string").select(F.col("__id").cast(df.schema[id_col].dataType).alias("__id"))
    else:
        ids = ids.select(c(id_col).alias("__id"))
    out = df.join(ids, c(id_col) == F.col("__id"), "left_semi")
    return out.select(c(id_col), *[c(x) for x in cols]) if cols else out
