"""Train/test split, holdout validation and repeated k-fold.

Rows are shuffled by the text order of md5(seed|id[|salt]) — a pure function of
the key, so a recomputed partition assigns the same rows and DuckDB reproduces
the split.  Per-class quotas use the range-partitioned rank, so a class holding
a third of the table is numbered by many tasks, not one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import c, hash_text
from tidewell.operators.ranking import group_rank


def assign_split(df: DataFrame, id_col: str = "id", label_col: str | None = "label",
                 test: float = 0.2, seed: int = 42, salt: str | None = None,
                 out_col: str = "split") -> DataFrame:
    """Add ``split`` ∈ {'train', 'test'}; per class (or overall when ``label_col`` is
    None) the first bround(n·test) rows in hash order are test rows."""
    groups = [label_col] if label_col else []
    keyed = df.withColumn("__h", hash_text(id_col, seed, salt))
    ranked = group_rank(keyed, groups, ["__h", id_col], rank_col="__rn", count_col="__n", hash_ordered=True)
    quota = F.bround(F.col("__n") * F.lit(float(test)))
    return (ranked.withColumn(out_col, F.when(F.col("__rn") <= quota, "test").otherwise("train"))
                  .drop("__h", "__rn", "__n"))


def train_test_split(df: DataFrame, id_col: str = "id", label_col: str | None = "label",
                     test: float = 0.2, seed: int = 42):
    """(train, test).  The split column is computed once; callers that use both sides
    should persist the input (the two filters share its plan)."""
    tagged = assign_split(df, id_col, label_col, test, seed)
    return (tagged.filter(F.col("split") == "train").drop("split"),
            tagged.filter(F.col("split") == "test").drop("split"))


def holdout(df: DataFrame, id_col: str = "id", label_col: str | None = "label",
            fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Internal validation split of a train table (salted so it is independent of T1)."""
    return assign_split(df, id_col, label_col, fraction, seed, salt="val", out_col="subset") \
        .withColumn("subset", F.when(F.col("subset") == "test", "val").otherwise("fit"))


def kfold(df: DataFrame, n_folds: int = 5, repeats: int = 1, id_col: str = "id",
          label_col: str | None = "label", seed: int = 42) -> DataFrame:
    """(id, label, repeat, fold) — within each class and repeat, rows in hash order
    are dealt to folds round robin, so class shares are equal across folds."""
    groups = ([label_col] if label_col else []) + ["repeat"]
    keys = df.select(c(id_col), *( [c(label_col)] if label_col else []))
    rep = keys.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rep = rep.withColumn("__h", hash_text(id_col, seed, F.col("repeat").cast("string")))
    ranked = group_rank(rep, groups, ["__h", id_col], rank_col="__rn", hash_ordered=True)
    return ranked.select(c(id_col), *([c(label_col)] if label_col else []), "repeat",
                         ((F.col("__rn") - 1) % n_folds).cast("bigint").alias("fold"))
