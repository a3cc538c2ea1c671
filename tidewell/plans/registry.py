"""Named queries over the driver's tables, each with its DuckDB oracle text when one exists.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.
Floating outputs are rounded to 6 places on both sides; integer counts are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every floating column; cast integer-like columns to BIGINT."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(F.round(col.cast("double"), places).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(col.cast("bigint").alias(f.name))
        else:
            out.append(col)
    return df.select(*out)


def rsel(doubles, others=(), source="t", places: int = 6) -> str:
    """``SELECT others..., round(d, 6) AS d ... FROM source`` for oracle texts."""
    cols = [f'"{o}"' for o in others] + [f'round(CAST("{d}" AS DOUBLE), {places}) AS "{d}"' for d in doubles]
    return "SELECT " + ", ".join(cols) + f" FROM {source}"


def load_all() -> None:
    """Import the modules that register queries."""
    from tidewell.plans import queries_core, queries_eval, queries_models, queries_prep  # noqa: F401
