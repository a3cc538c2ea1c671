"""Broadcasting of per-class / per-feature side tables behind a checked size.

Data rows often join a table with one row per class (counts, centroids, needs).  The
label can be a hot key (three classes: a third of the rows each), so a shuffle join on
it would put a whole class in one task.  The side table is written once into the shared
checkpoint folder; its count and the join read that one copy, so nothing stays cached and a
later query sees the input as it is then.  It is broadcast while its rows, at the width that
their types have, stay within ``max_bytes``; a larger one is joined by shuffle, where
adaptive skew joins split a hot label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.session import cut_lineage

MAX_BROADCAST_BYTES = 64 << 20
#: bytes of a value: fixed widths, and what a label or name may take
_WIDTH = {T.StringType: 64, T.ArrayType: 1024, T.MapType: 1024}


def row_bytes(df: DataFrame) -> int:
    return 16 + sum(_WIDTH.get(type(f.dataType), 16) for f in df.schema.fields)


def small_side(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() * row_bytes(kept) <= max_bytes else kept
