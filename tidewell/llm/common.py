"""Small helpers shared by the training-data operators.

Internal columns start with ``__tw_``; payload columns travel inside one struct
(``__tw_row``), so input columns of any other name never clash with them.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import ensure_checkpoint_dir

ROW = "__tw_row"
#: the white space of every contract here: space and U+0009 to U+000D
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

_written: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, NULL as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def without_spaces(col: Column) -> Column:
    """``col`` without ``[\\x20\\x09-\\x0D]`` (byte-level replacements, no regular expression)."""
    for ch in SPACES:
        col = F.replace(col, F.lit(ch), F.lit(""))
    return col


def crc32_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (NULL id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def packed(df: DataFrame, cols) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in cols]).alias(ROW)


def unpacked(cols) -> list[Column]:
    return [F.col(f"{ROW}.`{c}`").alias(c) for c in cols]


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the checkpoint folder, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidewell-{label}-{uuid.uuid4().hex}"


def scratch_folder(spark: SparkSession, label: str) -> str:
    """As ``shared_folder``, deleted with the tables of ``materialise``."""
    path = shared_folder(spark, label)
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, lost
    executors cost nothing, and later readers prune columns.  Deleted when Python ends."""
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of this process that no later step reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remove_written() -> None:
    """Delete every table that ``materialise`` wrote in this process."""
    while _written:
        spark, path = _written.pop()
        try:
            discard(spark, path)
        except Exception:  # the session may be gone already
            continue


atexit.register(remove_written)


def shuffle_partitions(spark: SparkSession) -> int:
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except ValueError:
        return 200
