"""Readers and writers (S1–S4).  Paths may be local or any Hadoop file system."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def read_table(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None,
               key: str | None = None, key_name: str = "id", overrides: dict[str, str] | None = None) -> DataFrame:
    """A CSV (header row; first column = key unless ``key`` names one) or Parquet table.

    The key becomes a STRING column ``key_name``; a UTF-8 byte-order mark on the
    first header is stripped; ``overrides`` casts named columns (e.g. an id-like
    number kept as text); NaN cells are read as NULL.  An explicit ``schema`` avoids inference on big inputs."""
    if fmt == "csv":
        r = spark.read.option("header", True).option("encoding", "UTF-8")
        if schema is not None:
            r = r.schema(schema)
        else:
            r = r.option("inferSchema", True)
        df = r.csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    first = df.columns[0]
    if first.startswith(BOM):
        df = df.withColumnRenamed(first, first[len(BOM):])
        first = first[len(BOM):]
    if first.startswith("_c0") or first == "":
        df = df.withColumnRenamed(first, key_name)
        first = key_name
    key = key or first
    df = df.withColumn(key, F.col(f"`{key}`").cast("string"))
    if key != key_name:
        df = df.withColumnRenamed(key, key_name)
    for col, typ in (overrides or {}).items():
        df = df.withColumn(col, F.col(f"`{col}`").cast(typ))
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN cells of floating columns become NULL: every operator knows one kind of missing value."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({x: F.when(~F.isnan(F.col(f"`{x}`")), F.col(f"`{x}`")) for x in floats}) if floats else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Persist a table (splits, leaderboards, importances)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_datasets(spark: SparkSession, directory: str, suffixes=(".csv", ".parquet")) -> DataFrame:
    """S3: (name, path, format) of the data files of a directory (file-system listing)."""
    fs, p = _fs(spark, directory)
    rows = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        for suf in suffixes:
            if name.endswith(suf):
                rows.append((name[: -len(suf)], st.getPath().toString(), suf[1:]))
    return spark.createDataFrame(sorted(rows), "name string, path string, format string")


def register_datasets(spark: SparkSession, directory: str) -> list[str]:
    """S3: register every data file of a directory as a temp view named by its stem."""
    names = []
    for r in list_datasets(spark, directory).collect():
        df = spark.read.parquet(r["path"]) if r["format"] == "parquet" else \
            spark.read.option("header", True).option("inferSchema", True).csv(r["path"])
        df.createOrReplaceTempView(r["name"])
        names.append(r["name"])
    return names


def load_or_build(spark: SparkSession, train_path: str, test_path: str,
                  build: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Reuse the saved train/test tables when both exist, else build and save them."""
    if exists(spark, train_path) and exists(spark, test_path):
        return spark.read.parquet(train_path), spark.read.parquet(test_path)
    train, test = build()
    write_table(train, train_path)
    write_table(test, test_path)
    return spark.read.parquet(train_path), spark.read.parquet(test_path)
