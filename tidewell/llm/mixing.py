"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Every source has a mean repetition rate: its target share of the output over what it has.
A document's number of copies is the inverse of the Poisson distribution with that mean at a
uniform number hashed from (seed, document id), so that a rerun, a retry or another
partitioning draws the same copies.  Copies are exploded and put into a global random order
by a range shuffle on a hash of (seed, document id, copy number).

Rates above ``PART`` are drawn as a sum of independent Poisson parts, so that the inverted
table of a source stays below about a hundred entries.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import text_of

PART = 16.0
SEED = 20240
#: exponent of the default weights: a source weighs its size to this power
FLATTEN = 0.5
#: a table of rates up to this many sources (a hundred numbers each) is broadcast
BROADCAST_SOURCES = 10_000


def repetition_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, source_col: str = "source",
                     text_col: str = "text", total: float | None = None) -> DataFrame:
    """(source, rate): mean copies per document, so that the expected characters of a source are
    its share of ``weights`` times ``total`` (default: the characters there are).

    ``weights`` None: each source weighs its size to the power ``FLATTEN``.  A source that
    ``weights`` does not name gets rate 0.  NULL is a source like any other (weighted by
    ``weights[None]``).  A source without any character keeps its rows (rate 1)."""
    size = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(
        F.sum(F.length(text_of(f"`{text_col}`"))).cast("double").alias("size"))
    if weights is None:
        size = size.withColumn("w", F.pow("size", F.lit(FLATTEN)))
    else:
        rows = [(k, float(v)) for k, v in weights.items()]
        given = docs.sparkSession.createDataFrame(rows, "k string, w double")
        size = (size.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("k")), "left").drop("k")
                .withColumn("w", F.coalesce("w", F.lit(0.0))))
    whole = size.agg(F.sum("w").alias("ws"), F.sum("size").alias("ss")).first()
    ws, ss = whole["ws"] or 1.0, (total if total is not None else whole["ss"]) or 0.0
    rate = F.col("w") / F.lit(ws) * F.lit(float(ss)) / F.col("size")
    return size.select("source", F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))


def _cumulative(rate):
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, up to where nothing is left in doubles."""
    p0 = F.exp(-rate)
    start = F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("a"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.array_append(acc["a"], acc["c"] + p).alias("a"))
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    return F.aggregate(F.sequence(F.lit(1), last), start, step)["a"]


def _uniform(*parts):
    """52 bits of an md5 as a number in (0, 1)."""
    h = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def poisson_copies(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                   seed: int = SEED) -> DataFrame:
    """``docs`` with ``copies``, the number of copies of each row (0 and up)."""
    table = rates.select(F.col("source").alias("__tw_src"), F.col("rate").alias("__tw_rate"),
                         F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int").alias("__tw_parts"))
    table = table.withColumn("__tw_cdf", _cumulative(F.col("__tw_rate") / F.col("__tw_parts")))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    joined = docs.join(table, F.col(f"`{source_col}`").eqNullSafe(F.col("__tw_src")))
    draw = F.transform(F.sequence(F.lit(0), F.col("__tw_parts") - 1),
                       lambda part: F.size(F.filter("__tw_cdf", lambda c: c < _uniform(
                           F.lit(seed), F.col(f"`{id_col}`"), part))))
    return (joined.withColumn("copies", F.aggregate(draw, F.lit(0), lambda a, b: a + b))
            .drop("__tw_src", "__tw_rate", "__tw_parts", "__tw_cdf"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id",
        source_col: str = "source", text_col: str = "text", total: float | None = None,
        seed: int = SEED) -> DataFrame:
    """The mixed rows in their global random order: the columns of ``docs``, ``copy`` (from 1)
    and ``shuffle_key``, by which partitions and the rows in them are ordered.

    Rows that share an id draw the same number of copies.  NULL ids draw as the empty text,
    NULL and empty texts count no characters.  Columns named ``copy``, ``copies`` or
    ``shuffle_key`` are replaced.  An empty table gives an empty result."""
    own = docs.drop("copy", "copies", "shuffle_key")
    rates = repetition_rates(own, weights, source_col, text_col, total)
    copies = poisson_copies(own, rates, id_col, source_col, seed).where("copies > 0")
    rows = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    key = F.md5(F.concat_ws(":", F.lit("order"), F.lit(str(seed)),
                            F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col("copy").cast("string")))
    return (rows.withColumn("shuffle_key", key).repartitionByRange("shuffle_key")
            .sortWithinPartitions("shuffle_key"))
