"""Exact deduplication by content sort (DataFrame functions only).

Rows are range-partitioned by sampled splitters over the start of the normalised bytes,
their SHA-256 and a slice number, sorted externally so that equal texts are adjacent, and
neighbours are compared over their full normalised bytes; the best row of a run stays.

Splitters hold 16 characters and a digest, never a whole text, so the sample that reaches
the driver is small however long the documents are.

A group of copies that would fill a task alone is cut into slices.  Such groups are found
by a map-side combined count per digest; at most four of them fit per shuffle partition by
construction, so the table of hot groups (digest, size, best row) is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import ROW, packed, shuffle_partitions, text_of, unpacked, without_spaces


def _best(n, i):
    """Order of preference as one struct: most code points, then smallest id, NULL ids last."""
    return F.struct((-n).alias("neg"), i.isNull().alias("no_id"), i.alias("id"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: Sequence[str] | None = None) -> DataFrame:
    """One row per input row: the columns ``carry`` (default: the id) and ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; NULL counts as
    empty, and all empty texts are equal.  Of equal texts the row with the most code points
    in its original text stays, then the smallest id (a NULL id comes last).  Of rows that
    agree in text, length and id, exactly one is ``kept``.  An empty table gives an empty
    result.  Columns of ``carry`` that are named like a result column are left out.
    """
    out = ["keep_id", "group_size", "kept", "text_sha256"]
    carry = [c for c in (carry or [id_col]) if c not in out]
    text = text_of(f"`{text_col}`")
    whole = text_col in carry  # the text travels anyway: normalise it again behind the shuffle
    keyed = docs.select(packed(docs, carry), F.col(f"`{id_col}`").alias("__tw_id"),
                        F.length(text).alias("__tw_n"), without_spaces(text).alias("__tw_norm"))
    keyed = keyed.withColumn("__tw_sha", F.unhex(F.sha2("__tw_norm", 256)))

    parts = shuffle_partitions(docs.sparkSession)
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    rows, size = max(1, total["n"] // (2 * parts)), max(1, (total["b"] or 0) // (2 * parts))
    hot = (keyed.groupBy(F.col("__tw_sha").alias("__tw_hot"))
           .agg(F.count(F.lit(1)).alias("__tw_cnt"), F.sum(F.octet_length("__tw_norm")).alias("__tw_bytes"),
                F.min(_best(F.col("__tw_n"), F.col("__tw_id"))).alias("__tw_top"))
           .where((F.col("__tw_cnt") > 1) & ((F.col("__tw_cnt") > rows) | (F.col("__tw_bytes") > size)))
           .withColumn("__tw_slices", F.least(F.col("__tw_cnt"), F.ceil(F.greatest(
               F.col("__tw_cnt") / rows, F.col("__tw_bytes") / size))))
           .drop("__tw_bytes"))
    keyed = (keyed.join(F.broadcast(hot), F.col("__tw_sha").eqNullSafe(F.col("__tw_hot")), "left")
             .withColumn("__tw_slice", F.when(F.col("__tw_slices") > 1, F.pmod(
                 F.xxhash64("__tw_id", "__tw_n"), F.col("__tw_slices"))).otherwise(F.lit(0).cast("bigint")))
             .withColumn("__tw_head", F.substring("__tw_norm", 1, 16))
             .drop("__tw_hot", "__tw_slices"))
    if whole:
        keyed = keyed.drop("__tw_norm")
    dealt = keyed.repartitionByRange("__tw_head", "__tw_sha", "__tw_slice")
    if whole:
        dealt = dealt.withColumn("__tw_norm", without_spaces(text_of(F.col(f"{ROW}.`{text_col}`"))))
    run = Window.partitionBy("__tw_head", "__tw_sha", "__tw_slice", "__tw_norm")
    order = [F.col("__tw_n").desc(), F.col("__tw_id").asc_nulls_last()]
    ranked = (dealt.withColumn("__tw_rn", F.row_number().over(run.orderBy(*order)))
              .withColumn("__tw_first", F.first(_best(F.col("__tw_n"), F.col("__tw_id"))).over(run.orderBy(*order)))
              .withColumn("__tw_size", F.count(F.lit(1)).over(run)))
    best = F.coalesce(F.col("__tw_top"), F.col("__tw_first"))
    kept = ((F.col("__tw_rn") == 1) & best["id"].eqNullSafe(F.col("__tw_id")) & (best["neg"] == -F.col("__tw_n")))
    return ranked.select(*unpacked(carry), best["id"].alias("keep_id"),
                         F.coalesce(F.col("__tw_cnt"), F.col("__tw_size")).alias("group_size"),
                         kept.alias("kept"), F.lower(F.hex("__tw_sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs`` in their order.  Columns named like a
    result of ``mark_copies`` pass through under a neutral name and come back unchanged."""
    names = {c: f"__tw_c{i}" for i, c in enumerate(docs.columns)}
    marked = mark_copies(docs.withColumnsRenamed(names), names[id_col], names[text_col], list(names.values()))
    return marked.where("kept").select(*[F.col(v).alias(k) for k, v in names.items()])
