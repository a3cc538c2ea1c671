"""Sequence packing: shortest-pack-first over the length histogram.

A document's ids (and the closing id) are cut into pieces of at most ``length``; only the
histogram of piece lengths, at most ``length`` numbers, reaches the driver.  Lengths are placed
longest first, each onto the shortest packs that still have room.  Packs with the same pattern
are one run of sequence numbers with a count, so that placing a length moves whole runs, and
the plan has as many entries as runs were moved, whatever the number of documents.  Every
entry is an interval of ranks within its length; pieces find theirs by rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialise, packed, ROW, text_of, unpacked
from tidewell.llm.tokenizing import default_vocabulary, encoder, slices
from tidewell.operators.ranking import group_rank

LENGTH = 2048
END_ID = 1


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and,
    if asked for, ``ids`` (little-endian unsigned 32-bit).  Empty and NULL texts have one
    piece, the closing id.  Pieces of ``length`` are cut from the front."""
    spark = docs.sparkSession
    with open(vocabulary or default_vocabulary(), "rb") as f:
        vocab = spark.sparkContext.broadcast(f.read())
    src = docs.select(packed(docs, [id_col]), text_of(f"`{text_col}`").alias("__tw_text"))
    schema = (src.drop("__tw_text").schema.add("start", "long").add("length", "long")
              .add("ids_crc32", "long").add("doc_tokens", "long"))
    if with_ids:
        schema = schema.add("ids", "binary")
    end, step = np.array([end_id], "<u4").tobytes(), 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, z in slices(texts):
                at, start, size, crc, total, ids = [], [], [], [], [], []
                for i, raw in enumerate(enc.encode_many(texts[a:z]), a):
                    raw += end
                    for lo in range(0, len(raw), step):
                        piece = raw[lo:lo + step]
                        at.append(i)
                        start.append(lo // 4)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(raw) // 4)
                        if with_ids:
                            ids.append(piece)
                cols = [batch.column(0).take(pa.array(at, pa.int64())),
                        *[pa.array(x, pa.int64()) for x in (start, size, crc, total)]]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if with_ids else []),
                                                 names=schema.names)

    pieces = src.mapInArrow(run, schema)
    return pieces.select(*unpacked([id_col]), *schema.names[1:])


def shortest_pack_first(histogram: Mapping[int, int], length: int = LENGTH) -> np.ndarray:
    """Rows (piece length, first rank, first sequence, offset), sorted by length and rank: the
    pieces of that length from that rank on go into consecutive sequences at that offset."""
    room: list[list[list[int]]] = [[] for _ in range(length + 1)]  # by space left: runs [first sequence, count]
    plan, used, widest = [], 0, 0
    for size in sorted((k for k, n in histogram.items() if n), reverse=True):
        left, rank = histogram[size], 0
        while left:
            while widest >= size and not room[widest]:
                widest -= 1
            if widest < size:  # no pack has room: open new ones
                plan.append((size, rank, used, 0))
                room[length - size].append([used, left])
                used, widest, left = used + left, max(widest, length - size), 0
                break
            first, count = room[widest].pop()
            take = min(count, left)
            plan.append((size, rank, first, length - widest))
            if take < count:
                room[widest].append([first + take, count - take])
            room[widest - size].append([first, take])
            rank, left = rank + take, left - take
    return np.array(sorted(plan), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``token_pieces`` with ``sequence_id`` (from 0, without gaps) and
    ``offset`` (gapless from 0 in each sequence).

    Rows that share an id are separate documents with the same pieces; ties in length are
    ordered by a hash.  An empty table gives an empty result."""
    pieces = materialise(token_pieces(docs, id_col, text_col, length, end_id, vocabulary, with_ids)
                         .withColumnRenamed(id_col, "__tw_id"), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = shortest_pack_first(histogram, length)
    shift = 1 << 40
    table = docs.sparkSession.sparkContext.broadcast((plan[:, 0] * shift + plan[:, 1], plan[:, 1:]))

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, rows = table.value
        at = np.searchsorted(keys, size.to_numpy() * shift + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": rows[at, 1] + rank.to_numpy() - rows[at, 0], "offset": rows[at, 2]})

    hashed = pieces.withColumn("__h_piece", F.md5(F.concat_ws(":", F.coalesce(F.col("__tw_id").cast("string"), F.lit("")),
                                                            F.col("start").cast("string"))))
    ranked = group_rank(hashed, ["length"], ["__h_piece", "ids_crc32"], rank_col="__tw_rank")
    placed = ranked.withColumn("__tw_at", place("length", F.col("__tw_rank") - 1))
    keep = ["start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if with_ids else [])
    return placed.select(F.col("__tw_id").alias(id_col), *keep, "__tw_at.sequence_id", "__tw_at.offset")


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): whole sequences from ``pack(..., with_ids=True)``, padded to
    ``length`` unless their size is a power of two."""
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"),
                                             F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = np.array([pad_id], "<u4").tobytes()
    exact = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    missing = F.when(exact, F.lit(0)).otherwise(F.lit(length) - F.col("n_tokens")).cast("int")
    return rows.select("sequence_id", "n_tokens", F.concat(joined, F.unhex(F.repeat(F.lit(pad.hex()), missing))).alias("ids"))
