"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride shards.

Texts are tokenised once and cut into sequences of ``length`` ids, partition by partition
(only the last sequence of an input partition is padded).  A keyed Feistel permutation of the
sequence numbers, restricted to their count by cycle-walking, gives every sequence a global
slot without sorting by a random key or a table of permuted numbers.  Slots are dealt by range:
shard k holds the slots from k × ``per_shard`` on, in order, each as one record of the same
size, so that slot s starts at byte (s mod per_shard) × stride of its shard's only file.

Sequences are kept compressed until a record is written.  Spark's own text writer writes the records (a binary value, then the one-byte separator), so
files appear through its commit protocol on any file system, and a retried task writes the
same bytes again.

Record: sequence number (u64), tokens that are not padding (u32), magic (u32), ids
(``length`` × u16 or u32, little-endian), separator.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import materialise, text_of
from tidewell.llm.tokenizing import default_vocabulary, encoder, text_slices

LENGTH, END_ID, PAD_ID = 2048, 1, 0
PER_SHARD = 2048
KEY = 0x5EED
ROUNDS = 8
MAGIC = 0x54574431
HEAD = np.dtype([("sequence", "<u8"), ("tokens", "<u4"), ("magic", "<u4")])


# ---- permutation ----------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift), wrapping."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel_slots(numbers: np.ndarray, count: int, key: int = KEY, rounds: int = ROUNDS,
                  inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..count-1 at ``numbers``.  A balanced Feistel network permutes
    the next even power of two; results outside the range walk on until they are inside."""
    half = np.uint64(max(1, (max(count - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _mix(np.uint64(key) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if inverse:
        keys = keys[::-1]

    def once(x):
        left, right = x >> half, x & mask
        if inverse:
            left, right = right, left
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        if inverse:
            left, right = right, left
        return (left << half) | right

    out = once(np.asarray(numbers).astype(np.uint64))
    away = np.flatnonzero(out >= count)
    while len(away):
        out[away] = once(out[away])
        away = away[out[away] >= count]
    return out.astype(np.int64)


# ---- sequences ------------------------------------------------------------------------

def id_width(vocabulary_size: int) -> int:
    return 2 if vocabulary_size <= 1 << 16 else 4


def token_sequences(docs: DataFrame, text_col: str = "text", length: int = LENGTH, end_id: int = END_ID,
                    pad_id: int = PAD_ID, vocabulary: str | None = None) -> DataFrame:
    """(part, at, n_tokens, ids): the sequences of every input partition, numbered from 0;
    ``ids`` are compressed (zstd).

    Every text is followed by ``end_id``; an empty or NULL text is that id alone.  Memory per
    task: one slice of texts and one open sequence."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        raw = f.read()
    vocab = docs.sparkSession.sparkContext.broadcast(raw)
    kind = f"<u{id_width(encoder(raw).tok.get_vocab_size())}"
    src = docs.select(F.spark_partition_id().alias("part"), text_of(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, open_ids, at, part = encoder(vocab.value), np.empty(0, kind), 0, None
        end, press = np.array([end_id], "<u4").tobytes(), zstandard.ZstdCompressor(level=3).compress

        def rows(block, tokens):
            n = len(block)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)),
                 pa.array(tokens, pa.int32()), pa.array([press(r.tobytes()) for r in block], pa.binary())],
                names=["part", "at", "n_tokens", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            for _, texts in text_slices(batch.column(1)):
                ids = np.frombuffer(end.join(enc.encode_many(texts)) + end, "<u4").astype(kind)
                open_ids = np.concatenate([open_ids, ids])
                full = len(open_ids) // length
                if full:
                    yield rows(open_ids[:full * length].reshape(full, length), [length] * full)
                    at, open_ids = at + full, open_ids[full * length:]
        if len(open_ids):
            last = np.concatenate([open_ids, np.full(length - len(open_ids), pad_id, kind)])
            yield rows(last[None, :], [len(open_ids)])

    return src.mapInArrow(run, "part int, at long, n_tokens int, ids binary")


def write_training_order(docs: DataFrame, path: str, text_col: str = "text", length: int = LENGTH,
                         per_shard: int = PER_SHARD, key: int = KEY, end_id: int = END_ID,
                         pad_id: int = PAD_ID, vocabulary: str | None = None) -> dict:
    """Write the shards below ``path`` (``shard=k/`` folders of one file each); returns
    ``{"sequences", "length", "width", "stride", "per_shard"}``, what a reader needs.

    An empty table writes an empty folder.  Input columns other than the text play no part."""
    spark = docs.sparkSession
    made = materialise(token_sequences(docs, text_col, length, end_id, pad_id, vocabulary), "sequences")
    sizes = {r["part"]: r["n"] for r in made.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(sizes)
    before = dict(zip(order, np.cumsum([0, *[sizes[p] for p in order]]).tolist()))
    count = sum(sizes.values())
    with open(vocabulary or default_vocabulary(), "rb") as f:
        width = id_width(encoder(f.read()).tok.get_vocab_size())
    shape = {"sequences": count, "length": length, "width": width, "per_shard": per_shard,
             "stride": HEAD.itemsize + width * length + 1}
    starts = spark.sparkContext.broadcast(before)

    @F.pandas_udf("number long, slot long")
    def place(part: pd.Series, at: pd.Series) -> pd.DataFrame:
        number = at.to_numpy() + part.map(starts.value).to_numpy()
        return pd.DataFrame({"number": number, "slot": feistel_slots(number, count, key)})

    @F.pandas_udf("binary")
    def record(number: pd.Series, tokens: pd.Series, ids: pd.Series) -> pd.Series:
        open_ids = zstandard.ZstdDecompressor().decompress
        head = np.zeros(len(number), HEAD)
        head["sequence"], head["tokens"], head["magic"] = number.to_numpy(), tokens.to_numpy(), MAGIC
        return pd.Series([h.tobytes() + open_ids(i) for h, i in zip(head, ids)])

    placed = made.select("n_tokens", "ids", place("part", "at").alias("r")).select("n_tokens", "ids", "r.*")
    shards = max(1, -(-count // per_shard))
    # a shard's number is its partition's: no pass over all slots to find bounds for a range
    (placed.withColumn("shard", (F.col("slot") / per_shard).cast("long"))
     .repartitionById(shards, F.col("shard").cast("int"))
     .select("shard", "slot", record("number", "n_tokens", "ids").cast("string").alias("value"))
     .sortWithinPartitions("shard", "slot").select("shard", "value")
     .write.partitionBy("shard").option("lineSep", "\n").text(path))
    return shape


# ---- reading --------------------------------------------------------------------------

def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """(shard, content): one row per shard file, of at most per_shard × stride bytes."""
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"shard=(\d+)", 1).cast("long").alias("shard"), "content")


def _records(content: bytes, shape: dict) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(content, np.uint8).reshape(-1, shape["stride"])
    head = rows[:, :HEAD.itemsize].copy().view(HEAD).reshape(-1)
    if (head["magic"] != MAGIC).any() or (rows[:, -1] != 10).any():
        raise ValueError("not a whole number of fixed-stride records")
    return head, rows[:, HEAD.itemsize:-1]


def read_slots(spark: SparkSession, path: str, shape: dict, first: int = 0) -> Iterator[tuple[int, int, np.ndarray]]:
    """(slot, sequence, ids without padding) from slot ``first`` on, one shard in memory at a
    time: a training run resumes from the number of slots it has consumed."""
    size = shape["per_shard"]
    for shard in range(first // size, -(-shape["sequences"] // size)):
        content = shard_files(spark, f"{path}/shard={shard}").first()["content"]
        head, ids = _records(bytes(content), shape)
        for i in range(max(0, first - shard * size), len(head)):
            yield (shard * size + i, int(head["sequence"][i]),
                   ids[i].copy().view(f"<u{shape['width']}")[:int(head["tokens"][i])])


def slot_digests(spark: SparkSession, path: str, shape: dict) -> DataFrame:
    """(slot, shard, sequence, n_tokens, ids_crc32), read back from the written shards."""
    schema = "slot long, shard long, sequence long, n_tokens long, ids_crc32 long"
    if not shape["sequences"]:
        return spark.createDataFrame([], schema)
    size, width = shape["per_shard"], shape["width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column(0)[i].as_py()
                head, ids = _records(batch.column(1)[i].as_py(), shape)
                n = len(head)
                crc = [zlib.crc32(r[:width * t].tobytes()) for r, t in zip(ids, head["tokens"].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (np.arange(n) + shard * size, np.full(n, shard),
                                                       head["sequence"].astype(np.int64), head["tokens"].astype(np.int64), crc)],
                    names=["slot", "shard", "sequence", "n_tokens", "ids_crc32"])

    return shard_files(spark, path).mapInArrow(run, schema)
