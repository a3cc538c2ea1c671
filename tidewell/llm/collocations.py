"""Phrase collocations by dynamic itemset counting.

The corpus lies in ``SHARDS`` shards that are scanned in a cycle.  One scan counts phrases of all
lengths that are under way: words from the first step on, a longer phrase from the step
after both its subphrases (all but the last word, all but the first) reached the threshold in
what was counted so far.  A phrase is counted in ``SHARDS`` scans in a row, one full cycle, and
so over the whole corpus.

Which subphrases have reached the threshold travels to the scans as a table of fixed size: a
slot per hash holds the step at which the first phrase of the slot reached it, and never
changes again.  A shared slot can only activate a phrase earlier or one more phrase; every
active phrase still gets its full cycle, so all counts are exact.

Counts stay packed: a row is a bucket of phrases of one language and length, sorted and
compressed.  A chunk of texts sends each of its phrases once, with its count, so a phrase
that is in a third of all documents reaches its bucket once per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.blobs import pack_numbers, unpack_numbers, unzipped, zipped
from tidewell.llm.common import discard, materialise, scratch_folder, text_of

LONGEST, LEAST, COVER, TOP, UNIT = 3, 10, 50, 2000, 1_000_000
SHARDS = 3
#: bytes of text in a chunk, and of text behind one bucket of counts
CHUNK, BUCKET = 8 << 20, 24 << 20
#: slots of the table of reached phrases of a length (a byte each)
SLOT_BITS = 24
_BLOCK_BITS = 15
_NEVER = 255
_MOST_PARTITIONS = 1 << 14
#: fixed values: where pieces end, and the other white space between words
PIECE_ENDS, TAB = b".,;:!?\x0a\x0b\x0c\x0d", 9
_STEP = bytes(10 if c in PIECE_ENDS else 32 if c == TAB else c for c in range(256))
_COUNTS = "lang string, bucket int, phrases binary, n binary"


# ---- chunks ---------------------------------------------------------------------------

def normalised(text: bytes) -> bytes:
    """A-Z lower-cased, words parted by spaces, pieces by a word of one line feed."""
    return text.lower().translate(_STEP).replace(b"\n", b" \n ")


def _words(buf: bytes) -> tuple[np.ndarray, pa.Array, int]:
    """(number of each word in sorted order, sorted distinct words, the number of the piece end)."""
    b = np.frombuffer(buf, np.uint8)
    solid = b != 32
    edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
    offsets = np.concatenate([[0], np.cumsum(edges[1::2] - edges[::2])]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                  [None, pa.py_buffer(offsets), pa.py_buffer(b[solid])]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words = coded.dictionary.take(pa.array(order))
    return rank[coded.indices.to_numpy()], words, pc.index(words, b"\n").as_py()


def _shards(docs: DataFrame, text_col: str, lang_col: str, shards: int) -> DataFrame:
    src = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")),
                      text_of(f"`{text_col}`").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def chunk(lang):
            nonlocal number
            number += 1
            buf = b" \n ".join(held.pop(lang))
            row = [number % shards, lang, size.pop(lang), zipped(buf)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.binary()))],
                                              names=["shard", "lang", "size", "texts"])
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = normalised(text.as_py())
                held.setdefault(lang, []).append(t)
                size[lang] = size.get(lang, 0) + len(t)
                if size[lang] >= CHUNK:
                    yield chunk(lang)
                elif sum(size.values()) >= 4 * CHUNK:
                    yield chunk(max(size, key=size.get))
        for lang in list(held):
            yield chunk(lang)

    return src.mapInArrow(run, "shard int, lang string, size long, texts binary")


# ---- scans ----------------------------------------------------------------------------

def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _joined_hash(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all but its last word and that word's."""
    return _mixed(head * np.uint64(0xD6E8FEB86659FD93) + word)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _phrase_hashes(phrases: list[bytes]) -> np.ndarray:
    parts = [p.split(b" ") for p in phrases]
    flat = _word_hashes([w for p in parts for w in p]).reshape(len(parts), -1) if parts else np.zeros((0, 1), np.uint64)
    out = flat[:, 0]
    for k in range(1, flat.shape[1]):
        out = _joined_hash(out, flat[:, k])
    return out


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang))


def _slot(h: np.ndarray, lang: str) -> np.ndarray:
    return (_mixed(h + _lang_hash(lang)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _bucketed(lang: str, length: int, words: pa.Array, parts: list[np.ndarray], n: np.ndarray, h: np.ndarray,
              buckets: int) -> Iterator[tuple]:
    """(length, lang, bucket, phrases, counts): phrases stay in sorted order inside a bucket."""
    bucket = (h % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    columns = [words.take(pa.array(p[by])) for p in parts]
    text = columns[0] if length == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary()))
    yield from _packed_ranges(lang, length, text, n[by], bucket[by])


def _packed_ranges(lang, length, text: pa.Array, n, bucket) -> Iterator[tuple]:
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if not len(n):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4)
    data = text.buffers()[2]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        raw = data[int(offsets[a]):int(offsets[z])].to_pybytes()
        yield length, lang, int(bucket[a]), zipped(raw), pack_numbers(np.diff(offsets[a:z + 1]), n[a:z])


def _unpacked(phrases: bytes, n: bytes) -> tuple[pa.Array, np.ndarray]:
    sizes, counts = unpack_numbers(n)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(unzipped(phrases))]), counts


def active_phrases(ids: np.ndarray, words: pa.Array, end: int, lang: str, step: int, shards: int, longest: int,
                   slots: dict[int, np.ndarray]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(length, word numbers by place, count, hash) of the chunk's phrases that are under way."""
    own = _word_hashes(words.to_pylist())
    if step < shards:
        n = np.bincount(ids, minlength=len(words))
        if end is not None:
            n[end] = 0
        seen = np.flatnonzero(n)
        yield 1, [seen], n[seen], own[seen]
    if not slots:
        return
    word = own[ids]
    inside = ids != end if end is not None else np.ones(len(ids), bool)
    h = word  # hash of the phrase of ``length`` - 1 words from each place
    for length in range(2, longest + 1):
        if len(h) < 2 or length - 1 not in slots:
            return
        table = slots[length - 1]
        reached = table[_slot(h, lang)]
        reached[~inside] = _NEVER
        start = np.maximum(reached[:-1], reached[1:]).astype(np.int16) + 1
        at = np.flatnonzero((start <= step) & (step < start + shards))
        del reached, start
        inside = inside[:-1] & inside[1:]
        h = _joined_hash(h[:-1], word[length - 1:])
        code = ids[at]
        for k in range(1, length):
            if len(code) and int(code.max()) >= (1 << 62) // len(words):
                code = np.unique(code, return_inverse=True)[1]
            code = code * len(words) + ids[at + k]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        at = at[first]
        del code, first
        yield length, [ids[at + k] for k in range(length)], n, h[at]


def _scan(chunks: DataFrame, step: int, shards: int, longest: int, buckets: int, slots: dict[int, bytes]) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.frombuffer(unzipped(v), np.uint8) for k, v in shared.value.items()}
        for batch in batches:
            for lang, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                buf = unzipped(texts.as_py())
                if not buf.strip(b" "):
                    continue
                ids, words, end = _words(buf)
                del buf
                pa.default_memory_pool().release_unused()
                rows = [row for length, parts, n, h in active_phrases(ids, words, end if end >= 0 else None, lang, step, shards, longest, tables)
                        for row in _bucketed(lang, length, words, parts, n, h, buckets)]
                if rows:
                    types = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                     names=["length", "lang", "bucket", "phrases", "n"])

    return chunks.select("lang", "texts").mapInArrow(run, "length int, " + _COUNTS)


# ---- counts so far --------------------------------------------------------------------

def _merged(table: pa.Table, least: int) -> pa.Table:
    """Counts of a bucket so far with those of the step, and the slots of newly reached phrases."""
    lang, length, bucket = table["lang"][0].as_py(), table["length"][0].as_py(), table["bucket"][0].as_py()
    parts = []
    for old, phrases, n in zip(table["old"].to_pylist(), table["phrases"], table["n"]):
        text, counts = _unpacked(phrases.as_py(), n.as_py())
        parts.append(pa.table({"p": text, "n": counts, "was": counts if old else np.zeros(len(counts), np.int64)}))
    t = pa.concat_tables(parts).group_by("p").aggregate([("n", "sum"), ("was", "sum")])
    t = t.take(pc.sort_indices(t["p"]))
    n, text = t["n_sum"].to_numpy(), t["p"].combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = text.chunk(0)
    new = (n >= least) & (t["was_sum"].to_numpy() < least)
    slots = _slot(_phrase_hashes(text.filter(pa.array(new)).to_pylist()), lang)
    (_, _, _, zphrases, zn), = _packed_ranges(lang, length, text, n, np.full(len(n), bucket))
    return pa.table({"lang": [lang], "bucket": pa.array([bucket], pa.int32()), "phrases": pa.array([zphrases], pa.binary()),
                     "n": pa.array([zn], pa.binary()), "reached": pa.array([pack_numbers(np.unique(slots))], pa.binary())})


def _slot_table(reached: DataFrame) -> np.ndarray:
    """The slots that a step's newly reached phrases hit, or-ed in blocks of fixed size."""
    size = 1 << _BLOCK_BITS

    def run(batches):
        hit = np.zeros(1 << SLOT_BITS, bool)
        for batch in batches:
            for r in batch.column(0):
                hit[unpack_numbers(r.as_py())[0]] = True
        blocks = hit.reshape(-1, size)
        some = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([np.packbits(blocks[i]).tobytes() for i in some], pa.binary())],
                                         names=["block", "bits"])

    def either(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b.as_py(), np.uint8) for b in table["bits"]])
        return pa.table({"block": table["block"].slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros(1 << SLOT_BITS, bool)
    rows = (reached.mapInArrow(run, "block long, bits binary").groupBy("block")
            .applyInArrow(either, "block long, bits binary").collect())  # at most 2^SLOT_BITS bits
    for r in rows:
        out[r["block"] * size:(r["block"] + 1) * size] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return out


class _Counts:
    """The counts of one length so far, one row per language and bucket."""

    def __init__(self, spark, length: int, least: int, partitions: int):
        self.spark, self.length, self.least, self.partitions = spark, length, least, partitions
        self.path: str | None = None

    def read(self) -> DataFrame | None:
        return self.path and self.spark.read.schema(_COUNTS + ", reached binary").parquet(self.path)

    def add(self, scanned: DataFrame) -> None:
        new = scanned.where(F.col("length") == self.length).select("lang", "length", "bucket", "phrases", "n", F.lit(False).alias("old"))
        if self.path:
            new = new.unionByName(self.read().select("lang", F.lit(self.length).alias("length"), "bucket", "phrases", "n", F.lit(True).alias("old")))
        least, before, self_path = self.least, self.path, scratch_folder(self.spark, f"phrases{self.length}")
        (new.repartition(self.partitions, "lang", "bucket").groupBy("lang", "bucket")
         .applyInArrow(lambda t: _merged(t, least), _COUNTS + ", reached binary").write.parquet(self_path))
        self.path = self_path
        if before:
            discard(self.spark, before)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST,
                  least: int = LEAST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """((lang, length, phrase, n) of the phrases that occur ``least`` times or more,
    (lang, n) with all word occurrences)."""
    spark = docs.sparkSession
    folder = scratch_folder(spark, "shards")
    _shards(docs, text_col, lang_col, shards).write.partitionBy("shard").parquet(folder)
    chunks = spark.read.schema("lang string, size long, texts binary, shard int").parquet(folder)
    total = chunks.agg(F.sum("size").alias("b")).first()["b"] or 0
    buckets = max(1, -(-total // BUCKET))
    partitions = min(max(4, 2 * buckets), _MOST_PARTITIONS)

    counts = {k: _Counts(spark, k, least, partitions) for k in range(1, longest + 1)}
    slots = {k: np.full(1 << SLOT_BITS, _NEVER, np.uint8) for k in range(1, longest)}
    reached: dict[int, list[int]] = {k: [] for k in range(1, longest)}  # steps at which slots were set
    for step in range(longest * shards):
        # a phrase of k words is under way if a subphrase reached the threshold in the last cycle
        lengths = [1] * (step < shards) + [k for k in range(2, longest + 1) if any(step - shards <= s < step for s in reached[k - 1])]
        if not lengths:
            break
        known = {k: zipped(t.tobytes()) for k, t in slots.items() if reached[k]}
        scanned = _scan(chunks.where(F.col("shard") == step % shards), step, shards, longest, buckets, known)
        folder = scratch_folder(spark, "scan")
        scanned.write.partitionBy("length").parquet(folder)
        scanned = spark.read.schema(_COUNTS + ", length int").parquet(folder)
        for k in lengths:
            counts[k].add(scanned)
            if k < longest:
                new = _slot_table(counts[k].read().select("reached")) & (slots[k] == _NEVER)
                if new.any():
                    slots[k][new] = step
                    reached[k].append(step)
        discard(spark, folder)

    def rows(batches):
        for batch in batches:
            for length, lang, phrases, n in zip(*(batch.column(i) for i in range(4))):
                text, m = _unpacked(phrases.as_py(), n.as_py())
                often = m >= least
                text = text.filter(pa.array(often)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.as_py()] * len(text), pa.string()), pa.array(np.full(len(text), length.as_py(), np.int32)), text,
                     pa.array(m[often])], names=["lang", "length", "phrase", "n"])

    def words(batches):
        for batch in batches:
            totals = [int(unpack_numbers(n.as_py())[1].sum()) for n in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64())], names=["lang", "n"])

    schema = "lang string, length int, phrase string, n long"
    found = spark.createDataFrame([], schema)
    for k, c in counts.items():
        if c.path:
            found = found.unionByName(c.read().select(F.lit(k).alias("length"), "lang", "phrases", "n").mapInArrow(rows, schema))
    frequent = materialise(found, "phrases")
    occurrences = (materialise(counts[1].read().select("lang", "n").mapInArrow(words, "lang string, n long")
                               .groupBy("lang").agg(F.sum("n").alias("n")), "words"))
    for c in counts.values():
        if c.path:
            discard(spark, c.path)
    return frequent, occurrences


# ---- scores ---------------------------------------------------------------------------

def _part(a: int | F.Column, n) -> F.Column:
    return F.array_join(F.slice("w", a, n), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST,
                 least: int = LEAST, cover: int = COVER, top: int = TOP, unit: int = UNIT,
                 shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    A-Z is lower-cased, texts split at ``[.,;:!?\\n-\\r]`` into pieces and these at spaces and tabs
    into words; phrases lie inside pieces.  ``a`` is a phrase's count (``least`` or more), ``l`` and
    ``r`` the counts of its parts at the cut with the lowest score (ties: the first), ``n`` all
    words of the language, ``score`` = floor(unit a a / (l r)).  A phrase goes if a longer
    one of ``least`` or more holds it with ``cover`` percent of its count or more.  Order: score and
    a descending, then the phrase's UTF-8 bytes.

    NULL and empty texts have no words, a NULL language counts as ``und``, repeated rows count
    again.  An empty table gives an empty result.  Other columns are not read."""
    frequent, occurrences = phrase_counts(docs, text_col, lang_col, longest, least, shards)
    known = frequent.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("n").alias("f"))
    base = frequent.where("length > 1").select("lang", "length", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = base.select("lang", "length", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("head"),
                       _part(F.col("k") + 1, F.col("length") - F.col("k")).alias("tail"))
    cuts = (cuts.join(known, (F.col("lang") == F.col("of")) & (F.col("head") == F.col("part"))).drop("of", "part").withColumnRenamed("f", "l")
            .join(known, (F.col("lang") == F.col("of")) & (F.col("tail") == F.col("part"))).drop("of", "part").withColumnRenamed("f", "r"))
    wide = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    cuts = cuts.withColumns({"over": (wide["a"] * wide["a"] * F.lit(unit).cast("decimal(7,0)")).cast("decimal(38,0)"),
                             "under": wide["l"] * wide["r"]}).withColumn("score", F.expr("over div under"))
    scored = (cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    # every shorter phrase inside a longer one, with the longer one's count
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("length") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("length") - m + 1), lambda i: _part(i, m))))
    held = (base.where("length > 2").select(F.col("lang").alias("of"), F.col("a").alias("longer"), F.explode(inner).alias("part"))
            .groupBy("of", "part").agg(F.max("longer").alias("longer")))
    free = (scored.join(held, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")), "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    all_words = occurrences.select(F.col("lang").alias("of"), "n")
    return (best.drop("of").join(all_words, F.col("lang") == F.col("of"))
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
