"""Repeated byte windows by a depth-limited radix sort, and their removal.

Every position of a text starts a suffix, and only the first ``threshold`` bytes of a suffix
count: two suffixes that stay together through that many bytes are a repeated window.  The
sort works most significant digit first and drops a suffix as soon as it is alone:

1. The first pass deals suffixes by a digit that equal windows must share: the least of the
   hashes of the ``gram``-byte strings inside the window, at its last place there.  Neighbouring
   suffixes mostly share it, so one entry stands for a run of them, about 16 at a time.  A
   task sends the sorted, delta-coded digits of its chunk; the answer is one bit per digit.
2. Suffixes with a shared digit travel with the bytes their windows need, equal entries of a
   chunk once.  Behind the shuffle equal entries collapse, and the passes order what is left
   by the digit's bytes, its offset and then 8 bytes at a time to depth ``threshold``; a pass
   keeps only groups of two or more.  Groups left in the end are exactly the repeated windows.

A chunk is a few megabytes of whole texts; it is written once, compressed, and met again by
its number, so a document never leaves its chunk.  A passage that a third of all documents
share reaches a reducer once per chunk, with its smallest document id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.blobs import pack_numbers, unpack_numbers, unzipped, zipped
from tidewell.llm.common import materialise, text_of

THRESHOLD = 50
#: bytes of text in a chunk, and of text behind one bucket of digits
CHUNK, BUCKET = 4 << 20, 8 << 20
#: positions that one step of the digit computation holds
BLOCK = 1 << 16
_NO_ID = np.iinfo(np.int64).max
_DIGIT_BITS = 48
_PLACE = np.uint64((1 << 31) - 1)
_MOST_PARTITIONS = 1 << 14


# ---- the first digit ------------------------------------------------------------------

def gram_of(threshold: int) -> int:
    """Bytes under the first digit: two fifths of the window."""
    return max(1, threshold * 2 // 5)


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position."""
    mul, part, width, power = 0x9E3779B97F4A7C15, b + np.uint64(1), 1, 0x9E3779B97F4A7C15
    out, done, rest = None, 0, gram
    n = len(b) - gram + 1
    while rest:
        if rest & 1:  # binary doubling: strings of 1, 2, 4 ... bytes, joined to ``gram``
            piece = part[done:done + n]
            out = piece if out is None else out * np.uint64(pow(mul, width, 1 << 64)) + piece
            done += width
        rest >>= 1
        if rest:
            part = part[:-width] * np.uint64(power) + part[width:]
            power, width = power * power & ((1 << 64) - 1), width * 2
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    least, w = key, 1
    while 2 * w <= width:
        least, w = np.minimum(least[:-w], least[w:]), 2 * w
    return np.minimum(least[:len(key) - width + 1], least[width - w:]) if w < width else least


def suffix_runs(buf: bytes, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """(start, count, anchor, digit): runs of neighbouring suffixes with one first digit.

    A run is ``count`` suffixes from ``start`` on whose windows lie inside one text (``ends``: ends
    of the texts in ``buf``); ``anchor`` is the place of the digit's bytes, ``digit`` their
    hash (48 bits).  Which digit a window has depends on its bytes alone."""
    gram, n = gram_of(threshold), len(buf)
    out = []
    for at in range(0, n - threshold + 1, BLOCK):
        stop = min(n, at + BLOCK + threshold - 1)
        hashes = _gram_hashes(np.frombuffer(buf, np.uint8, stop - at, at).astype(np.uint64), gram)
        places = np.arange(len(hashes), dtype=np.uint64)
        key = _sliding_least((hashes & ~_PLACE) | (_PLACE - places), threshold - gram + 1)
        anchor = (_PLACE - (key & _PLACE)).astype(np.int64)
        first, last = np.searchsorted(ends, [at, at + len(anchor) - 1], side="right")
        cuts = np.minimum(ends[first:last + 1], at + len(anchor))
        text_end = np.repeat(ends[first:last + 1], np.diff(np.concatenate([[at], cuts])))
        inside = np.arange(at, at + len(anchor)) + threshold <= text_end
        change = np.ones(len(anchor) + 1, bool)
        change[1:-1] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
        edges = np.flatnonzero(change)
        keep = inside[edges[:-1]]
        start, count = edges[:-1][keep], np.diff(edges)[keep]
        # the least of many hashes is small: mixed again, digits spread evenly over the buckets
        digit = hashes[anchor[start]] * np.uint64(0x9FB21C651E98DF25)
        out.append((start + at, count, anchor[start] + at, (digit ^ (digit >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - _DIGIT_BITS)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _bucket(digit: np.ndarray, buckets: int) -> np.ndarray:
    """Monotone in the digit, so that a sorted list of digits falls into ranges."""
    return ((digit >> np.uint64(_DIGIT_BITS - 31)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)


def _ranges(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
    for a, z in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[a]), int(a), int(z)


# ---- chunks of texts ------------------------------------------------------------------

_CHUNKS = "chunk long, size long, ids array<bigint>, sizes array<bigint>, texts binary"


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = docs.select(F.col(f"`{id_col}`").cast("bigint"), text_of(f"`{text_col}`").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def chunk():
            sizes = list(map(len, texts))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([held], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([zipped(b"".join(texts))], pa.binary())],
                names=["chunk", "size", "ids", "sizes", "texts"])
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                ids.append(i.as_py())
                texts.append(t.as_py())
                held += len(texts[-1])
                if held >= CHUNK or len(ids) >= CHUNK // 64:
                    yield chunk()
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield chunk()

    return src.mapInArrow(run, _CHUNKS)


class _Chunk:
    def __init__(self, ids, sizes, texts, threshold):
        self.ids, self.threshold = ids, threshold
        self.order = np.array([_NO_ID if i is None else i for i in ids], np.int64)
        self.ends = np.cumsum(np.array(sizes, np.int64))
        self.buf = unzipped(texts)
        self.start, self.count, self.anchor, self.digit = suffix_runs(self.buf, self.ends, threshold)
        self.doc = self.order[np.searchsorted(self.ends, self.start, side="right")]

    @classmethod
    def of(cls, table: pa.Table, threshold: int) -> _Chunk:
        return cls(*[table.column(c)[0].as_py() for c in ("ids", "sizes", "texts")], threshold)

    def entries(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each of ``runs``, first run of each entry): runs with equal bytes and an
        equally placed digit are one entry."""
        known: dict[bytes, int] = {}
        stop = self.start[runs] + self.count[runs] + self.threshold - 1
        buf = self.buf
        entry = np.fromiter((known.setdefault(buf[a:z], len(known)) for a, z in zip(self.start[runs].tolist(), stop.tolist())),
                            np.int64, len(runs))
        return entry, runs[np.unique(entry, return_index=True)[1]]

    def shared(self) -> np.ndarray:
        """Runs whose digit another run of the chunk has too."""
        _, back, n = np.unique(self.digit, return_inverse=True, return_counts=True)
        return n[back] > 1


# ---- passes ---------------------------------------------------------------------------

def _digits(chunks: DataFrame, buckets: int, threshold: int) -> DataFrame:
    """First pass, map side: a chunk's distinct digits by bucket, sorted."""
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                c = _Chunk.of(pa.Table.from_batches([batch.slice(r, 1)]), threshold)
                digits = np.unique(c.digit)
                cuts = list(_ranges(_bucket(digits, buckets)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in cuts], pa.int32()), pa.array([batch.column(0)[r].as_py()] * len(cuts), pa.int64()),
                     pa.array([pack_numbers(np.diff(digits[a:z].astype(np.int64), prepend=0)) for _, a, z in cuts], pa.binary())],
                    names=["bucket", "chunk", "digits"])

    return chunks.mapInArrow(run, "bucket int, chunk long, digits binary")


def _shared_digits(table: pa.Table) -> pa.Table:
    """First pass, reduce side: one bit per digit of each chunk, set if another chunk has it."""
    lists = [np.cumsum(unpack_numbers(d.as_py())[0]) for d in table.column("digits")]
    distinct, back, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    many = np.split(n[back] > 1, np.cumsum([len(x) for x in lists])[:-1])
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"),
                     "bits": pa.array([np.packbits(m).tobytes() for m in many], pa.binary())})


def _entries(chunk: pa.Table, bits: pa.Table, buckets: int, threshold: int) -> pa.Table:
    """Second pass, map side: a chunk's entries with a shared digit, by bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("entries", pa.binary()), ("bytes", pa.binary())])
    if not chunk.num_rows:
        return schema.empty_table()
    c = _Chunk.of(chunk, threshold)
    digits = np.unique(c.digit)
    told = dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist()))
    elsewhere = np.zeros(len(digits), bool)
    for b, a, z in _ranges(_bucket(digits, buckets)):
        elsewhere[a:z] = np.unpackbits(np.frombuffer(told[b], np.uint8), count=z - a).astype(bool)
    runs = np.flatnonzero(c.shared() | elsewhere[np.searchsorted(digits, c.digit)])
    if not len(runs):
        return schema.empty_table()
    entry, first = c.entries(runs)
    least = np.full(len(first), _NO_ID)
    np.minimum.at(least, entry, c.doc[runs])
    bucket = _bucket(c.digit[first], buckets)
    by = np.argsort(bucket, kind="stable")
    first, least, bucket = first[by], least[by], bucket[by]
    number, rows = chunk.column("chunk")[0].as_py(), []
    for b, a, z in _ranges(bucket):
        f = first[a:z]
        start, count = c.start[f], c.count[f]
        raw = b"".join([c.buf[s:e] for s, e in zip(start.tolist(), (start + count + threshold - 1).tolist())])
        rows.append((b, number, pack_numbers(np.diff(start, prepend=0), count, c.anchor[f] - start, least[a:z]), zipped(raw)))
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)


def _groups(changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each item, whether it has two items or more) of a sorted list."""
    group = np.cumsum(changed) - 1
    return group, np.bincount(group)[group] > 1


def radix_windows(buf: np.ndarray, place: np.ndarray, group: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes to depth ``threshold``: (items, group), groups of two or
    more items of one first group with equal windows.

    ``place`` is where an item's window starts in ``buf``; ``group`` its first group."""
    item = np.arange(len(place))
    width = max(w for w in (1, 2, 4, 8) if w <= threshold)
    view = np.ndarray((len(buf) - width + 1,), f">u{width}", buf, strides=(1,))
    by = np.argsort(group, kind="stable")
    item, group = item[by], group[by]
    depths = [-1, *range(0, threshold - width, width), threshold - width]
    for depth in depths:
        if depth >= 0:
            digit = view[place[item] + depth]
            by = np.lexsort((digit, group))
            item, group, digit = item[by], group[by], digit[by]
            changed = np.ones(len(item), bool)
            changed[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        else:
            changed = np.ones(len(item), bool)
            changed[1:] = group[1:] != group[:-1]
        if not len(item):
            break
        group, many = _groups(changed)
        item, group = item[many], group[many]
    return item, group


def _hits(table: pa.Table, threshold: int) -> pa.Table:
    """Second pass, reduce side: for each chunk (start of the entry, first suffix, suffixes) of the
    windows that a smaller document elsewhere starts too."""
    schema = pa.schema([("chunk", pa.int64()), ("hits", pa.binary())])
    owner, start, count, anchor, least, entry = [], [], [], [], [], []
    known: dict[bytes, int] = {}
    for at in range(table.num_rows):
        gap, n, to, doc = unpack_numbers(table.column("entries")[at].as_py())
        raw, z = unzipped(table.column("bytes")[at].as_py()), 0
        for w in (n + threshold - 1).tolist():
            entry.append(known.setdefault(raw[z:z + w], len(known)))
            z += w
        owner.append(np.full(len(n), at))
        for into, x in zip((start, count, anchor, least), (np.cumsum(gap), n, to, doc)):
            into.append(x)
    owner, start, count, anchor, least = map(np.concatenate, (owner, start, count, anchor, least))
    entry = np.array(entry, np.int64)
    # distinct entries: their bytes, smallest document, number of suffixes, place of the digit
    buf = np.frombuffer(b"".join(known), np.uint8)
    one = np.unique(entry, return_index=True)[1]
    size = np.fromiter(map(len, known), np.int64, len(known))
    base = np.cumsum(size) - size
    best = np.full(len(one), _NO_ID)
    np.minimum.at(best, entry, least)
    many, to = count[one], anchor[one]
    del known

    # entries that share the digit's bytes, then their suffixes by the digit's offset
    gram = gram_of(threshold)
    alike, group = radix_windows(buf, base + to, np.zeros(len(one), np.int64), gram)
    n = many[alike]
    which = np.repeat(alike, n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(group, n) * (threshold + 1) + to[which] - offset
    item, same = radix_windows(buf, base[which] + offset, first, threshold)
    found = np.zeros(0, np.int64)
    if len(item):
        low = np.full(same.max() + 1, _NO_ID)
        np.minimum.at(low, same, best[which[item]])
        found = np.sort(item[low[same] < best[which[item]]])
    # a suffix of a distinct entry that is not its first: told to the entry's smallest document;
    # other members of the entry lose all its suffixes
    rows = {}
    later = np.flatnonzero(least > best[entry])
    rows["whole"] = (later, np.zeros(len(later), np.int64), count[later])
    w, o = which[found], offset[found]
    cut = np.ones(len(w), bool)
    cut[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1] + 1)
    at = np.flatnonzero(cut)
    seg_entry, seg_from, seg_n = w[at], o[at], np.diff(np.append(at, len(w)))
    holders = np.flatnonzero(least == best[entry])
    by = np.argsort(entry[holders], kind="stable")
    holders = holders[by]
    lo, hi = (np.searchsorted(entry[holders], seg_entry, side=s) for s in ("left", "right"))
    each = hi - lo
    pick = np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(each.sum())
    rows["part"] = (holders[pick], np.repeat(seg_from, each), np.repeat(seg_n, each))
    member, off, n = (np.concatenate(x) for x in zip(*rows.values()))
    by = np.lexsort((start[member], owner[member]))
    member, off, n = member[by], off[by], n[by]
    out = [(table.column("chunk")[int(k)].as_py(), pack_numbers(np.diff(start[member[a:z]], prepend=0), off[a:z], n[a:z]))
           for k, a, z in _ranges(owner[member])]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(schema.types)], schema=schema)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _cut(chunk: pa.Table, hits: pa.Table, threshold: int, names: list[str]) -> pa.Table:
    """Mark the windows of a chunk and cut the covered bytes out of its texts."""
    types = [pa.int64(), pa.int64(), _SPAN, pa.binary()]
    schema = pa.schema(list(zip(names, types)))
    if not chunk.num_rows:
        return schema.empty_table()
    c = _Chunk.of(chunk, threshold)
    cover = np.zeros(len(c.buf) + 1, np.int32)

    def mark(start, count):
        np.add.at(cover, start, 1)
        np.subtract.at(cover, start + count + threshold - 1, 1)
    # equal entries inside the chunk: every document but the smallest loses them, and all of them
    # lose what the reducers found for the entry
    runs = np.flatnonzero(c.shared())
    entry, first = c.entries(runs)
    least = np.full(len(first), _NO_ID)
    np.minimum.at(least, entry, c.doc[runs])
    later = runs[c.doc[runs] > least[entry]] if len(runs) else runs
    mark(c.start[later], c.count[later])
    for h in hits.column("hits"):
        gap, off, n = unpack_numbers(h.as_py())
        start = np.cumsum(gap)
        mark(start + off, n)
        # copies of the entry in this chunk, which the reducers know by its first place
        here = np.searchsorted(c.start, start)
        at = np.searchsorted(runs, here)
        known = at < len(runs)
        known[known] = runs[at[known]] == here[known]
        if known.any():
            twin = entry[at[known]]
            by = np.argsort(entry, kind="stable")
            lo, hi = (np.searchsorted(entry[by], twin, side=s) for s in ("left", "right"))
            each = hi - lo
            pick = runs[by[np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(each.sum())]]
            mark(c.start[pick] + np.repeat(off[known], each), np.repeat(n[known], each))
    gone = np.cumsum(cover, out=cover) > 0
    spans, kept, low = [], [], 0
    raw = np.frombuffer(c.buf, np.uint8)
    for high in c.ends.tolist():
        g = gone[low:high]
        if g.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
            spans.append([{"start": a, "stop": z} for a, z in edge.reshape(-1, 2).tolist()])
            kept.append(raw[low:high][~g].tobytes())
        else:
            spans.append([])
            kept.append(c.buf[low:high])
        low = high
    size = np.diff(c.ends, prepend=0)
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip((c.ids, size, spans, kept), types)], schema=schema)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: the id (as bigint), ``n_bytes``, ``spans`` (maximal removed runs of
    bytes: start, stop) and ``kept`` (the remaining bytes).

    A byte goes if a window of ``threshold`` bytes over it also starts in a document with a
    smaller id.  Texts count as UTF-8; windows lie inside one text and are judged on the
    input.  NULL texts are empty; an empty text or one shorter than the window stays as it is.
    Rows that share an id never remove each other's bytes, nor do two rows without id; a
    row without id yields to every row with one.  An empty table gives an empty result.
    Other columns are not read, whatever their names."""
    if threshold < 2:
        raise ValueError("threshold must be 2 bytes or more")
    chunks = materialise(_chunks(docs, id_col, text_col), "repeat-chunks")
    row = chunks.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(1, -(-(row["b"] or 0) // BUCKET))
    parts = min(max(1, row["n"]), _MOST_PARTITIONS)
    # partitions by number: a few chunks or buckets each, sized by bytes and not by a setting
    by_chunk = chunks.repartition(parts, "chunk").groupBy("chunk")
    digits = _digits(chunks.select("chunk", "ids", "sizes", "texts"), buckets, threshold)
    bits = materialise(digits.repartition(parts, "bucket").groupBy("bucket")
                       .applyInArrow(_shared_digits, "chunk long, bucket int, bits binary"), "repeat-bits")
    entries = by_chunk.cogroup(bits.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(
        lambda c, b: _entries(c, b, buckets, threshold), "bucket int, chunk long, entries binary, bytes binary")
    hits = materialise(entries.repartition(parts, "bucket").groupBy("bucket")
                       .applyInArrow(lambda t: _hits(t, threshold), "chunk long, hits binary"), "repeat-hits")
    names = [id_col, *[c if c != id_col else f"{c}_" for c in ("n_bytes", "spans", "kept")]]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, (
        "bigint", "bigint", "array<struct<start:bigint,stop:bigint>>", "binary")))
    return by_chunk.cogroup(hits.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(
        lambda c, h: _cut(c, h, threshold, names), schema)
