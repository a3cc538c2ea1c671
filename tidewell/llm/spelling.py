"""Spelling variants: words one edit apart, found in tries over letter-group counts.

A word becomes the vector of its letters' counts in ``GROUPS`` groups (code point modulo
``GROUPS``).  The trie has one level per group, in the order ``LEVELS``, and an edge per count;
words with one vector share a leaf.  One edit moves at most one count up and one down, so a
search goes down the trie with a budget of one surplus and one deficit and takes a child whose
count differs by more than what is left for neither; the words of the leaves it reaches are
verified letter by letter.  The search is depth-first over blocks of (word, node) pairs.

The first levels deal the words into shards: a word is stored under its own counts and asks at
every shard whose counts the budget can reach, of two shards only at the lesser one, whose
answers count for both words.  A shard with very many words is dealt into a square of blocks
(stored × asking), so that no task holds more than a bounded part of it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialise, text_of
from tidewell.llm.tokenizing import slices

LEAST_LENGTH, LEAST_COUNT, NOISE, FACTOR = 5, 3, 97, 2
GROUPS = 16
#: order of the groups along the trie: those of frequent letters first
LEVELS = (5, 1, 15, 14, 9, 4, 3, 2, 8, 12, 0, 13, 7, 6, 10, 11)
#: stored words of a block
SHARD = 20_000
#: (word, node) pairs of a search step, and (word, word) pairs of a verification step
STEP = 1 << 16
#: letters that a verification step compares as one array; longer words are compared one by one
WIDE = 48
#: distinct words that a task gathers before it sends their counts
HELD = 400_000


# ---- words ----------------------------------------------------------------------------

def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def _runs(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word of each run, distinct words, text of each run) for runs of ``[A-Za-z\\u00C0-\\u00FF]``,
    A-Z lower-cased; in UTF-8 the upper range is the byte C3 and the one behind it."""
    buf = b" ".join(texts).lower()
    b = np.frombuffer(buf, np.uint8)
    high = b == 0xC3
    letter = high | ((b >= 97) & (b <= 122))
    letter[1:] |= high[:-1]
    edges = np.flatnonzero(np.diff(letter.view(np.int8), prepend=0, append=0))
    start, stop = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(b[letter])])
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, np.searchsorted(ends, start, side="right")


def _hashes(word: np.ndarray, distinct: pa.Array, text: np.ndarray, ids: list) -> np.ndarray:
    """crc32 of ``<id>:<word>`` for each run: the prefix's crc moved on by the word's length,
    xor the word's own."""
    raw = distinct.cast(pa.binary()).to_pylist()
    own = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    table, most = _crc_table(), min(int(size.max(initial=0)), 64)
    moved = np.empty((most + 1, len(ids)), np.uint32)
    moved[0] = prefix
    for k in range(most):
        moved[k + 1] = table[moved[k] & 0xFF] ^ (moved[k] >> 8)
    length = size[word]
    out = moved[np.minimum(length, most), text] ^ own[word]
    for i in np.flatnonzero(length > most).tolist():
        out[i] = zlib.crc32(raw[word[i]], int(prefix[text[i]]))
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = NOISE,
                least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of ``least_length`` code points or more that occur ``least_count``
    times or more.  With ``noise`` a run whose hash with its document's id is a multiple of it
    loses one code point (the hash modulo the run's length): typing errors to be found again."""
    src = docs.select(F.col(f"`{id_col}`").cast("string"), text_of(f"`{text_col}`").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def merged() -> pa.Table:
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return t.select(["word", "n_sum"]).rename_columns(["word", "n"])
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, z in slices(texts):
                word, distinct, text = _runs(texts[a:z])
                changed: Counter[str] = Counter()
                if noise and len(word):
                    h = _hashes(word, distinct, text, ids[a:z])
                    hit = h % noise == 0
                    for w, x in zip(distinct.take(pa.array(word[hit])).to_pylist(), h[hit].tolist()):
                        at = x % len(w)
                        changed[w[:at] + w[at + 1:]] += 1
                    word = word[~hit]
                n = np.bincount(word, minlength=len(distinct))
                t = pa.table({"word": pa.concat_arrays([distinct, pa.array(list(changed), pa.string())]),
                              "n": np.concatenate([n, np.array(list(changed.values()), np.int64)])})
                t = t.filter(pc.and_(pc.greater_equal(pc.utf8_length(t["word"]), least_length), pc.greater(t["n"], 0)))
                held.append(t)
                rows += t.num_rows
                if rows > 2 * HELD:
                    held = [merged()]
                    if held[0].num_rows > HELD:
                        yield from held[0].to_batches()
                        held = []
                    rows = sum(t.num_rows for t in held)
        if held:
            yield from merged().to_batches()

    return (src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


# ---- the trie -------------------------------------------------------------------------

def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letter-group counts in trie order, lengths)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4") % GROUPS
    place = np.argsort(LEVELS)
    cell = np.repeat(np.arange(len(words)), size) * GROUPS + place[codes]
    return np.bincount(cell, minlength=len(words) * GROUPS).reshape(-1, GROUPS), size


def _matrix(words: list[str], size: np.ndarray) -> np.ndarray:
    """Code points, a row per word, zero behind its end (and at least one zero)."""
    wide = min(int(size.max(initial=0)), WIDE) + 1
    short = [w[:wide - 1] for w in words]
    n = np.minimum(size, wide - 1)
    out = np.zeros((len(words), wide), np.uint32)
    out[np.arange(wide) < n[:, None]] = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point parts ``a`` and ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)):] == b[p + (len(b) >= len(a)):]


class Trie:
    """Words arranged by successive letter-group counts."""

    def __init__(self, words: list[str]):
        counts, size = _letters(words)
        by = np.lexsort(counts.T[::-1])
        self.words = [words[i] for i in by.tolist()]
        self.item, counts, self.size = by, counts[by], size[by]
        self.letters = _matrix(self.words, self.size)
        self.most = int(counts.max(initial=0)) + 2  # edges are numbered parent × most + count
        self.edges, node = [], np.zeros(len(words), np.int64)
        for level in range(GROUPS):
            key = node * self.most + counts[:, level]
            edges, node = np.unique(key, return_inverse=True)
            self.edges.append(edges)
        self.leaf = np.searchsorted(node, np.arange(len(self.edges[-1]) + 1))

    def search(self, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asking word, stored word) candidates: depth first, one surplus and one deficit."""
        n = len(counts)
        zero = np.zeros(n, np.int64)
        stack = [(0, np.arange(n), zero, zero.astype(bool), zero.astype(bool))]
        while stack:
            level, word, node, up, down = stack.pop()
            if len(word) > STEP:
                half = len(word) // 2
                stack += [(level, *(x[half:] for x in (word, node, up, down))), (level, *(x[:half] for x in (word, node, up, down)))]
                continue
            if level == GROUPS:
                lo, each = self.leaf[node], self.leaf[node + 1] - self.leaf[node]
                for a, z in slices_of(each, STEP):
                    e = each[a:z]
                    yield np.repeat(word[a:z], e), np.repeat(lo[a:z] - (np.cumsum(e) - e), e) + np.arange(e.sum())
                continue
            edges, parts = self.edges[level], []
            for step in (-1, 0, 1):
                ok = ~up if step > 0 else ~down if step < 0 else np.ones(len(word), bool)
                count = counts[word, level] + step
                ok &= (count >= 0) & (count < self.most)
                key = node * self.most + count
                at = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
                ok &= edges[at] == key
                parts.append((word[ok], at[ok], up[ok] | (step > 0), down[ok] | (step < 0)))
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*parts))))

    def near(self, asking: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(asking word, stored word as given): the pairs that one edit parts."""
        if not asking or not self.words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts, size = _letters(asking)
        letters, found = _matrix(asking, size), []
        wide = max(letters.shape[1], self.letters.shape[1]) + 1
        mine, theirs = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (letters, self.letters))
        for q, s in self.search(counts):
            gap = size[q] - self.size[s]
            close = np.abs(gap) <= 1
            q, s, gap = q[close], s[close], gap[close]
            long = (size[q] > WIDE) | (self.size[s] > WIDE)
            good = np.zeros(len(q), bool)
            for i in np.flatnonzero(long).tolist():
                good[i] = one_edit(asking[q[i]], self.words[s[i]])
            short = np.flatnonzero(~long)
            good[short] = _verified(mine[q[short]], theirs[s[short]], gap[short])
            found.append((q[good], self.item[s[good]]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def slices_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items with about ``most`` in total."""
    total = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield a, z
        a = z


def _verified(a: np.ndarray, b: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Exactly one edit, for rows of code points padded with zeros; ``gap``: length of a less b."""
    differ = a != b
    out = (gap == 0) & (differ.sum(1) == 1)
    first = differ.argmax(1)[:, None]
    at = np.arange(a.shape[1] - 1)
    for sign, x, y in ((-1, a, b), (1, b, a)):  # y is x with one more code point at ``first``
        rows = np.flatnonzero(gap == sign)
        if len(rows):
            out[rows] = ((x[rows, :-1] == y[rows, 1:]) | (at < first[rows])).all(1)
    return out


# ---- shards ---------------------------------------------------------------------------

_SCALE = 4096


def _code(counts: np.ndarray) -> np.ndarray:
    """Shard number of the first levels' counts."""
    weights = _SCALE ** np.arange(counts.shape[-1])[::-1]
    return (np.minimum(counts, _SCALE - 1) * weights).sum(-1)


def _reach(depth: int) -> np.ndarray:
    """Changes of the first counts within the budget."""
    eye = np.eye(depth, dtype=np.int64)
    moves = [np.zeros(depth, np.int64), *eye, *-eye, *(eye[i] - eye[j] for i in range(depth) for j in range(depth) if i != j)]
    return np.array(moves)


def _route(words: DataFrame, depth: int, blocks: dict[int, int]) -> DataFrame:
    """One stored row and the asking rows of each word: (shard, row, col, stored, own, word, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = np.array(sorted(blocks), np.int64)
        split = np.array([blocks[k] for k in sorted(blocks)], np.int64)

        def width(shard):
            if not len(big):
                return np.ones(len(shard), np.int64)
            at = np.minimum(np.searchsorted(big, shard), len(big) - 1)
            return np.where(big[at] == shard, split[at], 1)
        for batch in batches:
            names = batch.column(0).to_pylist()
            if not names:
                continue
            head = _letters(names)[0][:, :depth]
            deal = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in names), np.int64, len(names))
            own, rows = _code(head), []
            for change in _reach(depth):
                to = head + change
                shard = _code(to)
                same = shard == own  # counts beyond the scale share its last number
                ask = np.flatnonzero((to >= 0).all(1) & ((shard < own) | same) if change.any() else same)
                if change.any():
                    ask = ask[~same[ask]]
                k = width(shard[ask])
                each = np.repeat(ask, k)
                block = np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k)
                rows.append((shard[each], block, deal[each] % np.repeat(k, k), np.zeros(len(each), bool), np.full(len(each), not change.any()), each))
            k = width(own)
            each = np.repeat(np.arange(len(names)), k)
            block = np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k)
            rows.append((own[each], deal[each] % np.repeat(k, k), block, np.ones(len(each), bool), np.ones(len(each), bool), each))
            shard, row, col, stored, mine, each = (np.concatenate(x) for x in zip(*rows))
            each = pa.array(each)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(stored), pa.array(mine),
                 batch.column(0).take(each), batch.column(1).take(each)],
                names=["shard", "row", "col", "stored", "own", "word", "n"])

    return words.select("word", "n").mapInArrow(
        run, "shard long, row int, col int, stored boolean, own boolean, word string, n long")


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _best(word: np.ndarray, names: list[str], other: np.ndarray, others: list[str], n: np.ndarray) -> list[pa.Array]:
    """Per word: how many near words and the most frequent of them, the least in code-point order."""
    rank = np.empty(len(others), np.int64)
    rank[sorted(range(len(others)), key=others.__getitem__)] = np.arange(len(others))
    by = np.lexsort((rank[other], -n[other], word))
    word, other = word[by], other[by]
    at, many = np.unique(word, return_index=True, return_counts=True)[1:]
    return [pa.array([names[i] for i in word[at].tolist()], pa.string()), pa.array(many, pa.int64()),
            pa.array(n[other[at]], pa.int64()), pa.array([others[i] for i in other[at].tolist()], pa.string())]


def _answers(table: pa.Table) -> pa.Table:
    stored = table.filter(table["stored"])
    asking = table.filter(pc.invert(table["stored"]))
    names, theirs = asking["word"].to_pylist(), stored["word"].to_pylist()
    q, s = Trie(theirs).near(names) if names and theirs else (np.zeros(0, np.int64),) * 2
    mine_n, their_n = asking["n"].to_numpy(), stored["n"].to_numpy()
    parts = [pa.Table.from_arrays(_best(q, names, s, theirs, their_n), schema=_NEAR)]
    away = ~asking["own"].to_numpy(zero_copy_only=False)[q] if len(q) else np.zeros(0, bool)
    parts.append(pa.Table.from_arrays(_best(s[away], theirs, q[away], names, mine_n), schema=_NEAR))
    return pa.concat_tables(parts)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of a table (word, n) of distinct words: ``form`` is the most
    frequent near word (ties: the least in code-point order), whatever its count."""
    total = words.count()
    depth = next(k for k, most in ((2, 50_000), (3, 2_000_000), (4, float("inf"))) if total <= most)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            if names:
                code, n = np.unique(_code(_letters(names)[0][:, :depth]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["shard", "n"])
    sizes = words.select("word").mapInArrow(shards, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    # at most total / SHARD rows
    blocks = {r["shard"]: -(-r["n"] // SHARD) for r in sizes.where(F.col("n") > SHARD).collect()}
    found = (_route(words, depth, blocks).groupBy("shard", "row", "col")
             .applyInArrow(_answers, "word string, n_near long, best_n long, best string"))
    best = (found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                      F.min(F.struct((-F.col("best_n")).alias("neg"), "best")).alias("top")))
    return (words.join(best, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                    F.col("top.best").alias("form"), (-F.col("top.neg")).alias("form_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form: every round follows twice as many links."""
    links = materialise(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = links.join(onward, F.col("root") == F.col("at"), "left")
        links = materialise(moved.select("word", F.coalesce("next", "root").alias("root"),
                                         F.col("next").isNotNull().alias("moved")), "roots")
        if not links.where("moved").head(1):
            return links.select("word", "root")
        links = links.select("word", "root")


def group_spellings(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table (word, n).

    A word's ``form`` is its near word (one inserted, deleted or replaced code point) with the
    largest count, ties to the smallest in code-point order, if that count is ``factor`` times the
    word's own or more; otherwise NULL, as is ``form_n``.  ``root`` follows forms to the last
    (the word itself without a form); counts grow along it, so it ends.  Repeated rows of a word
    count together; rows with a NULL or empty word are left out.  No words give an empty result."""
    words = materialise(words.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n")), "words")
    near = near_words(words)
    ok = F.col("form_n") >= factor * F.col("n")
    forms = materialise(near.withColumn("form", F.when(ok, F.col("form")))
                        .withColumn("form_n", F.when(ok, F.col("form_n"))), "forms")
    return (forms.join(_roots(forms), "word", "left")
            .withColumn("root", F.coalesce("root", "word")))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = NOISE,
                      least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                      factor: int = FACTOR) -> DataFrame:
    """``group_spellings`` of the words of all texts.  NULL and empty texts have no words; a NULL id
    counts as the empty text in the hash; repeated rows count again; other columns are not read."""
    return group_spellings(word_counts(docs, id_col, text_col, noise, least_length, least_count), factor)
