"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation.

Output classes are the ``HEAD`` most frequent tokens and ``ENDINGS`` classes that share all other
words by their last byte; a word of such a class has its smoothed unigram share within the
class, so that the model is a distribution over all words, seen or not.  The class after a
context of ``CONTEXT`` classes has the score  sum_i(c_i * q[h_i]) . r[w] + b[w]  (log-bilinear
with diagonal position matrices).

Training is noise-contrastive: a warm start on a documented sample on the driver, then one
pass over every training token, in which each partition improves its own copy and the copies
are averaged by an aggregation over parameter rows, weighted by tokens.  Scores normalise
explicitly: the distinct contexts of a slice go through batched matrix products.

Word counts cover all training tokens.  The most frequent ``KNOWN`` words are sent to every
task (a fixed size); counts of rarer words are joined by a shuffle on the word.  The driver sees how many words have each
count (fewer rows than the square root of twice the corpus) and the known words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialise, text_of
from tidewell.llm.tokenizing import text_slices

HEAD, ENDINGS, CONTEXT, DIM = 451, 61, 3, 16
KNOWN = 50_000
#: tokens of the warm start at most (texts chosen by hash), and passes over them
WARM_TOKENS, WARM_PASSES = 400_000, 4
BATCH, NOISE = 2048, 64
END = b""


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ``[\\x20\\x09-\\x0D]``, then the end token."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def _ending(word: bytes) -> int:
    return word[-1] % ENDINGS if word else 0


class _Classes(dict):
    """Token → class; words outside the head by their last byte (stored for known words only)."""

    def __init__(self, head: list[bytes], known=()):
        self.first = len(head)
        super().__init__((w, self.first + _ending(w)) for w in known)
        self.update((w, i) for i, w in enumerate(head))

    def __missing__(self, word: bytes) -> int:
        return self.first + (word[-1] % ENDINGS if word else 0)


class _Numbers(dict):
    """Known token → its number from 0; any other → -1 - its ending class (not stored)."""

    def __missing__(self, word: bytes) -> int:
        return -1 - (word[-1] % ENDINGS if word else 0)


# ---- counts ---------------------------------------------------------------------------

def word_counts(docs: DataFrame, text: Column) -> DataFrame:
    """(word, c): counts of all tokens.  Tasks combine before they shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()),
                                              pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()
            return out

        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                for t in texts:
                    held.update(words_of(t))
                if len(held) > 400_000:
                    yield flush()
        if held:
            yield flush()

    return docs.select(text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


# ---- model ----------------------------------------------------------------------------

@dataclass
class Parameters:
    q: np.ndarray  # context vectors, one more for the start of a text
    r: np.ndarray  # class vectors
    b: np.ndarray  # class biases
    c: np.ndarray  # position weights

    def rows(self) -> np.ndarray:
        """All parameters as rows of one width (biases as rows of their own)."""
        pad = -len(self.b) % DIM
        return np.concatenate([self.q, self.r, self.c, np.r_[self.b, np.zeros(pad)].reshape(-1, DIM)]).astype(np.float64)

    @staticmethod
    def of(rows: np.ndarray, classes: int) -> Parameters:
        a, z = classes + 1, 2 * classes + 1
        return Parameters(*[x.astype(np.float32) for x in (
            rows[:a], rows[a:z], rows[z + CONTEXT:].reshape(-1)[:classes], rows[z:z + CONTEXT])])


def start_parameters(share: np.ndarray, seed: int = 3) -> Parameters:
    rng, n = np.random.default_rng(seed), len(share)
    return Parameters(rng.normal(0, 0.1, (n + 1, DIM)).astype(np.float32), rng.normal(0, 0.1, (n, DIM)).astype(np.float32),
                      np.log(share).astype(np.float32), np.ones((CONTEXT, DIM), np.float32))


def examples(streams: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray]:
    """(targets, contexts) of class streams; contexts do not cross texts."""
    pad = np.full(CONTEXT, start)
    flat = np.concatenate([x for s in streams for x in (pad, s)])
    size = np.array([len(s) for s in streams])
    first = np.cumsum(size + CONTEXT) - size
    at = np.arange(size.sum()) + np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size)
    return flat[at], np.stack([flat[at - i - 1] for i in range(CONTEXT)], axis=1)


def _add_rows(ids: np.ndarray, rate: float, *parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Adagrad step with one accumulator per row; rows that occur more than once are summed first.
    Each part is (parameters, accumulators, gradients by ``ids``)."""
    order = np.argsort(ids.astype(np.int16), kind="stable")  # radix sort: classes are few
    ids = ids[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    rows = ids[first]
    for to, scale, grad in parts:
        total = np.add.reduceat(grad[order], first, axis=0)
        wide = total.ndim > 1
        scale[rows] += np.einsum("ij,ij->i", total, total) / total.shape[1] if wide else total * total
        step = rate / np.sqrt(scale[rows])
        to[rows] += (step[:, None] if wide else step) * total


def _sigmoid_of_minus(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    np.exp(x, out=x)
    x += 1.0
    return np.reciprocal(x, out=x)


def nce_pass(p: Parameters, targets: np.ndarray, contexts: np.ndarray, share: np.ndarray,
             rng: np.random.Generator, rate: float, scales: list[np.ndarray]) -> None:
    """One pass of noise-contrastive estimation in place; a batch shares its noise classes, which
    are drawn from the unigram ``share``.  Examples are taken in a random order."""
    noise_all = rng.choice(len(share), size=(len(targets) // BATCH + 1, NOISE), p=share)
    logs = np.log(NOISE * share).astype(np.float32)
    order = rng.permutation(len(targets))
    for i, at in enumerate(range(0, len(order), BATCH)):
        part = order[at:at + BATCH]
        w, h, noise = targets[part], contexts[part], noise_all[i]
        near = p.q[h]  # batch x CONTEXT x DIM
        v = near[:, 0] * p.c[0]
        for k in range(1, CONTEXT):
            v += near[:, k] * p.c[k]
        own, drawn, off = p.r[w], p.r[noise], p.b - logs
        true = _sigmoid_of_minus(np.einsum("bd,bd->b", v, own) + off[w])
        false = v @ drawn.T
        false += off[noise]
        false = _sigmoid_of_minus(np.negative(false, out=false))
        dv = true[:, None] * own
        dv -= false @ drawn
        dr = np.concatenate([true[:, None] * v, -(false.T @ v)])
        db = np.concatenate([true, -false.sum(axis=0)])
        dq = dv[:, None, :] * p.c
        dc = np.einsum("bcd,bd->cd", near, dv)
        _add_rows(np.concatenate([w, noise]), rate, (p.r, scales[1], dr), (p.b, scales[2], db))
        _add_rows(h.reshape(-1), rate, (p.q, scales[0], dq.reshape(-1, DIM)))
        scales[3] += (dc * dc).mean(axis=1)
        p.c += (rate / np.sqrt(scales[3]))[:, None] * dc


def new_scales(classes: int) -> list[np.ndarray]:
    return [np.ones(classes + 1, np.float32), np.ones(classes, np.float32), np.ones(classes, np.float32),
            np.ones(CONTEXT, np.float32)]


def log_probabilities(p: Parameters, targets: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Normalised natural log-probabilities; each distinct context is normalised once."""
    base = len(p.q)
    kind = np.int32 if base ** CONTEXT < 1 << 31 else np.int64
    code = contexts[:, 0].astype(kind)
    for i in range(1, CONTEXT):
        code = code * kind(base) + contexts[:, i].astype(kind)
    codes, back = np.unique(code, return_inverse=True)
    h = np.stack([codes // base ** i % base for i in range(CONTEXT - 1, -1, -1)], axis=1)
    v = sum((p.q * p.c[i])[h[:, i]] for i in range(CONTEXT))
    norm = np.empty(len(v), np.float32)
    wide = np.c_[v, np.ones(len(v), np.float32)]  # the bias is one more dimension
    table = np.ascontiguousarray(np.c_[p.r, p.b].T)
    # no score is beyond this bound, so below 80 sums of exponentials stay in single precision
    safe = np.sqrt((wide * wide).sum(axis=1).max(initial=0)) * np.sqrt((table * table).sum(axis=0).max()) < 80
    ones = np.ones(table.shape[1], np.float32)
    block = np.empty((512, len(ones)), np.float32)  # stays in the processor's cache
    for at in range(0, len(v), len(block)):
        rows = wide[at:at + len(block)]
        s = np.matmul(rows, table, out=block[:len(rows)])
        if safe:
            norm[at:at + len(block)] = np.log(np.exp(s, out=s) @ ones)
        else:
            top = s.max(axis=1)
            norm[at:at + len(block)] = np.log(np.exp(s - top[:, None]) @ ones) + top
    return (np.einsum("ij,ij->i", v[back], p.r[targets]) + p.b[targets] - norm[back]).astype(np.float64)


@dataclass
class Model:
    head: list[bytes]
    parameters: Parameters
    known: dict[bytes, int]  # counts of the most frequent words
    tokens: int
    distinct: int
    ending_tokens: np.ndarray  # per ending class: tokens and distinct words outside the head
    ending_words: np.ndarray


def _train(docs: DataFrame, text: Column, head: list[bytes], known: list[bytes], share: np.ndarray) -> Parameters:
    """Warm start on the driver, then every training token once, in averaged partitions."""
    classes = _Classes(head, known)
    n = len(head) + ENDINGS
    rng = np.random.default_rng(17)
    p, scales = start_parameters(share), new_scales(n)
    sized = docs.select(text.alias("t")).withColumn("h", F.pmod(F.xxhash64("t"), F.lit(1 << 20)))
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    part = min(1 << 20, int((1 << 20) * min(1.0, WARM_TOKENS * 6.0 / max(1, chars))) + 1)
    # whole texts in hash order; a text above the bound alone (tokens <= code points) is left to the pass
    sample = sized.where((F.col("h") < part) & (F.length("t") <= WARM_TOKENS)).orderBy("h", "t").select("t")
    streams, held = [], 0
    for row in sample.toLocalIterator():
        s = np.fromiter(map(classes.__getitem__, words_of(row["t"])), np.int64)
        if held + len(s) > WARM_TOKENS:
            break
        streams.append(s)
        held += len(s)
    if streams:
        targets, contexts = examples(streams, n)
        for _ in range(WARM_PASSES):
            nce_pass(p, targets, contexts, share, rng, 0.3, scales)
    sent = docs.sparkSession.sparkContext.broadcast((head, known, p, scales, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, known, p0, scales0, share = sent.value
        own = Parameters(p0.q.copy(), p0.r.copy(), p0.b.copy(), p0.c.copy())
        scale, classes, seen, rng = [s.copy() for s in scales0], _Classes(head, known), 0, np.random.default_rng(29)
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                streams = [np.fromiter(map(classes.__getitem__, words_of(t)), np.int64) for t in texts]
                targets, contexts = examples(streams, len(share))
                nce_pass(own, targets, contexts, share, rng, 0.1, scale)
                seen += len(targets)
        if seen:
            rows = own.rows()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows)), pa.int32()), pa.array(np.full(len(rows), float(seen))),
                 *[pa.array(rows[:, i]) for i in range(DIM)]], names=["row", "w", *[f"v{i}" for i in range(DIM)]])

    schema = "row int, w double, " + ", ".join(f"v{i} double" for i in range(DIM))
    mean = (docs.select(text.alias("t")).mapInArrow(run, schema).groupBy("row")
            .agg(*[(F.sum(F.col(f"v{i}") * F.col("w")) / F.sum("w")).alias(f"v{i}") for i in range(DIM)]).orderBy("row"))
    rows = np.array([tuple(r)[1:] for r in mean.collect()])  # one row per class, whatever the corpus
    return Parameters.of(rows, n) if len(rows) else p


def fit(docs: DataFrame, counts: DataFrame, text: Column) -> Model:
    """The model of the training rows ``docs`` with their ``word_counts``."""
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    # how many words have each count: sums of different counts are the corpus, so there are few
    left, least = KNOWN, None
    for r in sorted(counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        left -= r["n"]
        if left < 0:
            break
        least = r["c"]
    top = sorted(counts.where(F.col("c") >= least).collect(), key=lambda r: (-r["c"], bytes(r["word"]))) if least else []
    known = {bytes(r["word"]): r["c"] for r in top}
    head = [bytes(r["word"]) for r in top[:HEAD]]
    last = F.when(F.length("word") == 0, F.lit(0)).otherwise(
        F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int") % ENDINGS)
    tokens, words = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in counts.groupBy(last.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r["k"]], words[r["k"]] = r["n"], r["v"]
    for w in head:
        tokens[_ending(w)] -= known[w]
        words[_ending(w)] -= 1
    share = np.array([known[w] for w in head] + (tokens + 1).tolist(), float)
    share /= share.sum()
    return Model(head, _train(docs, text, head, list(known), share), known, total["n"] or 0, total["v"], tokens, words)


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    (add-one unigram) and ``score`` (the model), both log10 of the whole text's probability.

    ``training`` chooses the rows to learn from.  NULL and empty texts are the end token alone;
    repeated rows score alike; without training rows every class is as likely as any other.
    Rows are kept apart by their place in the scan, so ids may repeat or be NULL."""
    text = text_of(f"`{text_col}`")
    learn = docs.where(training)
    counts = materialise(word_counts(learn, text), "word-counts")
    model = fit(learn, counts, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        n_head = len(m.head)  # the head are the first known words
        number = _Numbers((w, i) for i, w in enumerate(m.known))
        value = np.log10(np.array([*m.known.values(), 0]) + 1.0)
        class_of = np.array([*[i if i < n_head else n_head + _ending(w) for w, i in number.items()], 0])
        size = np.log10(m.ending_tokens + m.ending_words + 1.0)
        whole = np.log10(m.tokens + m.distinct + 1.0)
        for batch in batches:
            ids, rid = batch.column(0), batch.column(2).to_pylist()
            for a, texts in text_slices(batch.column(1), 1 << 22):  # longer slices share more contexts
                z, split = a + len(texts), [words_of(t) for t in texts]
                n_tok = np.fromiter(map(len, split), np.int64, len(split))  # at least the end
                start = np.cumsum(n_tok) - n_tok
                nums = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(n_tok.sum()))
                cls = np.where(nums >= 0, class_of[np.maximum(nums, -1)], n_head - 1 - nums)
                targets, contexts = examples(np.split(cls, start[1:]), n_head + ENDINGS)
                logp = log_probabilities(m.parameters, targets, contexts) / np.log(10.0)
                x = value[np.maximum(nums, -1)]  # unknown: the zero at the end
                logp += np.where(cls >= n_head, x - size[np.maximum(cls - n_head, 0)], 0.0)
                new = nums < 0
                # unknown words become rows of their own, with their count in the text
                at, word, tf = list(range(a, z)), [b" %d" % r for r in rid[a:z]], [0] * len(split)  # no word has a space
                for i in np.flatnonzero(np.add.reduceat(new, start, dtype=np.int64)).tolist():
                    ws, n0 = split[i], start[i]
                    tail = Counter([ws[k] for k in np.flatnonzero(new[n0:n0 + n_tok[i]]).tolist()])
                    at += [a + i] * len(tail)
                    word += tail.keys()
                    tf += tail.values()
                zeros = np.zeros(len(at) - len(split), np.int64)
                n_known = np.r_[n_tok - np.add.reduceat(new, start, dtype=np.int64), zeros]
                base = np.r_[np.add.reduceat(x, start) - n_tok * whole, zeros]
                score = np.r_[np.add.reduceat(logp, start), zeros]
                n_tok = np.r_[n_tok, zeros]
                pick = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pick), batch.column(2).take(pick), pa.array(word, pa.binary()), pa.array(tf, pa.int64()),
                     pa.array(n_tok, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()),
                     pa.array(score, pa.float64())],
                    names=["id", "rid", "word", "tf", "n_tokens", "n_known", "base", "score"])

    src = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"), F.monotonically_increasing_id().alias("rid"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, rid long, word binary, tf long, n_tokens long, n_known long, base double, score double"
    rows = src.mapInArrow(run, schema)
    # a shuffled hash join: a partition of the counts has each word once, while the words of all
    # texts, far more rows, need no sort
    joined = rows.join(counts.withColumnRenamed("word", "w").hint("shuffle_hash"), F.col("word") == F.col("w"), "left")
    add = F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    seen = F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)
    return (joined.groupBy("rid").agg(
        F.max("id").alias(id_col), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + seen).alias("n_known"),
        F.sum(F.col("base") + add).alias("base_score"), F.sum(F.col("score") + add).alias("score"))
        .select(id_col, "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"))
