"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt: words and word beginnings that are much more frequent in texts
labelled toxic, as smoothed log-odds of document frequency.  A text's features are densities
of lexicon hits, hits near second-person words, capitals, punctuation and obfuscation.
Features come from one Arrow pass over whole texts; trees and calibration are Spark ML.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import ROW, crc32_mod, materialise, packed, text_of, unpacked
from tidewell.llm.tokenizing import text_slices

#: labelled rows used to fit trees and calibration, at most (chosen by a hash of the id); the
#: largest entries kept; parts of the labelled rows, each read with the lexicon of the others
FIT_ROWS = 16_000
LEXICON = 20_000
FOLDS = 5
#: entries that a task counts before it hands them on, and words whose entries it keeps
ENTRIES = 200_000
#: slots of the table that tells which entries may be candidates (fixed size, one byte each)
SLOTS = 1 << 22
#: lengths of word beginnings that may be lexicon entries
STEMS = (4, 5, 6, 7, 8)
LEAST_TEXTS = 4
LEAST_ODDS = 1.5
TREES, DEPTH = 40, 4
#: fixed values: second-person words of four languages
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer sie "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
#: fixed values: look-alikes of letters in obfuscated words
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
NEAR = 5
EDGES = ".,;:!?\"'()[]{}<>|%*$&#-_…«»“”„"
#: the same without marks that look like a letter
OUTER = EDGES.translate(dict.fromkeys(LOOKALIKE))

NAMES = ["weight_per_word", "hits_per_word", "strong_per_word", "log_hits", "log_strong", "top_weight",
         "second_person", "hits_near_person", "log_near_person", "capitals", "capital_words",
         "marks", "punctuation", "obfuscated", "log_obfuscated_hits", "log_words"]


def _core(word: str) -> str:
    return word.strip(EDGES).lower()


def _entries(core: str) -> list[str]:
    """Lexicon entries that a word can match: itself, and its beginnings (marked with *)."""
    return [core, *[core[:k] + "*" for k in STEMS if len(core) > k]] if core else []


class _Entries(dict):
    """Word → numbers of its entries, in ``ids``; number 0 (the empty entry) is in every text.
    With ``slots``, only entries whose slot is set."""

    def __init__(self, slots: np.ndarray | None = None):
        self.ids, self.slots = {"": 0}, slots

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids, found = self.ids, _entries(_core(word))
        if self.slots is not None:
            found = [e for e in found if self.slots[zlib.crc32(e.encode("utf-8", "surrogatepass")) % len(self.slots)]]
        out = self[word] = tuple([ids.setdefault(e, len(ids)) for e in found])
        return out


def count_entries(batches: Iterator[pa.RecordBatch], slots: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """What a task of ``entry_counts`` makes of its (text, fold) batches.  It holds the strings
    of one slice of texts and one table."""
    words, total = _Entries(slots), np.zeros(0, np.int64)

    def flush():
        cells = total[:len(words.ids) * FOLDS].reshape(-1, FOLDS)
        at = np.flatnonzero(cells.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(words.ids), pa.string()).take(pa.array(at)), *[pa.array(cells[at, k]) for k in range(FOLDS)]],
            names=["entry", *[f"n{k}" for k in range(FOLDS)]])

    for batch in batches:
        folds = batch.column(1).to_pylist()
        for a, texts in text_slices(batch.column(0), 1 << 19):
            found = []
            for t, k in zip(texts, folds[a:]):
                ids = {0}.union(*map(words.__getitem__, set(t.split())))
                found.append(np.fromiter(ids, np.int64, len(ids)) * FOLDS + k)
            at, n = np.unique(np.concatenate(found), return_counts=True)
            if len(words.ids) * FOLDS > len(total):
                total = np.r_[total, np.zeros(len(words.ids) * FOLDS * 2 - len(total), np.int64)]
            total[at] += n
            if len(words.ids) > ENTRIES:
                yield flush()
                words, total = _Entries(slots), np.zeros(0, np.int64)
            elif len(words) > ENTRIES:  # most words have no entry among the slots
                words.clear()
    if total.any():
        yield flush()


def entry_counts(rows: DataFrame, slots: np.ndarray | None = None) -> DataFrame:
    """(entry, n, n0, n1, ...): how many texts of (text, fold) hold an entry, and how many of
    them are in each fold; the empty entry counts all texts.  With ``slots``, entries of other
    slots are left out.  Tasks combine before they shuffle, in tables of about ``ENTRIES``."""
    sent = rows.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count_entries(batches, sent.value)

    folds = [f"n{k}" for k in range(FOLDS)]
    return (rows.select("text", F.col("fold").cast("int"))
            .mapInArrow(run, "entry string, " + ", ".join(f"{x} long" for x in folds))
            .groupBy("entry").agg(F.sum(reduce(lambda a, b: a + b, map(F.col, folds))).alias("n"),
                                  *[F.sum(x).alias(x) for x in folds]))


def candidate_counts(rows: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """(entry, t, c, t0, c0, ...): toxic and other texts of (text, label, fold) that hold an entry,
    for the entries of at least ``LEAST_TEXTS`` toxic texts and the empty one.  Toxic texts are
    counted first; other texts hand on only entries whose slot (of a fixed number) a candidate
    has, so that the few that share one by chance go in the join and the rest never travel."""
    spark = rows.sparkSession
    toxic = entry_counts(rows.where("label = 1")).where((F.col("n") >= LEAST_TEXTS) | (F.col("entry") == ""))
    toxic = materialise(toxic.select("entry", F.col("n").alias("t"), *[F.col(f"n{k}").alias(f"t{k}") for k in range(FOLDS)]),
                        "toxic-candidates")
    slots = np.zeros(n_slots, bool)
    used = toxic.select((F.crc32(F.col("entry").cast("binary")) % n_slots).alias("s")).distinct()
    slots[np.array([r["s"] for r in used.toLocalIterator()], np.int64)] = True
    other = entry_counts(rows.where("label = 0"), slots).withColumnsRenamed(
        {"n": "c", **{f"n{k}": f"c{k}" for k in range(FOLDS)}})
    counts = [x + k for k in ["", *map(str, range(FOLDS))] for x in "tc"]
    return (toxic.join(other.withColumnRenamed("entry", "e"), F.col("entry") == F.col("e"), "left")
            .select("entry", *[F.coalesce(x, F.lit(0)).alias(x) for x in counts]))


def learn_lexicons(rows: DataFrame) -> tuple[dict[str, float], list[dict[str, float]]]:
    """{entry: log-odds} from all (text, label, fold) rows, and for each fold the same from the
    rows outside it.  Only the strongest ``LEXICON`` entries that pass both limits reach the
    driver."""
    counts = materialise(candidate_counts(rows), "toxic-entries")
    every = counts.where("entry = ''").first()
    if every is None:
        return {}, [{}] * FOLDS

    def learn(t, c, bad: int, good: int) -> dict[str, float]:
        odds = F.log((t + 0.25) / (bad + 0.5)) - F.log((c + 0.25) / (good + 0.5))
        top = (counts.where(F.col("entry") != "").select("entry", t.alias("n"), odds.alias("w"))
               .where((F.col("n") >= LEAST_TEXTS) & (F.col("w") >= LEAST_ODDS))
               .orderBy(F.desc(F.col("w") * F.sqrt("n")), "entry").limit(LEXICON))
        return {r["entry"]: round(r["w"], 6) for r in top.collect()}

    return learn(F.col("t"), F.col("c"), every["t"], every["c"]), [
        learn(F.col("t") - F.col(f"t{k}"), F.col("c") - F.col(f"c{k}"), every["t"] - every[f"t{k}"], every["c"] - every[f"c{k}"])
        for k in range(FOLDS)]


class _Words(dict):
    """Word → number of its row in the tables below; bounded, kept per worker process."""

    LIMIT = 400_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self._clear()

    def _clear(self) -> None:
        self.clear()
        self.weight, self.strong, self.person, self.masked, self.capital, self.upper = [], [], [], [], [], []

    def best(self, core: str) -> float:
        return max((self.lexicon.get(e, 0.0) for e in _entries(core)), default=0.0)

    def __missing__(self, word: str) -> int:
        core = _core(word)
        weight, hidden, masked = self.best(core), 0.0, False
        if not core.isalpha():  # letters only hide nothing
            plain = core.translate(LOOKALIKE)
            squeezed = "".join(c for c in plain if c.isalpha())
            masked = len(core) >= 3 and squeezed != core and any(c.isalpha() for c in core)
            hidden = max(self.best(squeezed), self.best(plain)) if masked else 0.0
        if word[0] in "$!" or word[-1] in "$!":
            # marks at the ends may stand for letters too ($tupid): the whole word must then be an entry
            plain = word.lower().strip(OUTER).translate(LOOKALIKE)
            if plain != core and self.lexicon.get(plain, 0.0) > max(weight, hidden):
                masked, hidden = True, self.lexicon[plain]
        best = max(weight, hidden)
        at = self[word] = len(self.weight)
        self.weight.append(best)
        self.strong.append(best >= 4.0)
        self.person.append(core in SECOND_PERSON)
        self.masked.append(2.0 * (hidden > weight) + masked)
        self.capital.append(len(core) > 1 and word.isupper())
        self.upper.append(0 if word.islower() else sum(map(str.isupper, word)))
        return at

    def rows(self, texts: list[str]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self._clear()
        split = [t.split() for t in texts]
        codes = [np.fromiter(map(self.__getitem__, ws), np.int64, len(ws)) for ws in split]
        table = np.array([self.weight, self.strong, self.person, self.masked, self.capital, self.upper], float)
        return np.array([self._features(t, c, table) for t, c in zip(texts, codes)]).reshape(len(texts), len(NAMES))

    @staticmethod
    def _features(text: str, code: np.ndarray, table: np.ndarray) -> list[float]:
        n, chars = max(1, len(code)), max(1, len(text))
        weight, strong, person, masked, capital, upper = table[:, code] if len(code) else np.zeros((6, 0))
        hit = weight > 0
        near = 0
        if person.any() and hit.any():
            at = np.flatnonzero(person)
            where = np.flatnonzero(hit)
            right = np.searchsorted(at, where)
            gap = np.minimum(np.abs(where - at[np.minimum(right, len(at) - 1)]), np.abs(where - at[np.maximum(right - 1, 0)]))
            near = int((gap <= NEAR).sum())
        hits = int(hit.sum())
        marks = text.count("!") + text.count("?")
        marked = sum(text.count(c) for c in ".,;:'\"-|%*$&#@()")
        return [weight.sum() / n, hits / n, strong.sum() / n, np.log1p(hits), np.log1p(strong.sum()),
                weight.max() if len(weight) else 0.0, person.sum() / n, near / n, np.log1p(near), upper.sum() / chars,
                capital.sum() / n, marks / chars, marked / chars, (masked > 0).sum() / n,
                np.log1p((masked > 1).sum()), np.log1p(len(code))]


_words: dict[int, _Words] = {}


def features(docs: DataFrame, lexicon: dict[str, float], text_col: str = "text", carry=("doc_id",)) -> DataFrame:
    """``carry`` and ``x`` (the features, in the order of ``NAMES``) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    carry = [c for c in carry if c != "x"]
    src = docs.select(packed(docs, carry), text_of(f"`{text_col}`").alias("__tw_text"))
    schema = src.drop("__tw_text").schema.add("x", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held.id if hasattr(held, "id") else hash(frozenset(held.value.items()))
        if key not in _words:
            _words.clear()
            _words[key] = _Words(held.value)
        words = _words[key]
        for batch in batches:
            for a, texts in text_slices(batch.column(1)):
                x = words.rows(texts)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(NAMES)), pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), flat], names=schema.names)

    return src.mapInArrow(run, schema).select(*unpacked(carry), "x")


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    bounds: tuple[float, ...]
    values: tuple[float, ...]

    def calibrated(self, margin):
        """Isotonic step ends, linear in between, as a column expression."""
        b, v = self.bounds, self.values
        out = F.lit(v[-1])
        for (b0, v0), (b1, v1) in reversed(list(zip(zip(b, v), zip(b[1:], v[1:])))):
            line = F.lit(v0) + (margin - b0) * ((v1 - v0) / (b1 - b0) if b1 > b0 else 0.0)
            out = F.when(margin < b1, line).otherwise(out)
        return F.when(margin <= b[0], F.lit(v[0])).otherwise(out)


def _margin(trees: GBTClassificationModel, df: DataFrame) -> DataFrame:
    scored = trees.transform(df.withColumn("features", array_to_vector("x")))
    return scored.withColumn("margin", vector_to_array("rawPrediction")[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
                 text_col: str = "text", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn from the labelled rows outside the held-out fifth (crc32 of the id as text, modulo
    5, is 0).  The lexicon is counted on all of them.  Trees and calibration learn on two parts
    of a sample, whose texts are read with a lexicon counted on all rows outside the text's fold,
    so that its entries look as surprising as on new texts.

    One class only, or too few rows: the score is that class's smoothed share."""
    own = (labels.where(F.col(label).isNotNull() & (crc32_mod(id_col, 5) != 0))
           .groupBy(F.col(id_col).alias("__tw_l")).agg(F.max(label).cast("int").alias("label")))
    share = min(1.0, fit_rows / max(1, own.count()))
    picked = (docs.where(crc32_mod(f"`{id_col}`", 5) != 0)
              .select(F.col(f"`{id_col}`").alias("__tw_id"), text_of(f"`{text_col}`").alias("text")))
    part = F.pmod(F.xxhash64("__tw_id", F.lit("part")), F.lit(10))
    in_fit = F.pmod(F.xxhash64("__tw_id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20))
    # labels grow with the documents, so the join shuffles at every size; texts move once
    every = materialise(picked.join(own.hint("merge"), F.col("__tw_id") == F.col("__tw_l"))
                        .select("text", "label", part.alias("part"), (part % FOLDS).alias("fold"), in_fit.alias("fit")),
                        "toxic-labelled", compression="zstd")
    rows = every.where("fit")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2 or sum(n.values()) < 20:
        rate = (n.get(1, 0) + 1.0) / (sum(n.values()) + 2.0)
        return ToxicityModel({}, None, (0.0,), (rate,))
    lexicon, others = learn_lexicons(every)
    made = materialise(reduce(DataFrame.unionByName, [
        features(rows.where(F.col("fold") == k), words, "text", ("label", "part")) for k, words in enumerate(others)]), "toxic-features")
    fit = made.where("part < 6").withColumn("features", array_to_vector("x"))
    if fit.select("label").distinct().count() < 2:
        fit = made.withColumn("features", array_to_vector("x"))
    trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.15, subsamplingRate=0.8,
                          minInstancesPerNode=5, maxBins=64, seed=11).fit(fit)
    held = _margin(trees, made.where("part >= 6"))
    if held.select("label").distinct().count() < 2:
        held = _margin(trees, made)
    iso = IsotonicRegression(featuresCol="margin", labelCol="label").fit(held.select("margin", F.col("label").cast("double")))
    smooth = 1.0 / (2.0 + sum(n.values()))  # never exactly 0 or 1
    values = [min(1 - smooth, max(smooth, v)) for v in iso.predictions.toArray().tolist()]
    return ToxicityModel(lexicon, trees, tuple(iso.boundaries.toArray().tolist()), tuple(values))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", carry=("doc_id",)) -> DataFrame:
    """``carry`` and ``score`` of every whole text; NULL and empty texts score as a text without
    words; ties and repeated rows score alike; an empty table gives an empty result."""
    carry = [c for c in carry if c != "score"]
    if model.trees is None:
        return docs.select(*[F.col(f"`{c}`") for c in carry], F.lit(model.values[0]).alias("score"))
    names = {c: f"__tw_c{i}" for i, c in enumerate(carry)}
    x = features(docs.withColumnsRenamed(names), model.lexicon,
                 names.get(text_col, text_col), list(names.values()))
    scored = _margin(model.trees, x)
    return scored.select(*[F.col(v).alias(k) for k, v in names.items()], model.calibrated(F.col("margin")).alias("score"))
