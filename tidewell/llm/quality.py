"""Quality classifier: a sparse rule ensemble, compiled into Spark column expressions.

Statistics of the whole text are column expressions.  A random forest of shallow trees is
fitted on labelled rows; every path to a node is a conjunctive rule over the statistics; a
lasso logistic regression weights the rules and drops most; the rules left are one column
expression, so scoring is a projection over the text with no Python and no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import crc32_mod, materialise, text_of

#: labelled rows used to fit, at most (chosen by a hash of the id)
FIT_ROWS = 40_000
TREES, DEPTH = 24, 3
LASSO = 0.001
KEEP_FROM = 0.3
#: fixed values: characters of tables, markup and mojibake, as one class
SYMBOLS = r"|%*$&#@~^<>{}\[\]\\=_+/"


def words_of(text: Column) -> Column:
    return F.split(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")), " ")


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Statistics of a text (never NULL; an empty text has zeros and ratios of zero) and of its
    ``words_of``, a column of its own because it is used more than once."""
    n, count = F.length(text), F.size(words)
    lines = F.split(text, r"[.\n]")
    before = F.concat(F.array(F.lit(None).cast("string")), words)

    def share(kept: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{kept}]", "")) / F.greatest(n, F.lit(1))

    return {
        "log_chars": F.log1p(n),
        "word_length": (n - count + 1) / count,
        "distinct_words": F.size(F.array_distinct(words)) / count,
        "root_words": F.size(F.array_distinct(words)) / F.sqrt(count),
        "doubled_words": F.size(F.filter(F.zip_with(words, before, lambda a, b: a == b), lambda x: x)) / count,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "words_per_line": F.least(count / F.size(lines), F.lit(200.0)),
        "upper": share(r"\p{Lu}"),
        "digits": share("0-9"),
        "symbols": share(SYMBOLS),
        "bars": (n - F.length(F.replace(text, F.lit("|"), F.lit("")))) / F.greatest(n, F.lit(1)),
        "marks": (n - F.length(F.replace(text, F.lit("!"), F.lit("")))) / F.greatest(n, F.lit(1)),
        "stops": (n - F.length(F.replace(text, F.lit("."), F.lit("")))) / F.greatest(n, F.lit(1)),
    }


#: the statistics, in the order of the feature vector
NAMES = [
    "log_chars", "word_length", "distinct_words", "root_words", "doubled_words", "distinct_lines",
    "words_per_line", "upper", "digits", "symbols", "bars", "marks", "stops"]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, threshold), and its weight."""
    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, stat) -> Column:
        return reduce(lambda a, b: a & b, [stat(n) > t if above else stat(n) <= t for n, above, t in self.terms])


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self, stat=F.col) -> Column:
        """P(label 1) as a column over the statistics' columns."""
        margin = reduce(lambda a, b: a + b, [F.when(r.holds(stat), F.lit(r.weight)).otherwise(F.lit(0.0))
                                            for r in self.rules], F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-margin))


def _paths(node, names, terms=()) -> list[tuple]:
    """Every path from the root to a node below it, as a sorted conjunction."""
    out = [tuple(sorted(terms))] if terms else []
    if node.subtreeDepth() == 0:
        return out
    split = node.split()
    name, at = names[split.featureIndex()], float(split.threshold())
    return (out + _paths(node.leftChild(), names, (*terms, (name, False, at)))
            + _paths(node.rightChild(), names, (*terms, (name, True, at))))


def _tidy(terms: tuple) -> tuple:
    """One bound per statistic and side."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, at in terms:
        old = best.get((name, above))
        best[(name, above)] = at if old is None else (max if above else min)(old, at)
    return tuple(sorted((n, a, t) for (n, a), t in best.items()))


def fit_rules(stats: DataFrame, label_col: str = "label", seed: int = 7) -> RuleModel:
    """Fit on a small table of statistics and a 0/1 label.  One class only: a model without
    rules that always gives that class's smoothed share; no rows: one half."""
    counts = stats.groupBy(label_col).count().collect()
    by = {int(r[label_col]): r["count"] for r in counts}
    total = sum(by.values())
    if len(by) < 2:
        share = (by.get(1, 0) + 1) / (total + 2)
        return RuleModel((), math.log(share / (1 - share)))
    rows = stats.select(array_to_vector(F.array(*[F.col(n).cast("double") for n in NAMES])).alias("features"),
                        F.col(label_col).cast("double").alias("label"), *NAMES)
    # balance the classes by weight, so that paths to the rarer one are found
    weight = F.when(F.col("label") == 1, F.lit(total / 2 / by[1])).otherwise(F.lit(total / 2 / by[0]))
    rows = rows.withColumn("w", weight)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, weightCol="w", subsamplingRate=0.7,
                                    featureSubsetStrategy="0.5", minInstancesPerNode=5, maxBins=64).fit(rows)
    found = {_tidy(p) for tree in forest.trees for p in _paths(tree._call_java("rootNode"), NAMES)}
    rules = [Rule(t) for t in sorted(found)]
    hits = rows.select("label", array_to_vector(F.array(*[r.holds(F.col).cast("double") for r in rules])).alias("rules"))
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=LASSO,
                               standardization=False, maxIter=60).fit(hits)
    kept = tuple(Rule(r.terms, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-9)
    return RuleModel(kept, float(lasso.intercept))


def with_statistics(docs: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    split = docs.withColumn("__tw_words", words_of(text_of(f"`{text_col}`")))
    stats = statistics(text_of(f"`{text_col}`"), F.col("__tw_words"))
    return split.withColumns({prefix + k: v for k, v in stats.items()}).drop("__tw_words")


def _labelled(stats: DataFrame, labels: DataFrame, label: str, id_col: str, fit_rows: int) -> DataFrame:
    """Statistics with a label, of rows outside the held-out fifth; at most about ``fit_rows``."""
    own = (labels.where(F.col(label).isNotNull() & (crc32_mod(id_col, 5) != 0))
           .groupBy(F.col(id_col).alias("__tw_l")).agg(F.max(label).alias("label")))
    share = min(1.0, fit_rows / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("__tw_l", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)))
    return stats.join(own, F.col(id_col) == F.col("__tw_l")).drop("__tw_l")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
                text_col: str = "text", fit_rows: int = FIT_ROWS) -> RuleModel:
    """Learn from the labelled rows of ``docs`` outside the held-out fifth (crc32 of the id as
    text, modulo 5, is 0); ids only join and choose rows."""
    stats = with_statistics(docs.select(id_col, text_col), text_col).drop(text_col)
    return fit_rules(materialise(_labelled(stats, labels, label, id_col, fit_rows), "quality-fit"))


def score_quality(docs: DataFrame, model: RuleModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text (NULL text: as empty); an input column of
    that name is replaced.  No shuffle; ties and repeated rows score alike."""
    own = docs.drop(score_col)
    stats = with_statistics(own, text_col, "__tw_")
    return stats.select(*[F.col(f"`{c}`") for c in own.columns],
                        model.score(lambda n: F.col(f"__tw_{n}")).alias(score_col))


def keep_quality(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``keep_from`` or more, columns unchanged."""
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    scored = score_quality(docs, model, text_col, "__tw_quality")
    return scored.where(F.col("__tw_quality") >= keep_from).select(*[F.col(f"`{c}`") for c in docs.columns])
