"""Model families on ``pyspark.ml``.

Every model maps a table (id, features…) to a long probability table
(id, class, p) with one row per class; the predicted class is the argmax.
Classes are indexed alphabetically (M20).  Fitting runs on executors through
``pyspark.ml``; the driver keeps only model metadata.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.columns import c
from tidewell.operators.extratrees import fit_extra_trees
from tidewell.operators.knn import knn_join
from tidewell.spec import Spec

# Model family names as they appear in the reference's leaderboards.
FAMILIES = ("RandomForestGini", "RandomForestEntr", "ExtraTreesGini", "ExtraTreesEntr", "LightGBM",
            "LightGBMXT", "LightGBMLarge", "CatBoost", "XGBoost", "NeuralNetTorch", "NeuralNetFastAI",
            "LR", "KNeighborsUnif", "KNeighborsDist")
# neighbours of the kNN families (the estimator default the source's kNN models use)
KNN_NEIGHBORS = 5
# more tree nodes per pass over the data, node ids cached between levels
TREE_KW = dict(maxMemoryInMB=1024, cacheNodeIds=True)
FORESTS = {"RandomForestGini", "RandomForestEntr", "ExtraTreesGini", "ExtraTreesEntr"}
WEIGHTED = {"RandomForestGini", "RandomForestEntr", "ExtraTreesGini", "ExtraTreesEntr", "LightGBM",
            "LightGBMXT", "LightGBMLarge", "CatBoost", "XGBoost", "LR"}


@dataclass
class Trained:
    name: str
    family: str
    classes: list
    features: list
    model: object = None            # PipelineModel, or a list of them (bagged), or kNN state
    fit_time: float = 0.0
    stack_level: int = 1
    extra: dict = field(default_factory=dict)


def encode_labels(df: DataFrame, label_col: str = "label") -> list:
    """Sorted class list (one row per class reaches the driver)."""
    return sorted(r[0] for r in df.select(label_col).distinct().collect() if r[0] is not None)


def label_index(classes: list, label_col: str = "label"):
    """Class → index expression (alphabetical order, like StringIndexer alphabetAsc)."""
    m = F.create_map(*[x for i, cl in enumerate(classes) for x in (F.lit(cl), F.lit(float(i)))])
    return m[F.col(label_col)]


def _estimator(family: str, n_classes: int, n_features: int, seed: int, weight_col: str | None):
    kw = dict(featuresCol="features", labelCol="__y", seed=seed)
    if weight_col:
        kw["weightCol"] = weight_col
    if family in ("RandomForestGini", "RandomForestEntr"):
        return RandomForestClassifier(impurity="gini" if family.endswith("Gini") else "entropy",
                                      numTrees=100, maxDepth=12, **TREE_KW, **kw)
    if family in ("LightGBM", "LightGBMXT", "LightGBMLarge", "CatBoost", "XGBoost"):
        depth = {"LightGBMLarge": 8, "LightGBMXT": 4, "CatBoost": 6}.get(family, 5)
        iters = {"LightGBMLarge": 60}.get(family, 40)
        gkw = dict(kw)
        gkw.pop("labelCol")
        gkw.pop("featuresCol")
        base = GBTClassifier(maxDepth=depth, maxIter=iters, stepSize=0.1, **TREE_KW,
                             subsamplingRate=0.8 if family == "LightGBMXT" else 1.0, **gkw)
        # the binary models of the classes are fit concurrently (one Spark job each)
        ovr = dict(classifier=base, featuresCol="features", labelCol="__y", parallelism=min(8, max(1, n_classes)))
        return OneVsRest(weightCol=weight_col, **ovr) if weight_col else OneVsRest(**ovr)
    if family in ("NeuralNetTorch", "NeuralNetFastAI"):
        hidden = [64, 32] if family == "NeuralNetTorch" else [32]
        kw.pop("weightCol", None)
        return MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], maxIter=100,
                                              featuresCol="features_s", labelCol="__y", seed=seed)
    if family == "LR":
        kw.pop("seed")
        return LogisticRegression(family="multinomial", maxIter=200, regParam=1e-4, **kw)
    raise ValueError(f"unknown family {family!r}")


def few_parts(data: DataFrame) -> DataFrame:
    """``data`` dealt evenly to as many partitions as tasks run at once, when it has more than twice as many:
    a forest makes, and sends, a table of all open nodes per level and partition, whatever its rows, and
    the other models send their sums per pass and partition."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    return data.repartition(cores) if data.rdd.getNumPartitions() > 2 * cores else data


def fit_model(train: DataFrame, spec: Spec, family: str, name: str | None = None, seed: int = 42,
              weight_col: str | None = None, classes: list | None = None) -> Trained:
    """M1: fit one family on (features…, label[, weight]); NULL features are not allowed
    (impute first)."""
    classes = classes if classes is not None else encode_labels(train, spec.label_col)
    feats = list(spec.feats)
    t0 = time.time()
    if family.startswith("KNeighbors"):
        k = KNN_NEIGHBORS
        base = train.select(c(spec.id_col).cast("string").alias(spec.id_col), *[c(x) for x in feats],
                            c(spec.label_col).alias("__lab"))
        return Trained(name or family, family, classes, feats, {"base": base, "k": k},
                       time.time() - t0, extra={"weights": "uniform" if family.endswith("Unif") else "distance"})
    data = train.withColumn("__y", label_index(classes, spec.label_col))
    stages = [VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="error")]
    if family.startswith("NeuralNet"):
        stages.append(StandardScaler(inputCol="features", outputCol="features_s", withMean=True, withStd=True))
    use_w = weight_col if family in WEIGHTED else None
    if family in FORESTS:
        data = few_parts(data.select(*[c(x) for x in feats], "__y", *([c(use_w)] if use_w else [])))
    if family in ("ExtraTreesGini", "ExtraTreesEntr"):
        # Spark's forests have no random thresholds
        trees = fit_extra_trees(data, feats, len(classes), "gini" if family.endswith("Gini") else "entropy", 100, 12, seed, use_w)
        return Trained(name or family, family, classes, feats, PipelineModel([*stages, trees]), time.time() - t0)
    stages.append(_estimator(family, len(classes), len(feats), seed, use_w))
    model = Pipeline(stages=stages).fit(data)
    return Trained(name or family, family, classes, feats, model, time.time() - t0)


def _probs_from_vector(scored: DataFrame, id_col: str, classes: list, col: str = "__pv") -> DataFrame:
    return (scored.select(c(id_col).cast("string").alias(id_col), F.posexplode(col).alias("__i", "p"))
                  .withColumn("class", F.element_at(F.array(*[F.lit(x) for x in classes]), F.col("__i") + 1))
                  .select(id_col, "class", "p"))


_GBT = ("LightGBM", "LightGBMXT", "LightGBMLarge", "CatBoost", "XGBoost")
_PIPE_COLS = ("features", "features_s", "rawPrediction", "probability", "prediction")


def _combine(cols: list[str], weights: list[float], n: int):
    """Σ_i w_i · array_i, element-wise (arrays of length n).

    The arrays are arguments, never read inside a lambda: Spark would put the model behind an
    array into the lambda and score the row once per class."""
    def scaled(w):
        return lambda x: F.lit(float(w)) * x

    def added(w):
        return lambda a, x: a + F.lit(float(w)) * x
    total = None
    for col, w in zip(cols, weights):
        total = F.transform(F.col(col), scaled(w)) if total is None else F.zip_with(total, F.col(col), added(w))
    return _padded(total, n)


def _padded(values, n: int):
    """The first ``n`` values of an array; those it lacks are 0."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), n)), 1, n)


def proba_vector(m: Trained, df: DataFrame, id_col: str = "id", out: str = "__pv") -> DataFrame:
    """``df`` plus ``out`` = class probabilities (array in ``m.classes`` order).

    Pipeline models, bagged fold models, stackers and weighted ensembles are chained
    transforms over the same rows — no shuffle; only the kNN family joins its votes back
    by key."""
    nc = len(m.classes)
    if isinstance(m.model, list):  # bagged: mean of the fold models
        cols = []
        for i, sub in enumerate(m.model):
            cols.append(f"{out}_f{i}")
            df = proba_vector(Trained(m.name, m.family, m.classes, m.features, sub, extra=m.extra), df, id_col, cols[-1])
        return df.withColumn(out, _combine(cols, [1.0 / len(cols)] * len(cols), nc)).drop(*cols)
    if m.family.startswith("KNeighbors"):
        return _knn_vector(m, df, id_col, out)
    if m.family == "WeightedEnsemble":
        cols, ws = [], []
        for i, (sub, w) in enumerate(m.extra["members"]):
            cols.append(f"{out}_m{i}")
            ws.append(w)
            df = proba_vector(sub, df, id_col, cols[-1])
        return df.withColumn(out, _combine(cols, ws, nc)).drop(*cols)
    if m.family == "Stacker":
        added = []
        for b in m.extra["l1"]:
            tmp = f"__l1_{b.family}"
            df = proba_vector(b, df, id_col, tmp)
            names = {f"{b.family}__{cl}": F.element_at(F.col(tmp), j + 1) for j, cl in enumerate(m.classes)}
            df = df.withColumns(names).drop(tmp)
            added += list(names)
        return proba_vector(m.extra["top"], df, id_col, out).drop(*added)
    keep = df.columns
    scored = m.model.transform(df)
    if m.family in _GBT:
        # one-vs-rest margins → logistic per class → renormalised
        sig = F.transform(vector_to_array("rawPrediction"), lambda x: 1.0 / (1.0 + F.exp(-2.0 * x)))
        scored = scored.withColumn(out + "_s", _padded(sig, nc))
        tot = F.aggregate(out + "_s", F.lit(0.0), lambda a, x: a + x)
        scored = scored.withColumn(out, F.transform(out + "_s", lambda x: x / tot)).drop(out + "_s")
    else:
        # a class that the train rows lack scores 0
        scored = scored.withColumn(out, _padded(vector_to_array("probability"), nc))
    return scored.drop(*[x for x in _PIPE_COLS if x not in keep])


def _knn_vector(m: Trained, df: DataFrame, id_col: str, out: str) -> DataFrame:
    base, k = m.model["base"], m.model["k"]
    nn = knn_join(df.select(c(id_col), *[c(x) for x in m.features]), base, k, m.features, id_col=id_col,
                  base_passthrough=["__lab"])
    if m.extra.get("weights") == "distance":
        w = F.when(F.col("dist") == 0, F.lit(1e12)).otherwise(1.0 / F.col("dist"))
    else:
        w = F.lit(1.0)
    votes = nn.groupBy("probe_id", "__lab").agg(F.sum(w).alias("__w"))
    per = votes.groupBy("probe_id").agg(F.map_from_entries(F.collect_list(F.struct("__lab", "__w"))).alias("__m"),
                                        F.sum("__w").alias("__t"))
    vec = per.select(F.col("probe_id").alias("__kid"), F.array(*[
        F.coalesce(F.col("__m")[F.lit(cl)], F.lit(0.0)) / F.col("__t") for cl in m.classes]).alias(out))
    j = df.join(vec, c(id_col).cast("string") == F.col("__kid"), "left").drop("__kid")
    return j.withColumn(out, F.coalesce(F.col(out), F.array(*[F.lit(0.0)] * len(m.classes))))


def predict_proba(m: Trained, df: DataFrame, id_col: str = "id") -> DataFrame:
    """M9: (id, class, p) for every row and class."""
    v = proba_vector(m, df, id_col, "__pv")
    return _probs_from_vector(v, id_col, m.classes)


def with_prediction(m: Trained, df: DataFrame, id_col: str = "id", pred_col: str = "predicted",
                    pmax_col: str = "p_max") -> DataFrame:
    """``df`` plus the predicted class (argmax of the row's probability array; ties → the
    first class in alphabetical order) and its probability — a projection on the same rows."""
    v = proba_vector(m, df, id_col, "__pv")
    top = F.array_max("__pv")
    return v.withColumns({
        pred_col: F.element_at(F.array(*[F.lit(x) for x in m.classes]), F.array_position("__pv", top).cast("int")),
        pmax_col: top}).drop("__pv")


def predict(m: Trained, df: DataFrame, id_col: str = "id") -> DataFrame:
    """M9: (id, predicted, p_max); no shuffle for pipeline models and their ensembles."""
    return with_prediction(m, df, id_col).select(c(id_col).cast("string").alias(id_col), "predicted", "p_max")


def accuracy(m: Trained, df: DataFrame, spec: Spec) -> float:
    """Share of rows whose predicted class equals the label (scored on the rows themselves)."""
    scored = with_prediction(m, df, spec.id_col, "__pred", "__pmax")
    r = scored.agg(F.avg((F.col("__pred") == c(spec.label_col)).cast("double")).alias("a")).collect()[0]["a"]
    return float("nan") if r is None else float(r)


METRICS = ("accuracy", "balanced_accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro", "mcc",
           "log_loss")


def score_metrics(m: Trained, df: DataFrame, spec: Spec, metrics: Sequence[str] = ("accuracy",)) -> dict[str, float]:
    """Metrics of one model in one pass: counts per (label, predicted), at most classes², and
    the summed log loss.  All are "higher is better" but ``log_loss``, which is negated."""
    bad = [x for x in metrics if x not in METRICS]
    if bad:
        raise ValueError(f"no such metric: {', '.join(bad)}; there are {', '.join(METRICS)}")
    scored = proba_vector(m, df, spec.id_col, "__pv")
    top = F.element_at(F.array(*[F.lit(x) for x in m.classes]),
                       F.array_position("__pv", F.array_max("__pv")).cast("int"))
    own = F.element_at("__pv", F.array_position(F.array(*[F.lit(x) for x in m.classes]), c(spec.label_col)).cast("int"))
    loss = -F.log(F.greatest(F.coalesce(own, F.lit(0.0)), F.lit(1e-15)))
    known = F.array_contains(F.array(*[F.lit(x) for x in m.classes]), c(spec.label_col))
    rows = (scored.select(c(spec.label_col).alias("y"), top.alias("p"), F.when(known, loss).otherwise(-F.log(F.lit(1e-15))).alias("l"))
            .groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("l")).collect())
    total = sum(r["n"] for r in rows)
    if not total:
        return dict.fromkeys(metrics, float("nan"))
    real, said, hit = {}, {}, {}
    for r in rows:
        real[r["y"]] = real.get(r["y"], 0) + r["n"]
        said[r["p"]] = said.get(r["p"], 0) + r["n"]
        if r["y"] == r["p"]:
            hit[r["y"]] = r["n"]
    both = sorted(set(real) | set(said), key=str)
    recall = {x: hit.get(x, 0) / real[x] for x in real}
    prec = {x: hit.get(x, 0) / said[x] if said.get(x) else 0.0 for x in both}
    f1 = {x: 2 * hit.get(x, 0) / (real.get(x, 0) + said.get(x, 0)) for x in both}
    right = sum(hit.values())
    cov = right * total - sum(real.get(x, 0) * said.get(x, 0) for x in both)
    spread = ((total ** 2 - sum(v * v for v in said.values())) * (total ** 2 - sum(v * v for v in real.values()))) ** 0.5
    every = {"accuracy": right / total, "balanced_accuracy": sum(recall.values()) / len(recall),
             "f1_macro": sum(f1.values()) / len(both), "f1_weighted": sum(f1[x] * n for x, n in real.items()) / total,
             "precision_macro": sum(prec.values()) / len(both),
             "recall_macro": sum(recall.get(x, 0.0) for x in both) / len(both),
             "mcc": cov / spread if spread else 0.0, "log_loss": -sum(r["l"] for r in rows) / total}
    return {x: every[x] for x in metrics}


def _timed(fn):
    t0 = time.time()
    v = fn()
    return v, time.time() - t0


def leaderboard(models: list[Trained], spec: Spec, test: DataFrame | None = None,
                val: DataFrame | None = None, metric: str = "accuracy", parallelism: int = 4,
                extra_metrics: Sequence[str] = ()) -> DataFrame:
    """One row per model: model, score_test, score_val (both of ``metric``), eval_metric,
    prediction and fit times (an ensemble's fit time adds its members'; a prediction runs the
    members too, so its marginal time is its own less theirs), stack_level, can_infer,
    fit_order, and one column per extra metric, scored on test (on val without a test)."""
    names = [metric, *[x for x in extra_metrics if x != metric]]

    def score(item):
        order, m = item
        st, tt = _timed(lambda: score_metrics(m, test, spec, names)) if test is not None else ({}, None)
        sv, tv = (_timed(lambda: score_metrics(m, val, spec, names if test is None else [metric]))
                  if val is not None else ({}, None))
        return m, order, st, tt, sv, tv

    scored = parallel_map(score, list(enumerate(models, start=1)), parallelism)
    times = {m.name: (tt, tv) for m, _, _, tt, _, tv in scored}

    def own(m, i, t):
        inner = [times[s.name][i] for s, _ in m.extra.get("members", []) if s.name in times]
        return None if t is None else max(0.0, t - sum(x or 0.0 for x in inner))

    rows = []
    for m, order, st, tt, sv, tv in scored:
        member_fit = sum(s.fit_time for s, _ in m.extra.get("members", []))
        rows.append((m.name, _nan(st.get(metric)), _nan(sv.get(metric)), metric, tt, tv, m.fit_time + member_fit,
                     own(m, 0, tt), own(m, 1, tv), m.fit_time, m.stack_level, True, order,
                     *[_nan((st or sv).get(x)) for x in extra_metrics]))
    schema = ("model string, score_test double, score_val double, eval_metric string, pred_time_test double, "
              "pred_time_val double, fit_time double, pred_time_test_marginal double, "
              "pred_time_val_marginal double, fit_time_marginal double, stack_level int, can_infer boolean, "
              "fit_order int") + "".join(f", {x} double" for x in extra_metrics)
    spark = (test if test is not None else val).sparkSession
    return spark.createDataFrame(rows, schema)


def _nan(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


def parallel_map(fn, items, parallelism: int = 4) -> list:
    """Run independent Spark jobs from a small thread pool (as ``CrossValidator(parallelism=…)``
    does): small fits leave most cores idle, so several of them share the cluster."""
    items = list(items)
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=min(parallelism, len(items))) as pool:
        return list(pool.map(fn, items))


def fit_many(train: DataFrame, spec: Spec, families, seed: int = 42, weight_col: str | None = None,
             suffix: str = "", parallelism: int = 4) -> list[Trained]:
    """M2: fit every family (train should be persisted by the caller); families are fit
    concurrently."""
    classes = encode_labels(train, spec.label_col)
    return parallel_map(lambda f: fit_model(train, spec, f, f + suffix, seed, weight_col, classes),
                        list(families), parallelism)


def _parts(m: Trained) -> dict[str, Trained]:
    """The models that ``m`` is made of, by the folder each is saved in."""
    if isinstance(m.model, list):
        return {f"fold_{i}": Trained(f"{m.name}_F{i}", m.family, m.classes, m.features, sub, extra=m.extra)
                for i, sub in enumerate(m.model)}
    if m.family == "WeightedEnsemble":
        return {f"member_{i}": sub for i, (sub, _) in enumerate(m.extra["members"])}
    if m.family == "Stacker":
        return {"top": m.extra["top"], **{f"l1_{i}": b for i, b in enumerate(m.extra["l1"])}}
    return {}


def save_model(m: Trained, path: str, spark: SparkSession) -> None:
    """Save any model below ``path``, its parts in folders of their own: pipelines by
    ``pyspark.ml``, neighbours as their table, ensembles by their members and weights."""
    parts = _parts(m)
    meta = {"name": m.name, "family": m.family, "classes": m.classes, "features": list(m.features),
            "fit_time": m.fit_time, "stack_level": m.stack_level, "parts": list(parts),
            "bagged": isinstance(m.model, list),
            "extra": {k: v for k, v in m.extra.items() if isinstance(v, (str, int, float))},
            "weights": [w for _, w in m.extra.get("members", [])]}
    if isinstance(m.model, PipelineModel):
        meta["kind"] = "pipeline"
        m.model.write().overwrite().save(f"{path}/pipeline")
    elif isinstance(m.model, dict):
        meta |= {"kind": "neighbours", "k": m.model["k"]}
        m.model["base"].write.mode("overwrite").parquet(f"{path}/base")
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    for folder, part in parts.items():
        save_model(part, f"{path}/{folder}", spark)


def load_model(spark: SparkSession, path: str) -> Trained:
    """A model saved by ``save_model``; it predicts what the saved one did."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    m = Trained(meta["name"], meta["family"], meta["classes"], meta["features"], None, meta["fit_time"],
                meta["stack_level"], dict(meta["extra"]))
    if meta.get("kind") == "pipeline":
        m.model = PipelineModel.load(f"{path}/pipeline")
    elif meta.get("kind") == "neighbours":
        m.model = {"base": spark.read.parquet(f"{path}/base"), "k": meta["k"]}
    parts = {x: load_model(spark, f"{path}/{x}") for x in meta["parts"]}
    if meta["bagged"]:
        m.model = [p.model for p in parts.values()]
    elif m.family == "WeightedEnsemble":
        m.extra["members"] = list(zip(parts.values(), meta["weights"]))
        m.extra["weights"] = {p.name: w for p, w in m.extra["members"]}
    elif m.family == "Stacker":
        m.extra |= {"top": parts["top"], "l1": [p for x, p in parts.items() if x != "top"]}
        m.model = parts["top"].model
    return m
