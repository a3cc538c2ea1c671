"""Oversampling (O1–O8): every minority class is brought to the majority count.

Deterministic by construction: rows of a class are dealt copies in hash order
(``floor(need/n)`` each, one more for the first ``need mod n``), and every
synthetic draw (neighbour pick, gap) is a digest of (seed, row id, copy number).
Copies are generated in two levels (chunks of at most ``CHUNK`` copies, spread by
a repartition, then the copies) so one seed row that must yield millions of rows
does not stay in one task.

Output: the input rows with ``synthetic = false`` plus generated rows with
``synthetic = true`` and id ``<seed id>#<copy>``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import c, hash_text, hash_uniform
from tidewell.operators.knn import knn_join
from tidewell.operators.ranking import group_rank
from tidewell.operators.small import small_side
from tidewell.session import cut_lineage
from tidewell.spec import Spec

CHUNK = 4096
METHODS = ("random", "smote", "smoten", "smotenc", "borderline", "adasyn", "svmsmote", "kmeans")


def explode_count(df: DataFrame, count_col: str, out_col: str = "copy", chunk: int = CHUNK,
                  key_col: str = "id") -> DataFrame:
    """One output row per copy 0..count-1 of each input row, in two levels: first one row
    per chunk of ≤ ``chunk`` copies, hash-spread on (row key, chunk) so the chunks of one
    seed — and the seeds of one class — land in different tasks; then the copies.  Rows of
    one chunk at most stay where they are."""
    n = F.col(count_col)
    few = df.filter((n > 0) & (n <= chunk)).withColumn("__chunk", F.lit(0))
    many = df.filter(n > chunk).withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0), ((n - 1) / F.lit(chunk)).cast("int"))))
    spread = few.unionByName(many.repartition(F.col(key_col), F.col("__chunk")))
    start = F.col("__chunk") * F.lit(chunk)
    stop = F.least(start + F.lit(chunk), n) - 1
    return spread.withColumn(out_col, F.explode(F.sequence(start, stop))).drop("__chunk")


def _class_needs(df: DataFrame, label_col: str) -> DataFrame:
    """(label, n, need) with need = n_max − n; the table has one row per class."""
    counts = df.groupBy(c(label_col).alias(label_col)).agg(F.count(F.lit(1)).alias("__n"))
    # the window spans the per-class table only; joined back to the rows by label (a hot
    # key), so the table is broadcast behind its row count
    return small_side(counts.select(label_col, "__n",
                                    (F.max("__n").over(Window.partitionBy()) - F.col("__n")).alias("__need")))


def _deal(seeds: DataFrame, spec: Spec, seed: int, salt: str, within: Sequence[str] = ()) -> DataFrame:
    """Rank seed rows per class (and ``within``) in hash order and attach their copy count
    (``__cnt``).  ``seeds`` carries ``__need`` (rows to make for its class)."""
    keyed = seeds.withColumn("__h", hash_text(spec.id_col, seed, salt))
    ranked = group_rank(keyed, [spec.label_col, *within], ["__h", spec.id_col], rank_col="__rn", count_col="__ns",
                        hash_ordered=True)
    q = F.floor(F.col("__need") / F.col("__ns"))
    r = F.col("__need") % F.col("__ns")
    return ranked.withColumn("__cnt", (q + F.when(F.col("__rn") <= r, 1).otherwise(0)).cast("int")) \
                 .drop("__h", "__ns")


def _finish(original: DataFrame, synthetic: DataFrame, spec: Spec) -> DataFrame:
    cols = [spec.id_col, *spec.feats, spec.label_col]
    a = original.select(*[c(x) for x in cols]).withColumn("synthetic", F.lit(False))
    b = synthetic.select(*[c(x) for x in cols]).withColumn("synthetic", F.lit(True))
    return a.unionByName(b)


def _copy_id(spec: Spec) -> Column:
    return F.concat(c(spec.id_col).cast("string"), F.lit("#"), F.col("copy").cast("string"))


def oversample_random(df: DataFrame, spec: Spec, seed: int = 42) -> DataFrame:
    """O1: duplicate minority rows up to the majority count."""
    needs = _class_needs(df, spec.label_col)
    seeds = df.join(needs.select(spec.label_col, "__need"), on=spec.label_col).filter(F.col("__need") > 0)
    dealt = _deal(seeds, spec, seed, "random")
    copies = explode_count(dealt, "__cnt", "copy", key_col=spec.id_col).withColumn(spec.id_col, _copy_id(spec))
    return _finish(df, copies, spec)


def _interpolate(copies: DataFrame, knn: DataFrame, base: DataFrame, spec: Spec, k: int,
                 seed: int, avail_col: str) -> DataFrame:
    """x + u·(neighbour − x) with neighbour = the pick-th of the seed's k nearest; a column
    ``__dir`` of the copies scales the step (negative: away from the neighbour)."""
    step = F.col("__dir") if "__dir" in copies.columns else F.lit(1.0)
    key = F.concat(c(spec.id_col).cast("string"), F.lit("|"), F.col("copy").cast("string"))
    picks = copies.withColumn("__pick", (F.floor(hash_uniform(key, seed, "nn") * F.least(F.lit(k), F.col(avail_col)))
                                         + 1).cast("bigint")) \
                  .withColumn("__gap", hash_uniform(key, seed, "gap") * step)
    nn = knn.select(F.col("probe_id").alias("__sid"), F.col("nn_rank").alias("__pick"), F.col("base_id").alias("__nid"))
    j = picks.join(nn, (picks[spec.id_col].cast("string") == nn["__sid"]) & (picks["__pick"] == nn["__pick"]), "left") \
             .drop(nn["__pick"])
    nb = base.select(c(spec.id_col).cast("string").alias("__nid2"), *[c(x).alias(f"__n_{i}") for i, x in enumerate(spec.feats)])
    j = j.join(nb, j["__nid"] == nb["__nid2"], "left")
    out = j.withColumns({x: c(x) + F.col("__gap") * (F.coalesce(F.col(f"__n_{i}"), c(x)) - c(x))
                         for i, x in enumerate(spec.feats)})
    return out.withColumn(spec.id_col, _copy_id(spec))


def smote(df: DataFrame, spec: Spec, k: int = 3, seed: int = 42, partition_cols: Sequence[str] = (),
          seeds: DataFrame | None = None, salt: str = "smote", **knn_kw) -> DataFrame:
    """O2: synthetic rows on the segment between a seed row and one of its k nearest
    rows of the same class (excluding itself)."""
    lab = spec.label_col
    needs = _class_needs(df, lab)
    # the minority rows are read by the dealing, both kNN sides and the neighbour lookup:
    # materialise them once instead of re-reading the input each time
    cls = cut_lineage(df.join(needs.select(lab, "__n", "__need"), on=lab).filter(F.col("__need") > 0))
    if seeds is None:
        seed_rows = cls
    elif "__dir" in seeds.columns:
        seed_rows = cls.join(seeds.select(c(spec.id_col), "__dir"), on=spec.id_col)
    else:
        seed_rows = cls.join(seeds.select(c(spec.id_col)), on=spec.id_col, how="left_semi")
    dealt = _deal(seed_rows, spec, seed, salt)
    knn = knn_join(cls, cls, k, spec.feats, id_col=spec.id_col, partition_cols=[lab, *partition_cols],
                   exclude_self=True, **knn_kw)
    # neighbours available to a row: rows of its class (and partition) minus itself
    if partition_cols:
        sizes = cls.groupBy(lab, *partition_cols).agg(F.count(F.lit(1)).alias("__psz"))
        dealt = dealt.join(sizes, on=[lab, *partition_cols])
        avail = (F.col("__psz") - 1)
    else:
        avail = F.col("__n") - 1
    copies = explode_count(dealt.withColumn("__avail", avail), "__cnt", "copy", key_col=spec.id_col)
    syn = _interpolate(copies, knn, cls, spec, k, seed, "__avail")
    return _finish(df, syn, spec)


def _other_class_share(df: DataFrame, probes: DataFrame, spec: Spec, m: int, **knn_kw) -> DataFrame:
    """For each probe row: (id, n_other) = how many of its m nearest rows (all classes,
    itself excluded) have another label."""
    lab = spec.label_col
    nn = knn_join(probes, df, m, spec.feats, id_col=spec.id_col, exclude_self=True,
                  base_passthrough=[lab], **knn_kw)
    pl = probes.select(c(spec.id_col).cast("string").alias("probe_id"), c(lab).alias("__plab"))
    j = nn.join(pl, on="probe_id")
    # read by sums, ranks and joins: a search for all of them
    return cut_lineage(j.groupBy("probe_id").agg(
        F.sum((~F.col(lab).eqNullSafe(F.col("__plab"))).cast("int")).alias("n_other"),
        F.count(F.lit(1)).alias("n_nn")))


def borderline_smote(df: DataFrame, spec: Spec, k: int = 3, m: int = 10, seed: int = 42, **knn_kw) -> DataFrame:
    """O5 (borderline-1): seeds are minority rows in danger — at least half, but not all,
    of their m nearest rows belong to another class; neighbours from the same class."""
    lab = spec.label_col
    needs = _class_needs(df, lab)
    minority = df.join(needs.filter(F.col("__need") > 0).select(lab), on=lab, how="left_semi")
    share = _other_class_share(df, minority, spec, m, **knn_kw)
    danger = share.filter((F.col("n_other") * 2 >= F.col("n_nn")) & (F.col("n_other") < F.col("n_nn"))) \
                  .select(F.col("probe_id").alias(spec.id_col))
    return smote(df, spec, k, seed, seeds=danger, salt="borderline", **knn_kw)


def adasyn(df: DataFrame, spec: Spec, k: int = 3, seed: int = 42, **knn_kw) -> DataFrame:
    """Each minority row makes a number of synthetic rows proportional to the share
    of other-class rows among its k nearest.  Counts are whole parts plus the largest
    remainders (then the smallest key), so that a class gets exactly what it needs; rounding
    each row's share alone may make none.  A class without other-class neighbours gets none."""
    lab = spec.label_col
    needs = _class_needs(df, lab)
    cls = cut_lineage(df.join(needs.select(lab, "__n", "__need"), on=lab).filter(F.col("__need") > 0))
    share = _other_class_share(df, cls, spec, k, **knn_kw)
    # share_i / Σ share = n_other_i / Σ n_other: integers keep the rounding exact
    r = cls.join(share, cls[spec.id_col].cast("string") == share["probe_id"], "left") \
           .withColumn("__r", F.coalesce(F.col("n_other"), F.lit(0)).cast("bigint"))
    tot = r.groupBy(lab).agg(F.sum("__r").alias("__rt"))
    share = F.col("__r") * F.col("__need")
    r = (r.join(small_side(tot), on=lab).filter(F.col("__rt") > 0)
         .withColumn("__rem", -(share % F.col("__rt")))  # negative: the largest comes first
         .withColumn("__whole", ((share + F.col("__rem")) / F.col("__rt")).cast("bigint")))
    r = group_rank(r, [lab], ["__rem", spec.id_col], rank_col="__rk", extra_sums=["__whole"], hash_ordered=False)
    left = F.col("__need") - F.col("tot___whole")
    r = r.withColumn("__cnt", (F.col("__whole") + F.when(F.col("__rk") <= left, 1).otherwise(0)).cast("int"))
    knn = knn_join(cls, cls, k, spec.feats, id_col=spec.id_col, partition_cols=[lab], exclude_self=True, **knn_kw)
    copies = explode_count(r.withColumn("__avail", F.col("__n") - 1), "__cnt", "copy", key_col=spec.id_col)
    syn = _interpolate(copies, knn, cls, spec, k, seed, "__avail")
    return _finish(df, syn, spec)


def fourier_features(df: DataFrame, feats: Sequence[str], dims: int = 256, gamma: float | None = None,
                     seed: int = 42, out: str = "__v") -> DataFrame:
    """Random Fourier features: ``dims`` cosines whose inner products approach the RBF kernel
    exp(−γ·|x − y|²), each with a standard error of at most 1 / sqrt(dims).  γ defaults to
    1 / (features · variance of all cells).  The projection (features × dims numbers) is drawn
    on the driver; rows are mapped in Arrow batches.  NULL cells count as 0."""
    from pyspark.ml.functions import array_to_vector
    feats = list(feats)
    if gamma is None:
        row = df.agg(*[F.avg(c(x)).alias(f"m{i}") for i, x in enumerate(feats)],
                     *[F.var_pop(c(x)).alias(f"v{i}") for i, x in enumerate(feats)]).collect()[0]
        mean = [row[f"m{i}"] or 0.0 for i in range(len(feats))]
        square = sum((row[f"v{i}"] or 0.0) + m * m for i, m in enumerate(mean)) / len(feats)
        var = square - (sum(mean) / len(feats)) ** 2
        gamma = 1.0 / (len(feats) * var) if var > 0 else 1.0
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), (len(feats), dims))
    b = rng.uniform(0.0, 2.0 * np.pi, dims)

    @F.pandas_udf("array<double>")
    def mapped(x: pd.Series) -> pd.Series:
        z = np.stack(x.to_numpy()) @ w + b if len(x) else np.empty((0, dims))
        return pd.Series(list(np.cos(z) * np.sqrt(2.0 / dims)))

    cells = F.array(*[F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in feats])
    return df.withColumn(out, array_to_vector(mapped(cells)))


def rbf_margins(vec: DataFrame, label_col: str, cl, rows: int, cost: float = 1.0) -> DataFrame:
    """``vec`` (with ``fourier_features``) plus ``__margin``: the one-vs-rest SVM's decision value
    for class ``cl`` (hinge loss summed with weight ``cost`` against half the squared norm)."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import vector_to_array
    data = vec.withColumn("__y", c(label_col).eqNullSafe(F.lit(cl)).cast("double"))
    model = LinearSVC(featuresCol="__v", labelCol="__y", maxIter=100, regParam=1.0 / (cost * max(1, rows)),
                      standardization=False).fit(data)
    return model.transform(data).withColumn("__margin", vector_to_array("rawPrediction")[1]) \
        .drop("rawPrediction", "prediction")


def svm_smote(df: DataFrame, spec: Spec, k: int = 3, m: int = 5, seed: int = 42, dims: int = 256,
              out_step: float = 0.5, **knn_kw) -> DataFrame:
    """Seeds are the minority support vectors (margin at most 1) of one-vs-rest SVMs with an
    RBF kernel, taken by random Fourier features, that are not noise (not all m nearest rows
    of another class).  A seed in danger (at least half of them of another class) moves
    towards a neighbour of its class; a safe one moves away from it, up to ``out_step`` times
    the distance.  A class without such seeds gets no rows."""
    from tidewell.operators.models import parallel_map
    lab = spec.label_col
    needs = _class_needs(df, lab)
    table = needs.select(lab, "__n", "__need").collect()  # one row per class
    minority, rows = [r[lab] for r in table if r["__need"] > 0], sum(r["__n"] for r in table)
    if not minority:
        return _finish(df, df.limit(0), spec)
    vec = cut_lineage(fourier_features(df, spec.feats, dims, seed=seed).select(c(spec.id_col), c(lab), "__v"))

    def support_vectors(cl):
        own = rbf_margins(vec, lab, cl, rows).filter(c(lab).eqNullSafe(F.lit(cl)))
        return own.filter(F.col("__margin") <= 1.0).select(c(spec.id_col))

    svs = None
    for found in parallel_map(support_vectors, minority):
        svs = found if svs is None else svs.unionByName(found)
    probes = df.join(cut_lineage(svs), on=spec.id_col, how="left_semi")
    share = _other_class_share(df, probes, spec, m, **knn_kw)
    seeds = share.filter(F.col("n_other") < F.col("n_nn")).select(
        F.col("probe_id").alias(spec.id_col),
        F.when(F.col("n_other") * 2 >= F.col("n_nn"), F.lit(1.0)).otherwise(F.lit(-out_step)).alias("__dir"))
    return smote(df, spec, k, seed, seeds=seeds, salt="svm", **knn_kw)


def cluster_needs(df: DataFrame, spec: Spec, cluster_col: str, threshold: float | None = None,
                  exponent: float | None = None) -> DataFrame:
    """(label, cluster, n, need): how the rows that a class lacks are shared out over its clusters.

    A cluster takes part with at least two rows of the class that make up at least ``threshold``
    of its rows (default: half the class's part of all rows lacking).  Its weight is
    spread ** exponent / n, so that sparse clusters get more; spread is the root mean square
    distance between its rows of the class, which variances give without pairs, and the
    exponent defaults to 0.16 · log(n, base 1.6) ** 1.8.  Shares are whole parts plus largest
    remainders (then the smallest cluster).  A class without such a cluster gets no rows."""
    lab = spec.label_col
    needs = _class_needs(df, lab)
    every = Window.partitionBy()
    per = df.groupBy(c(lab).alias(lab), c(cluster_col).alias(cluster_col)).agg(
        F.count(F.lit(1)).alias("n"), sum(F.coalesce(F.var_samp(c(x)), F.lit(0.0)) for x in spec.feats).alias("__var"))
    # from here on tables of classes x clusters rows
    per = per.withColumn("__all", F.sum("n").over(Window.partitionBy(cluster_col)))
    least = needs.select(lab, "__need", (F.col("__need") / F.sum("__need").over(every) / 2).alias("__least"))
    limit = F.col("__least") if threshold is None else F.lit(float(threshold))
    per = per.join(least, on=lab).filter((F.col("__need") > 0) & (F.col("n") >= 2) & (F.col("n") / F.col("__all") >= limit))
    power = F.pow(F.log("n") / F.log(F.lit(1.6)), F.lit(1.8)) * 0.16 if exponent is None else F.lit(float(exponent))
    label = Window.partitionBy(lab)
    # weights by logarithms: a power of the spread may leave the range of doubles
    per = per.withColumn("__lw", power * F.log(F.greatest(F.sqrt(2 * F.col("__var")), F.lit(1e-300))) - F.log("n"))
    per = per.withColumn("__w", F.exp(F.col("__lw") - F.max("__lw").over(label)))
    per = per.withColumn("__share", F.col("__need") * F.col("__w") / F.sum("__w").over(label))
    per = per.withColumn("__whole", F.floor("__share"))
    order = Window.partitionBy(lab).orderBy((F.col("__share") - F.col("__whole")).desc(), cluster_col)
    left = F.col("__need") - F.sum("__whole").over(label)
    return per.select(lab, cluster_col, "n", (F.col("__whole") + (F.row_number().over(order) <= left).cast("long")).alias("need"))


def kmeans_smote(df: DataFrame, spec: Spec, k: int = 3, n_clusters: int = 1, seed: int = 42,
                 threshold: float | None = None, exponent: float | None = None, **knn_kw) -> DataFrame:
    """Clusters by ``pyspark.ml`` KMeans (one by default, as configured in the source); each
    class's rows are shared out by ``cluster_needs`` and made by SMOTE inside the cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    lab, cluster = spec.label_col, "__cluster"
    # KMeans asks for two clusters at least; one cluster is every row
    if n_clusters > 1:
        vec = VectorAssembler(inputCols=list(spec.feats), outputCol="__v").transform(df)
        clustered = KMeans(k=n_clusters, seed=seed, featuresCol="__v", predictionCol=cluster).fit(vec).transform(vec).drop("__v")
    else:
        clustered = df.withColumn(cluster, F.lit(0))
    shares = small_side(cluster_needs(clustered, spec, cluster, threshold, exponent)
                        .filter(F.col("need") > 0).withColumnsRenamed({"n": "__n", "need": "__need"}))
    cls = cut_lineage(clustered.join(shares, on=[lab, cluster]))
    dealt = _deal(cls, spec, seed, "kmeans", [cluster])
    knn = knn_join(cls, cls, k, spec.feats, id_col=spec.id_col, partition_cols=[lab, cluster], exclude_self=True, **knn_kw)
    copies = explode_count(dealt.withColumn("__avail", F.col("__n") - 1), "__cnt", "copy", key_col=spec.id_col)
    return _finish(df, _interpolate(copies, knn, cls, spec, k, seed, "__avail"), spec)


def oversample(df: DataFrame, spec: Spec, method: str = "smote", **kw) -> DataFrame:
    if method == "random":
        return oversample_random(df, spec, kw.get("seed", 42))
    if method == "smote":
        return smote(df, spec, kw.get("k_neighbors", 3), kw.get("seed", 42))
    if method == "borderline":
        return borderline_smote(df, spec, kw.get("k_neighbors", 3), kw.get("m_neighbors", 10), kw.get("seed", 42))
    if method == "adasyn":
        return adasyn(df, spec, kw.get("n_neighbors", 3), kw.get("seed", 42))
    if method == "svmsmote":
        return svm_smote(df, spec, kw.get("k_neighbors", 3), kw.get("m_neighbors", 5), kw.get("seed", 42))
    if method == "kmeans":
        return kmeans_smote(df, spec, kw.get("k_neighbors", 3), kw.get("n_clusters", 1), kw.get("seed", 42))
    if method == "smoten":
        return smoten(df, spec, kw["categorical"], kw.get("k_neighbors", 3), kw.get("seed", 42))
    if method == "smotenc":
        return smotenc(df, spec, kw["categorical"], kw.get("k_neighbors", 3), kw.get("seed", 42))
    raise ValueError(f"unknown oversampling method {method!r}; known are {', '.join(METHODS)}")


# ----------------------------------------------------------------- categorical variants


def _neighbour_modes(copies: DataFrame, knn: DataFrame, base: DataFrame, spec: Spec, cat_cols) -> DataFrame:
    """Per seed row: the most frequent value of each categorical column among its k
    neighbours (ties → the smallest value)."""
    nb = base.select(c(spec.id_col).cast("string").alias("__nid"),
                     *[c(x).cast("string").alias(f"__c{i}") for i, x in enumerate(cat_cols)])
    j = knn.select(F.col("probe_id").alias("__sid"), F.col("base_id").alias("__nid")).join(nb, "__nid")
    modes = None
    for i, x in enumerate(cat_cols):
        cnt = j.groupBy("__sid", F.col(f"__c{i}").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        m = cnt.groupBy("__sid").agg(F.min_by("__v", F.struct((-F.col("__n")).alias("a"), F.col("__v").alias("b")))
                                     .alias(f"__mode{i}"))
        modes = m if modes is None else modes.join(m, "__sid")
    out = copies.join(modes, copies[spec.id_col].cast("string") == modes["__sid"], "left")
    return out.withColumns({x: F.coalesce(F.col(f"__mode{i}"), c(x).cast("string")) for i, x in enumerate(cat_cols)})


def vdm_embedding(df: DataFrame, label_col: str, cat_cols) -> tuple[DataFrame, list[list[str]]]:
    """Each categorical value becomes its vector of class frequencies P(class | value)
    (value-difference metric with k = 1).  Returns the table with embedding columns
    ``__e_<feature>_<class>`` and the column groups, one per feature."""
    classes = sorted(r[0] for r in df.select(label_col).distinct().collect() if r[0] is not None)
    out, groups = df, []
    for i, x in enumerate(cat_cols):
        cnt = df.groupBy(c(x).alias("__v")).pivot(label_col, classes).agg(F.count(F.lit(1)))
        tot = sum((F.coalesce(F.col(f"`{cl}`"), F.lit(0)) for cl in classes), F.lit(0))
        names = [f"__e{i}_{j}" for j in range(len(classes))]
        emb = cnt.select(F.col("__v"), *[(F.coalesce(F.col(f"`{cl}`"), F.lit(0)) / tot).alias(n)
                                          for cl, n in zip(classes, names)])
        out = out.join(small_side(emb), out[f"`{x}`"].eqNullSafe(emb["__v"]), "left").drop("__v")
        groups.append(names)
    return out, groups


def smoten(df: DataFrame, spec: Spec, cat_cols, k: int = 3, seed: int = 42, **knn_kw) -> DataFrame:
    """O3 SMOTEN: categorical features only.  Neighbours of the same class under the
    value-difference metric (L1 between class-frequency vectors per feature, L2 across
    features); a synthetic row takes, per feature, the most frequent value among the
    seed's k neighbours.  Output: id, categorical columns, label, synthetic."""
    lab = spec.label_col
    cat_cols = list(cat_cols)
    emb, groups = vdm_embedding(df, lab, cat_cols)
    flat = [x for g in groups for x in g]
    needs = _class_needs(df, lab)
    cls = cut_lineage(emb.join(needs.select(lab, "__n", "__need"), on=lab).filter(F.col("__need") > 0))
    dealt = _deal(cls, spec, seed, "smoten")
    knn = knn_join(cls, cls, k, flat, id_col=spec.id_col, partition_cols=[lab], exclude_self=True,
                   groups=groups, **knn_kw)
    copies = explode_count(dealt, "__cnt", "copy", key_col=spec.id_col)
    syn = _neighbour_modes(copies, knn, cls, spec, cat_cols).withColumn(spec.id_col, _copy_id(spec))
    cols = [spec.id_col, *cat_cols, lab]
    a = df.select(*[c(x) for x in cols]).withColumn("synthetic", F.lit(False))
    b = syn.select(*[c(x) for x in cols]).withColumn("synthetic", F.lit(True))
    return a.unionByName(b)


def smotenc(df: DataFrame, spec: Spec, cat_cols, k: int = 3, seed: int = 42, **knn_kw) -> DataFrame:
    """O4 SMOTENC: numeric features (``spec.feats``) and categorical ``cat_cols`` (the list is
    required — the source's call omits it and cannot run).  Distance: Euclidean over the
    numeric features plus one-hot categorical columns of value median(std of numeric)/2;
    numeric values interpolate as in SMOTE, categorical values are the neighbours' mode."""
    lab = spec.label_col
    cat_cols = list(cat_cols)
    nums = list(spec.feats)
    stds = df.agg(*[F.stddev_pop(c(x)).alias(f"s{i}") for i, x in enumerate(nums)]).collect()[0]
    svals = sorted(float(stds[f"s{i}"] or 0.0) for i in range(len(nums)))
    med = (svals[(len(svals) - 1) // 2] + svals[len(svals) // 2]) / 2 if svals else 1.0
    values = {x: sorted(r[0] for r in df.select(c(x).cast("string")).distinct().collect() if r[0] is not None)
              for x in cat_cols}  # one row per category
    ohe = {f"__o{i}_{j}": F.when(c(x).cast("string") == F.lit(v), F.lit(med / 2)).otherwise(F.lit(0.0))
           for i, x in enumerate(cat_cols) for j, v in enumerate(values[x])}
    enc = df.withColumns(ohe)
    dist_cols = nums + list(ohe)
    needs = _class_needs(df, lab)
    cls = cut_lineage(enc.join(needs.select(lab, "__n", "__need"), on=lab).filter(F.col("__need") > 0))
    dealt = _deal(cls, spec, seed, "smotenc")
    knn = knn_join(cls, cls, k, dist_cols, id_col=spec.id_col, partition_cols=[lab], exclude_self=True, **knn_kw)
    copies = explode_count(dealt.withColumn("__avail", F.col("__n") - 1), "__cnt", "copy", key_col=spec.id_col)
    num_spec = Spec(spec.id_col, lab, tuple(nums))
    inter = _interpolate(copies, knn, cls, num_spec, k, seed, "__avail")
    # modes are taken per seed row: key the copies back by the seed id
    inter = inter.withColumn("__seed", F.regexp_extract(c(spec.id_col), r"^(.*)#[0-9]+$", 1))
    nb = cls.select(c(spec.id_col).cast("string").alias("__nid"),
                    *[c(x).cast("string").alias(f"__c{i}") for i, x in enumerate(cat_cols)])
    j = knn.select(F.col("probe_id").alias("__sid"), F.col("base_id").alias("__nid")).join(nb, "__nid")
    for i, x in enumerate(cat_cols):
        cnt = j.groupBy("__sid", F.col(f"__c{i}").alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
        m = cnt.groupBy("__sid").agg(F.min_by("__v", F.struct((-F.col("__k")).alias("a"), F.col("__v").alias("b")))
                                     .alias(f"__mode{i}"))
        inter = inter.join(m, inter["__seed"] == m["__sid"], "left").drop("__sid") \
                     .withColumn(x, F.coalesce(F.col(f"__mode{i}"), c(x).cast("string"))).drop(f"__mode{i}")
    cols = [spec.id_col, *nums, *cat_cols, lab]
    a = df.select(*[c(x) for x in cols]).withColumn("synthetic", F.lit(False))
    b = inter.select(*[c(x) for x in cols]).withColumn("synthetic", F.lit(True))
    return a.unionByName(b)
