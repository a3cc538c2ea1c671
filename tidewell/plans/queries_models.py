"""Registered queries: models, ensembles, distillation, importance, runs (M*, E8–E11, E13, S*).

Model fits are not SQL-expressible; those queries carry no oracle (rows-only
check).  The kNN classifier, label encoding and the confidence filter on given
probabilities do have one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.operators import distill as D
from tidewell.operators import ensemble as ENS
from tidewell.operators import importance as IMP
from tidewell.operators import models as M
from tidewell.operators import split as T
from tidewell.plans import fixtures as X
from tidewell.plans import queries_core as QC
from tidewell.plans import teacher as TS
from tidewell.plans.fixtures import sql_hash
from tidewell.plans.flagship import assembled
from tidewell.plans.prepare import PrepConfig, prepare
from tidewell.plans.registry import register, rounded
from tidewell.session import cut_lineage, ensure_checkpoint_dir
from tidewell.sources import runs as R
from tidewell.sources import tables as S

EMBF = list(X.EMB_FEATURES)


def emb_split(spark, sf):
    tagged = cut_lineage(T.assign_split(X.emb(spark, sf), "id", "label", 0.2, 42))
    return (tagged.filter(F.col("split") == "train").drop("split"),
            tagged.filter(F.col("split") == "test").drop("split"))


_KNN_SQL = X.with_ctes(["emb"], """
SELECT id, predicted, round(p_max, 6) AS p_max FROM (
  SELECT id, class AS predicted, p AS p_max, row_number() OVER (PARTITION BY id ORDER BY p DESC, class) AS r FROM (
    SELECT g.id, g.class, coalesce(v.w / t.tw, 0.0) AS p
    FROM (SELECT te.id, c.label AS class FROM te, (SELECT DISTINCT label FROM tr) c) g
    LEFT JOIN v ON v.id = g.id AND v.label = g.class
    LEFT JOIN (SELECT id, sum(w) AS tw FROM v GROUP BY id) t ON t.id = g.id) x) y
WHERE r = 1""", [
    f"""sp AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_hash('id')}, id) AS rn,
             count(*) OVER (PARTITION BY label) AS n FROM emb)""",
    "te AS (SELECT * FROM sp WHERE rn <= round_even(n * 0.2, 0))",
    "tr AS (SELECT * FROM sp WHERE rn > round_even(n * 0.2, 0))",
    "pairs AS (SELECT te.id, tr.id AS bid, tr.label, sqrt(" + " + ".join(
        f"(te.e{i} - tr.e{i}) * (te.e{i} - tr.e{i})" for i in range(X.N_EMB)) + ") AS dist FROM te, tr)",
    "nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, bid) AS k FROM pairs) t "
    "WHERE k <= 5)",
    "v AS (SELECT id, label, sum(CASE WHEN dist = 0 THEN 1e12 ELSE 1.0 / dist END) AS w FROM nn GROUP BY id, label)"])


@register("knn_classifier", _KNN_SQL, headline=True)
def q_knn(spark, sf):
    """M1 KNeighborsDist: exact 5-NN distance-weighted vote, test rows of a stratified split."""
    train, test = emb_split(spark, sf)
    m = M.fit_model(train, X.EMB_SPEC, "KNeighborsDist")
    return rounded(M.predict(m, test))


@register("encode_labels", X.with_ctes(["emb"], "SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) "
          "AS label_index FROM (SELECT DISTINCT label FROM emb) t"))
def q_encode(spark, sf):
    """Class ↔ integer, alphabetical."""
    e = X.emb(spark, sf)
    classes = M.encode_labels(e)
    idx = M.label_index(classes)
    return e.select("label").distinct().select("label", idx.cast("bigint").alias("label_index"))


_CONF_SQL = X.with_ctes(["probs", "pw"], """
SELECT id, label, round(p_A, 6) AS p_A, round(p_N, 6) AS p_N, round(p_R, 6) AS p_R, round(p_max, 6) AS p_max
FROM (SELECT * FROM rest WHERE p_max >= (SELECT quantile_cont(p_max, 0.75) FROM rest)
      UNION ALL SELECT * FROM spared) t""", [
    """top AS (SELECT id, class AS pred, p AS p_max FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, class)
            AS r FROM probs) t WHERE r = 1)""",
    "sh AS (SELECT pred, count(*) / sum(count(*)) OVER () AS share FROM top GROUP BY pred)",
    "j AS (SELECT pw.*, top.pred, top.p_max FROM pw JOIN top ON pw.id = top.id)",
    "spared AS (SELECT id, label, p_A, p_N, p_R, p_max FROM j WHERE pred IN (SELECT pred FROM sh WHERE share <= 0.15))",
    "rest AS (SELECT id, label, p_A, p_N, p_R, p_max FROM j WHERE pred NOT IN (SELECT pred FROM sh WHERE share <= 0.15))"])


@register("confident_rows", _CONF_SQL)
def q_confident(spark, sf):
    """Rows at or above the 75 % point of the top probability, sparing predicted
    classes with a share ≤ 0.15 (the quantile is taken over the other rows)."""
    out = D.confident_rows(X.probs_wide(spark, sf), X.probs(spark, sf), X.LI_SPEC, "75%", 0.15)
    return rounded(out.select("id", "label", "p_A", "p_N", "p_R", "p_max"))


@register("rf_predictions", headline=True)
def q_rf(spark, sf):
    """M1/M9: random forest (gini) on a stratified split; test predictions."""
    train, test = emb_split(spark, sf)
    m = M.fit_model(train, X.EMB_SPEC, "RandomForestGini")
    return rounded(M.predict(m, test))


@register("gbt_probabilities")
def q_gbt(spark, sf):
    """M1/M9: one-vs-rest boosted trees; renormalised class probabilities (long)."""
    train, test = emb_split(spark, sf)
    m = M.fit_model(train, X.EMB_SPEC, "LightGBM")
    return rounded(M.predict_proba(m, test))


@register("teacher_leaderboard", headline=True)
def q_teacher(spark, sf):
    """M2 + M6 + E8: several families and the greedy weighted ensemble; leaderboard."""
    train, test = emb_split(spark, sf)
    models, val = TS.fit_teacher(train, X.EMB_SPEC, ["RandomForestGini", "ExtraTreesEntr", "LR",
                                                      "KNeighborsDist", "NeuralNetTorch"], use_best=True)
    return M.leaderboard(models, X.EMB_SPEC, test=test, val=val).drop(
        "pred_time_test", "pred_time_val", "fit_time", "pred_time_test_marginal", "pred_time_val_marginal",
        "fit_time_marginal")


@register("bagged_stacked")
def q_stack(spark, sf):
    """M4 + M5 + M7: bagged level-1 models (3 folds, the 3×1 CV setting), a level-2 stacker, refit on all rows."""
    train, test = emb_split(spark, sf)
    l1, l2 = ENS.stack(train, X.EMB_SPEC, ["LR", "RandomForestEntr"], 3)
    full = ENS.refit_full(train, X.EMB_SPEC, l1[0])
    return M.leaderboard(l1 + [l2, full], X.EMB_SPEC, test=test).select("model", "score_test", "stack_level")


def _cust_prepared(spark, sf):
    lab, unl = assembled(spark, sf)
    from tidewell.spec import Spec
    return prepare(lab, unl, Spec("id", "label"), PrepConfig(scaler="standard", oversample="smote"))


@register("pseudo_labels")
def q_pseudo(spark, sf):
    """Unlabelled customers labelled by a random forest teacher."""
    p = _cust_prepared(spark, sf)
    m = M.fit_model(p["train"], p["spec"], "RandomForestGini")
    return D.pseudo_label(m, p["unlabelled"], p["spec"]).select("id", "label")


@register("distill_soft")
def q_distill(spark, sf):
    """M14 (soft) + M12 (MUNGE): students on teacher probabilities; leaderboard."""
    p = _cust_prepared(spark, sf)
    teacher = M.fit_model(p["train"], p["spec"], "RandomForestGini")
    students = D.distill(teacher, p["train"], p["spec"], ["LR", "RandomForestEntr", "NeuralNetTorch"],
                         p["unlabelled"], "soft", "munge")
    return M.leaderboard([teacher] + students, p["spec"], test=p["test"]).select("model", "score_test")


@register("teacher_student")
def q_teacher_student(spark, sf):
    """Flow C: teacher → distill → best student → confident rows → second distillation."""
    p = _cust_prepared(spark, sf)
    out = TS.teacher_student(p["train"], p["test"], p["unlabelled"], p["spec"], ["RandomForestGini", "LR"],
                             ["LR", "RandomForestEntr"], "75%", 0.15, augment="spunge")
    return out["leaderboard"].select("model", "score_test", "score_val", "stack_level")


@register("feature_importance")
def q_importance(spark, sf):
    """Permutation importance (5 shuffles) of a random forest on the test rows."""
    train, test = emb_split(spark, sf)
    m = M.fit_model(train, X.EMB_SPEC, "RandomForestGini")
    return rounded(IMP.feature_importance(m, test, X.EMB_SPEC, 5))


@register("importance_selected_refit")
def q_importance_subset(spark, sf):
    """M17 + M18: per-model features with |importance| > 0.005 on the train rows (5 shuffles), refit, leaderboard on the test rows."""
    train, test = emb_split(spark, sf)
    imps = {}
    for fam in ("RandomForestGini", "LR"):
        m = M.fit_model(train, X.EMB_SPEC, fam)
        imps[fam] = IMP.feature_importance(m, train, X.EMB_SPEC, 5)
    return IMP.fit_per_model_subset(train, test, X.EMB_SPEC, imps, 0.005).select("model", "score_test")


@register("reduce_then_train")
def q_reduce_train(spark, sf):
    """M19 + E13: nearest 80 % / 90 % per class, oversample, fit; one long leaderboard."""
    train, test = emb_split(spark, sf)
    return TS.sweep({"method": ["first", "proportion"], "threshold": [0.8, 0.9]},
                    lambda method, threshold: TS.reduce_then_train(train, test, X.EMB_SPEC, ["LR"], method, threshold)
                    ).select("model", "score_test", "method", "threshold")


def _spunge_sql() -> str:
    def draw(f: str, salt: str) -> str:
        return (f"(CAST(('0x' || substr(md5('42|' || concat_ws('|', id, CAST(copy AS VARCHAR), '{f}') || '|{salt}'), 1, 13)) "
                "AS BIGINT) / CAST(4503599627370496 AS DOUBLE))")

    def moved(i: int) -> str:
        f = f"e{i}"
        normal = f"sqrt(-2.0 * ln(greatest({draw(f, 'spa')}, 1e-300))) * cos(6.283185307179586 * {draw(f, 'spb')})"
        return (f"round(CASE WHEN {draw(f, 'spunge')} < 0.5 THEN {f} + (0.1 * st.s{i}) * ({normal}) ELSE {f} END, 6) AS {f}")

    return X.with_ctes(["emb"], "SELECT id || '#s' || CAST(copy AS VARCHAR) AS id, "
                       + ", ".join(moved(i) for i in range(X.N_EMB))
                       + " FROM (SELECT emb.*, c.copy FROM emb, range(2) c(copy)) t, st",
                       ["st AS (SELECT " + ", ".join(f"stddev_pop(e{i}) AS s{i}" for i in range(X.N_EMB)) + " FROM emb)"])


_SPUNGE_SQL = _spunge_sql()


@register("augment_spunge", _SPUNGE_SQL)
def q_spunge(spark, sf):
    """Perturbed copies of the embedding rows."""
    return rounded(D.augment_spunge(X.emb(spark, sf), X.EMB_SPEC, 0.5, 0.1, 2))


@register("impute_forest")
def q_impute_forest(spark, sf):
    """Chained random-forest imputation (10 rounds) of the embedding NULLs."""
    from tidewell.operators.impute import impute_iterative
    return rounded(impute_iterative(X.embn(spark, sf), X.EMB_SPEC, "randomforest", max_iter=10).select("id", *EMBF))


@register("run_info", X.with_ctes(["emb"], f"""
SELECT 'All' AS subset, 'Emb' AS modality, 'Mouse' AS taxonomy, 'medium' AS preset,
       count(*) FILTER (NOT held) AS train_rows, CAST({X.N_EMB + 2} AS BIGINT) AS train_cols,
       count(*) FILTER (held) AS test_rows, CAST({X.N_EMB + 2} AS BIGINT) AS test_cols,
       string_agg(DISTINCT label, ',' ORDER BY label) FILTER (NOT held) AS train_labels,
       string_agg(DISTINCT label, ',' ORDER BY label) FILTER (held) AS test_labels FROM tagged""", [
    f"""tagged AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY {sql_hash('id')}, id)
             <= round_even(count(*) OVER (PARTITION BY label) * 0.2, 0) AS held FROM emb)"""]))
def q_run_info(spark, sf):
    """One-row description of a prepared run (label lists joined by commas)."""
    train, test = emb_split(spark, sf)
    out = R.run_info(spark, "All", "Emb", "Mouse", "medium", train, test)
    return rounded(out.withColumns({x: F.array_join(x, ",") for x in ("train_labels", "test_labels")}))


@register("importance_statistics", X.with_ctes([], """
SELECT feature, round(importance, 6) AS importance, round(stddev, 6) AS stddev,
       round(0.5 - sin(a) * (1 + pow(cos(a), 2) / 2 + 3 * pow(cos(a), 4) / 8) / 2, 6) AS p_value, n,
       round(importance + 3.7074280213 * stddev / sqrt(7), 6) AS p99_high,
       round(importance - 3.7074280213 * stddev / sqrt(7), 6) AS p99_low
FROM (SELECT *, atan(importance / (stddev / sqrt(7)) / sqrt(6)) AS a FROM (
  SELECT feature, avg(0.05 - score) AS importance, stddev_samp(0.05 - score) AS stddev, count(*) AS n FROM (
    SELECT concat(l_returnflag, l_linestatus) AS feature, l_linenumber, avg(CAST(l_discount AS DOUBLE)) AS score
    FROM lineitem GROUP BY 1, 2) s GROUP BY feature) m) t"""))
def q_importance_statistics(spark, sf):
    """E9 on given scores: the mean discount by return flag and line status (feature) and line number (seven shuffles);
    the SQL has the closed form of Student's t for six degrees of freedom."""
    scores = X.read(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("feature"), "l_linenumber").agg(
        F.avg(F.col("l_discount").cast("double")).alias("score"))
    return rounded(IMP.importance_stats(scores, 0.05))


@register("write_table", X.with_ctes(["li"], "SELECT label, id, round(price, 6) AS price FROM li WHERE label = 'N'"))
def q_write_table(spark, sf):
    """A table written by class into the shared folder, one class read back (partition pruning)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidewell-written-{uuid.uuid4().hex}"
    S.write_table(X.li(spark, sf).select("id", "price", "label"), path, partition_by=["label"])
    return rounded(spark.read.parquet(path).filter(F.col("label") == "N").select("label", "id", "price"))


@register("load_or_build", X.with_ctes(["emb"], """
SELECT id, label, CASE WHEN rn <= round_even(n * 0.2, 0) THEN 'test' ELSE 'train' END AS split FROM sp""", [
    f"""sp AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_hash('id')}, id) AS rn,
             count(*) OVER (PARTITION BY label) AS n FROM emb)"""]))
def q_load_or_build(spark, sf):
    """Train and test tables built and saved by the first call, loaded by the second."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidewell-built-{uuid.uuid4().hex}"
    S.load_or_build(spark, f"{path}/train", f"{path}/test", lambda: emb_split(spark, sf))

    def never():
        raise RuntimeError("both tables were saved by the first call")
    train, test = S.load_or_build(spark, f"{path}/train", f"{path}/test", never)
    return (train.select("id", "label", F.lit("train").alias("split"))
            .unionByName(test.select("id", "label", F.lit("test").alias("split"))))


@register("sweep_resumed", X.with_ctes(["li"], " UNION ALL ".join(
    f"SELECT label, count(*) AS n, '{m}' AS min_rows, '{q}' AS tax FROM li WHERE tax >= {q} AND label IS NOT NULL "
    f"GROUP BY label HAVING count(*) >= {m}" for m in (1, 100) for q in (0.02, 0.05))))
def q_sweep_resumed(spark, sf):
    """A sweep of class counts that stopped after half its grid, resumed over the whole grid."""
    from tidewell.operators import stats as G
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidewell-sweep-{uuid.uuid4().hex}"

    def cell(min_rows, tax):
        rows = X.li(spark, sf).filter(F.col("tax") >= tax)
        return G.class_counts(G.filter_min_class(rows, "label", min_rows))
    TS.sweep({"min_rows": [1], "tax": [0.02, 0.05]}, cell, path, spark)
    return TS.sweep({"min_rows": [1, 100], "tax": [0.02, 0.05]}, cell, path, spark)


@register("list_datasets")
def q_list(spark, sf):
    """S3: data files of the input directory."""
    return S.list_datasets(spark, sf).select("name", "format")


@register("read_table", X.with_ctes([], "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, round(c_acctbal, 6) AS c_acctbal "
          "FROM customer"))
def q_read(spark, sf):
    """A Parquet table read with a named key turned into a STRING id."""
    df = S.read_table(spark, f"{sf}/customer.parquet", fmt="parquet", key="c_custkey")
    return rounded(df.select("id", "c_name", "c_acctbal"))


_PREP_SQL = X.with_ctes(["meta", "ephys", "morph"], """
SELECT id, label, round(n_orders, 6) AS n_orders, round(total_price, 6) AS total_price, round(avg_price, 6) AS avg_price, round(max_price, 6) AS max_price, round(n_urgent, 6) AS n_urgent, round(n_lines, 6) AS n_lines, round(avg_qty, 6) AS avg_qty, round(avg_disc, 6) AS avg_disc, round(L23_depth_normalized, 6) AS L23_depth_normalized FROM (
  SELECT id, label, n_orders, total_price, avg_price, max_price, n_urgent, n_lines, avg_qty, avg_disc, L23_depth_normalized FROM sc
  UNION ALL SELECT id || '#' || CAST(copy AS VARCHAR), label, n_orders, total_price, avg_price, max_price, n_urgent, n_lines, avg_qty, avg_disc, L23_depth_normalized FROM copies) t""", [
    QC._META_L, QC._MORPH_F, QC._BOTH,
    "lab AS (SELECT * FROM both_l WHERE label IS DISTINCT FROM 'UNKNOWN')",
    "mc AS (SELECT * FROM lab WHERE label IN (SELECT label FROM lab WHERE label IS NOT NULL GROUP BY label "
    "HAVING count(*) >= 5))",
    "ns AS (SELECT * FROM mc WHERE (CAST(n_orders IS NULL AS INT) + CAST(total_price IS NULL AS INT) + CAST(avg_price IS NULL AS INT) + CAST(max_price IS NULL AS INT) + CAST(n_urgent IS NULL AS INT) + CAST(n_lines IS NULL AS INT) + CAST(avg_qty IS NULL AS INT) + CAST(avg_disc IS NULL AS INT) + CAST(L23_depth_normalized IS NULL AS INT) + CAST(label IS NULL AS INT)) <= 0.2 * 10)",
    f"sp AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_hash('id')}, id) AS rn, "
    "count(*) OVER (PARTITION BY label) AS n FROM ns)",
    "tr AS (SELECT * FROM sp WHERE rn > round_even(n * 0.2, 0))",
    "st AS (SELECT avg(n_orders) AS m_n_orders, CASE WHEN stddev_pop(n_orders) = 0 THEN 1 ELSE stddev_pop(n_orders) END AS s_n_orders, avg(total_price) AS m_total_price, CASE WHEN stddev_pop(total_price) = 0 THEN 1 ELSE stddev_pop(total_price) END AS s_total_price, avg(avg_price) AS m_avg_price, CASE WHEN stddev_pop(avg_price) = 0 THEN 1 ELSE stddev_pop(avg_price) END AS s_avg_price, avg(max_price) AS m_max_price, CASE WHEN stddev_pop(max_price) = 0 THEN 1 ELSE stddev_pop(max_price) END AS s_max_price, avg(n_urgent) AS m_n_urgent, CASE WHEN stddev_pop(n_urgent) = 0 THEN 1 ELSE stddev_pop(n_urgent) END AS s_n_urgent, avg(n_lines) AS m_n_lines, CASE WHEN stddev_pop(n_lines) = 0 THEN 1 ELSE stddev_pop(n_lines) END AS s_n_lines, avg(avg_qty) AS m_avg_qty, CASE WHEN stddev_pop(avg_qty) = 0 THEN 1 ELSE stddev_pop(avg_qty) END AS s_avg_qty, avg(avg_disc) AS m_avg_disc, CASE WHEN stddev_pop(avg_disc) = 0 THEN 1 ELSE stddev_pop(avg_disc) END AS s_avg_disc, avg(L23_depth_normalized) AS m_L23_depth_normalized, CASE WHEN stddev_pop(L23_depth_normalized) = 0 THEN 1 ELSE stddev_pop(L23_depth_normalized) END AS s_L23_depth_normalized FROM tr)",
    "sc AS (SELECT id, label, (n_orders - m_n_orders) / s_n_orders AS n_orders, (total_price - m_total_price) / s_total_price AS total_price, (avg_price - m_avg_price) / s_avg_price AS avg_price, (max_price - m_max_price) / s_max_price AS max_price, (n_urgent - m_n_urgent) / s_n_urgent AS n_urgent, (n_lines - m_n_lines) / s_n_lines AS n_lines, (avg_qty - m_avg_qty) / s_avg_qty AS avg_qty, (avg_disc - m_avg_disc) / s_avg_disc AS avg_disc, (L23_depth_normalized - m_L23_depth_normalized) / s_L23_depth_normalized AS L23_depth_normalized FROM tr, st)",
    "need AS (SELECT label, count(*) AS c, max(count(*)) OVER () - count(*) AS need FROM sc GROUP BY label)",
    f"dealt AS (SELECT sc.*, need.need, row_number() OVER (PARTITION BY sc.label ORDER BY {sql_hash('id', 'random')}, "
    "id) AS rn, need.c AS ns FROM sc JOIN need ON sc.label = need.label WHERE need.need > 0)",
    "copies AS (SELECT *, unnest(generate_series(0, CAST(floor(need / ns) + CASE WHEN rn <= need % ns THEN 1 ELSE 0 END "
    "AS BIGINT) - 1)) AS copy FROM dealt)"])


@register("prepared_train", _PREP_SQL, headline=True)
def q_prepared(spark, sf):
    """Filter → split → kNN impute → standard scale → random oversample; the train table."""
    lab, unl = assembled(spark, sf)
    from tidewell.spec import Spec
    p = prepare(lab, unl, Spec("id", "label"), PrepConfig(scaler="standard", oversample="random"))
    return rounded(p["train"])


@register("impute_tree")
def q_impute_tree(spark, sf):
    """I4: chained single-tree imputation (sqrt feature subsets, 10 rounds) of the embedding NULLs."""
    from tidewell.operators.impute import impute_iterative
    return rounded(impute_iterative(X.embn(spark, sf), X.EMB_SPEC, "decisiontree", max_iter=10).select("id", *EMBF))


@register("student_baseline")
def q_student_baseline(spark, sf):
    """Students fit on the train table without a teacher; leaderboard."""
    train, test = emb_split(spark, sf)
    return M.leaderboard(D.student_baseline(train, X.EMB_SPEC, ["LR", "RandomForestEntr"]), X.EMB_SPEC,
                         test=test).select("model", "score_test")


def _munge_sql() -> str:
    def draw(f: str, salt: str) -> str:
        return (f"(CAST(('0x' || substr(md5('42|' || concat_ws('|', t.id, CAST(0 AS VARCHAR), '{f}') || '|{salt}'), 1, 13)) "
                "AS BIGINT) / CAST(4503599627370496 AS DOUBLE))")

    def moved(f: str) -> str:
        normal = f"sqrt(-2.0 * ln(greatest({draw(f, 'mna')}, 1e-300))) * cos(6.283185307179586 * {draw(f, 'mnb')})"
        return (f"round(CASE WHEN {draw(f, 'munge')} < 0.5 AND b.{f} IS NOT NULL "
                f"THEN b.{f} + (abs(t.{f} - b.{f}) / 1.0) * ({normal}) ELSE t.{f} END, 6) AS {f}")

    square = " + ".join(f"(p.{f} - q.{f}) * (p.{f} - q.{f})" for f in X.EMB_FEATURES)
    return X.with_ctes(["emb"], "SELECT t.id || '#m0' AS id, " + ", ".join(moved(f) for f in X.EMB_FEATURES)
                       + " FROM emb t LEFT JOIN nn ON nn.pid = t.id LEFT JOIN emb b ON b.id = nn.bid",
                       ["nn AS (SELECT pid, bid FROM (SELECT p.id AS pid, q.id AS bid, row_number() OVER (PARTITION BY p.id "
                        f"ORDER BY sqrt({square}), q.id) AS r FROM emb p JOIN emb q ON p.id <> q.id) x WHERE r = 1)"])


_MUNGE_SQL = _munge_sql()


@register("augment_munge", _MUNGE_SQL)
def q_munge(spark, sf):
    """MUNGE copies (p = 0.5, s = 1) of the embedding rows around their nearest neighbour."""
    return rounded(D.augment_munge(X.emb(spark, sf), X.EMB_SPEC, 0.5, 1.0, 1))
