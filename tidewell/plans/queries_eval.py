"""Registered queries: evaluation metrics on key-derived predictions."""

from __future__ import annotations

from tidewell.operators import metrics as E
from tidewell.plans import fixtures as X
from tidewell.plans.registry import register, rounded

_P = ["preds"]
_LABELS = "labs AS (SELECT DISTINCT c FROM (SELECT actual AS c FROM preds UNION SELECT predicted FROM preds) t " \
          "WHERE c IS NOT NULL)"
_CM = """cm AS (SELECT a.c AS actual, p.c AS predicted, CAST(count(x.id) AS BIGINT) AS n
  FROM labs a CROSS JOIN labs p LEFT JOIN preds x ON x.actual = a.c AND x.predicted = p.c
  GROUP BY a.c, p.c)"""
_PC = """pc AS (SELECT l.c AS label,
    (SELECT n FROM cm WHERE actual = l.c AND predicted = l.c) AS tp,
    (SELECT sum(n) FROM cm WHERE actual = l.c) AS support,
    (SELECT sum(n) FROM cm WHERE predicted = l.c) AS pred_n
  FROM labs l),
pc2 AS (SELECT *, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc),
pc3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
               AS f1 FROM pc2)"""


def _pairs(spark, sf):
    return X.preds(spark, sf)


@register("predicted_vs_actual", X.with_ctes(_P, "SELECT id, predicted, actual FROM preds"))
def q_pva(spark, sf):
    """Predictions next to the truth by key."""
    p = X.preds(spark, sf)
    return E.predicted_vs_actual(p.select("id", "predicted"), X.truth(spark, sf))


@register("confusion_matrix", X.with_ctes(_P, "SELECT actual, predicted, n FROM cm", [_LABELS, _CM]), headline=True)
def q_cm(spark, sf):
    """Long confusion matrix over sorted labels; RARE is never predicted (zero column)."""
    return E.confusion_matrix(_pairs(spark, sf))


@register("classification_report", X.with_ctes(_P, """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM pc3
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pc3
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM pc3
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM pc3""", [_LABELS, _CM, _PC]))
def q_report(spark, sf):
    """E3."""
    return rounded(E.classification_report(_pairs(spark, sf)))


_LM_SQL = X.with_ctes(_P, """
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'accuracy' AS metric, sum(tp) / sum(support) AS value FROM pc3
  UNION ALL SELECT 'balanced_accuracy', avg(CASE WHEN support > 0 THEN recall END) FROM pc3
  UNION ALL SELECT 'precision_macro', avg(precision) FROM pc3
  UNION ALL SELECT 'precision_micro', sum(tp) / sum(support) FROM pc3
  UNION ALL SELECT 'precision_weighted', sum(precision * support) / sum(support) FROM pc3
  UNION ALL SELECT 'recall_macro', avg(recall) FROM pc3
  UNION ALL SELECT 'recall_micro', sum(tp) / sum(support) FROM pc3
  UNION ALL SELECT 'recall_weighted', sum(recall * support) / sum(support) FROM pc3
  UNION ALL SELECT 'f1_macro', avg(f1) FROM pc3
  UNION ALL SELECT 'f1_micro', sum(tp) / sum(support) FROM pc3
  UNION ALL SELECT 'f1_weighted', sum(f1 * support) / sum(support) FROM pc3
  UNION ALL SELECT 'precision', precision FROM pc3 WHERE label = 'A'
  UNION ALL SELECT 'recall', recall FROM pc3 WHERE label = 'A'
  UNION ALL SELECT 'f1', f1 FROM pc3 WHERE label = 'A') t""", [_LABELS, _CM, _PC])


@register("label_metrics", _LM_SQL, headline=True)
def q_label_metrics(spark, sf):
    """Accuracy family (+ one-class precision/recall/f1 for class A)."""
    return rounded(E.label_metrics(_pairs(spark, sf), pos_label="A"))


@register("log_loss", X.with_ctes(["preds", "probs", "truth"], """
SELECT 'log_loss' AS metric, round(-avg(ln(least(greatest(coalesce(p.p, 1e-15), 1e-15), 1 - 1e-15))), 6) AS value
FROM truth t LEFT JOIN probs p ON t.id = p.id AND t.label = p.class"""))
def q_log_loss(spark, sf):
    """E5 log_loss (RARE rows have no probability: they count as p = 1e-15)."""
    return rounded(E.log_loss(X.probs(spark, sf), X.truth(spark, sf)))


_AUC_SQL = X.with_ctes(["preds", "probs", "truth"], """
SELECT class, round(auc, 6) AS auc FROM a
UNION ALL SELECT NULL, round(avg(auc), 6) FROM a""", ["""j AS (SELECT p.*, t.label AS y FROM probs p JOIN truth t ON p.id = t.id),
dv AS (SELECT class, p, count(*) AS c, sum(CASE WHEN class = y THEN 1 ELSE 0 END) AS pos FROM j GROUP BY class, p),
r AS (SELECT *, sum(c) OVER (PARTITION BY class ORDER BY p ROWS UNBOUNDED PRECEDING) AS cum,
             sum(c) OVER (PARTITION BY class) AS n, sum(pos) OVER (PARTITION BY class) AS pp FROM dv),
a AS (SELECT class, CASE WHEN max(pp) * (max(n) - max(pp)) > 0 THEN
        (sum(pos * (cum - (c - 1) / 2.0)) - max(pp) * (max(pp) + 1) / 2.0) / (max(pp) * (max(n) - max(pp))) END AS auc
      FROM r GROUP BY class)"""])


@register("roc_auc_ovr", _AUC_SQL, headline=True)
def q_auc(spark, sf):
    """E5 roc_auc (one-vs-rest per class, macro mean as class NULL), tied scores averaged."""
    return rounded(E.roc_auc_ovr(X.probs(spark, sf), X.truth(spark, sf)))


_AP_SQL = X.with_ctes(["preds", "probs", "truth"], """
SELECT class, round(ap, 6) AS ap FROM a
UNION ALL SELECT NULL, round(avg(ap), 6) FROM a""", ["""j AS (SELECT p.*, t.label AS y FROM probs p JOIN truth t ON p.id = t.id),
dv AS (SELECT class, p, count(*) AS c, sum(CASE WHEN class = y THEN 1 ELSE 0 END) AS pos FROM j GROUP BY class, p),
r AS (SELECT *, sum(c) OVER (PARTITION BY class ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum,
             sum(pos) OVER (PARTITION BY class ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cumpos,
             sum(pos) OVER (PARTITION BY class) AS npos FROM dv),
a AS (SELECT class, sum(pos / npos * (cumpos / cum)) AS ap FROM r WHERE npos > 0 GROUP BY class)"""])


@register("average_precision", _AP_SQL)
def q_ap(spark, sf):
    """E5 average_precision per class and macro."""
    return rounded(E.average_precision(X.probs(spark, sf), X.truth(spark, sf)))


@register("roc_auc_ovo_macro", X.with_ctes(["preds", "probs", "truth"], """
SELECT 'roc_auc_ovo_macro' AS metric, round(avg(auc), 6) AS value FROM a""", [
    """cls AS (SELECT DISTINCT label AS c FROM truth WHERE label IS NOT NULL),
pr AS (SELECT x.c AS ca, y.c AS cb FROM cls x CROSS JOIN cls y WHERE x.c <> y.c),
j AS (SELECT p.*, t.label AS y FROM probs p JOIN truth t ON p.id = t.id),
sub AS (SELECT pr.ca, pr.cb, j.p, j.y FROM j JOIN pr ON j.class = pr.ca AND j.y IN (pr.ca, pr.cb)),
dv AS (SELECT ca, cb, p, count(*) AS c, sum(CASE WHEN y = ca THEN 1 ELSE 0 END) AS pos FROM sub GROUP BY ca, cb, p),
r AS (SELECT *, sum(c) OVER (PARTITION BY ca, cb ORDER BY p ROWS UNBOUNDED PRECEDING) AS cum,
             sum(c) OVER (PARTITION BY ca, cb) AS n FROM dv),
a AS (SELECT ca, cb, CASE WHEN sum(pos) * (max(n) - sum(pos)) > 0 THEN
        (sum(pos * (cum - (c - 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (max(n) - sum(pos))) END AS auc
      FROM r GROUP BY ca, cb)"""]))
def q_auc_ovo(spark, sf):
    """E5 roc_auc_ovo_macro (Hand & Till pairwise mean)."""
    return rounded(E.roc_auc_ovo_macro(X.probs(spark, sf), X.truth(spark, sf)))


@register("soft_log_loss", X.with_ctes(["probs", "sprobs"], """
SELECT 'soft_log_loss' AS metric, round(avg(ce), 6) AS value FROM (
  SELECT t.id, -sum(t.p * ln(least(greatest(s.p, 1e-15), 1 - 1e-15))) AS ce
  FROM probs t JOIN sprobs s ON t.id = s.id AND t.class = s.class GROUP BY t.id) x"""))
def q_soft_log_loss(spark, sf):
    """Student cross-entropy against teacher probabilities."""
    return rounded(E.soft_log_loss(X.probs(spark, sf, student=True), X.probs(spark, sf)))


@register("regression_metrics", X.with_ctes(["reg"], """
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'r2' AS metric, CASE WHEN var_pop(y) > 0 THEN 1 - avg((y - pred) * (y - pred)) / var_pop(y) ELSE 0.0 END AS value FROM reg
  UNION ALL SELECT 'mae', avg(abs(y - pred)) FROM reg
  UNION ALL SELECT 'mse', avg((y - pred) * (y - pred)) FROM reg
  UNION ALL SELECT 'rmse', sqrt(avg((y - pred) * (y - pred))) FROM reg
  UNION ALL SELECT 'mape', avg(abs(y - pred) / greatest(abs(y), 2.220446049250313e-16)) FROM reg
  UNION ALL SELECT 'smape', avg(CASE WHEN abs(y) + abs(pred) = 0 THEN 0.0 ELSE 2 * abs(y - pred) / (abs(y) + abs(pred)) END) FROM reg
  UNION ALL SELECT 'msle', avg(pow(ln(1 + y) - ln(1 + pred), 2)) FROM reg
  UNION ALL SELECT 'rmsle', sqrt(avg(pow(ln(1 + y) - ln(1 + pred), 2))) FROM reg
  UNION ALL SELECT 'median_ae', quantile_cont(abs(y - pred), 0.5) FROM reg) t"""))
def q_regression(spark, sf):
    """Regression metrics of price against a quantity-based guess."""
    return rounded(E.regression_metrics(X.regression_pairs(spark, sf), "y", "pred"))


@register("spearman", X.with_ctes(["reg"], """
SELECT 'spearmanr' AS metric, round(corr(ra, rb), 6) AS value FROM (
  SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS rb FROM reg) t"""))
def q_spearman(spark, sf):
    """E6 spearmanr with average ranks for ties."""
    return rounded(E.spearman(X.regression_pairs(spark, sf), "y", "pred"))


@register("row_argmax", X.with_ctes(["probs"], """
SELECT id, class AS predicted, round(p, 6) AS p_max FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, class) AS r FROM probs) t WHERE r = 1"""))
def q_argmax(spark, sf):
    """Predicted class = argmax of a probability table."""
    return rounded(E.row_argmax(X.probs(spark, sf)))
