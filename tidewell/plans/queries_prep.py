"""Registered queries: split, scaling, imputation, oversampling (T*, N*, I*, O*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import impute as I
from tidewell.operators import sample as O
from tidewell.operators import scale as N
from tidewell.operators import split as T
from tidewell.operators import stats as G
from tidewell.plans import fixtures as X
from tidewell.plans.fixtures import sql_hash, sql_uniform
from tidewell.plans.registry import register, rounded

LIF = list(X.LI_FEATURES)
EMBF = list(X.EMB_FEATURES)
_MINCLASS = """mc AS (SELECT * FROM li WHERE label IN
  (SELECT label FROM li WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 5))"""
_NULLSHARE = """ns AS (SELECT * FROM mc WHERE
  (CAST(quantity IS NULL AS INT) + CAST(price IS NULL AS INT) + CAST(discount IS NULL AS INT)
   + CAST(tax IS NULL AS INT) + CAST(label IS NULL AS INT)) <= 0.2 * 5)"""


def filtered(spark, sf):
    return G.filter_null_share(G.filter_min_class(X.li(spark, sf)), "id", 0.2)


def _r(cols, prefix=""):
    return ", ".join(f"round(CAST({prefix}{x} AS DOUBLE), 6) AS {x}" for x in cols)


# ------------------------------------------------------------------ split

_SPLIT_SQL = X.with_ctes(["li"], f"""
SELECT id, label, {_r(LIF)},
       CASE WHEN rn <= round_even(n * 0.2, 0) THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_hash('id')}, id) AS rn,
             count(*) OVER (PARTITION BY label) AS n FROM ns) t""", [_MINCLASS, _NULLSHARE])


@register("split_stratified", _SPLIT_SQL, headline=True)
def q_split(spark, sf):
    """Stratified 80/20 split of the filtered lineitem table."""
    return rounded(T.assign_split(filtered(spark, sf), "id", "label", 0.2, 42))


@register("split_plain", X.with_ctes(["li"], f"""
SELECT id, label, CASE WHEN rn <= round_even(n * 0.25, 0) THEN 'test' ELSE 'train' END AS split
FROM (SELECT id, label, row_number() OVER (ORDER BY {sql_hash('id')}, id) AS rn, count(*) OVER () AS n FROM li) t"""))
def q_split_plain(spark, sf):
    """T1 without stratification (25 % test)."""
    return T.assign_split(X.li(spark, sf).select("id", "label"), "id", None, 0.25, 42)


@register("holdout_validation", X.with_ctes(["li"], f"""
SELECT id, label, CASE WHEN rn <= round_even(n * 0.2, 0) THEN 'val' ELSE 'fit' END AS subset
FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_hash('id', 'val')}, id) AS rn,
             count(*) OVER (PARTITION BY label) AS n FROM ns) t""", [_MINCLASS, _NULLSHARE]))
def q_holdout(spark, sf):
    """Internal validation split (independent salt)."""
    return T.holdout(filtered(spark, sf).select("id", "label"), "id", "label", 0.2, 42)


@register("kfold_5x2", X.with_ctes(["emb"], f"""
SELECT id, label, r AS repeat,
       CAST((row_number() OVER (PARTITION BY label, r ORDER BY {sql_hash("id || '|' || CAST(r AS VARCHAR)")}, id) - 1) % 5
            AS BIGINT) AS fold
FROM emb, range(2) t(r)"""))
def q_kfold(spark, sf):
    """5 folds × 2 repeats, stratified."""
    return T.kfold(X.emb(spark, sf), 5, 2, "id", "label", 42).withColumn("repeat", F.col("repeat").cast("bigint"))


# ------------------------------------------------------------------ scaling

def _scaled(method, **kw):
    def run(spark, sf):
        df = filtered(spark, sf)
        out, _ = N.scale(df, LIF, method, **kw)
        return rounded(out.select("id", "label", *LIF))
    return run


def _scale_sql(expr_of) -> str:
    cols = ", ".join(f"round({expr_of(x)}, 6) AS {x}" for x in LIF)
    return X.with_ctes(["li"], f"SELECT id, label, {cols} FROM ns", [_MINCLASS, _NULLSHARE])


register("scale_standard", _scale_sql(
    lambda x: f"({x} - (SELECT avg({x}) FROM ns)) / (SELECT CASE WHEN stddev_pop({x}) = 0 THEN 1 "
              f"ELSE stddev_pop({x}) END FROM ns)"), headline=True)(_scaled("standard"))
register("scale_maxabs", _scale_sql(
    lambda x: f"{x} / (SELECT CASE WHEN max(abs({x})) = 0 THEN 1 ELSE max(abs({x})) END FROM ns)"))(_scaled("maxabs"))
register("scale_minmax", _scale_sql(
    lambda x: f"CASE WHEN {x} IS NULL THEN NULL WHEN (SELECT max({x}) - min({x}) FROM ns) = 0 THEN 0.0 "
              f"ELSE ({x} - (SELECT min({x}) FROM ns)) / (SELECT max({x}) - min({x}) FROM ns) END"))(_scaled("minmax"))
register("scale_robust", _scale_sql(
    lambda x: f"({x} - (SELECT quantile_cont({x}, 0.5) FROM ns)) / (SELECT CASE WHEN quantile_cont({x}, 0.75) - "
              f"quantile_cont({x}, 0.25) = 0 THEN 1 ELSE quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) END "
              f"FROM ns)"))(_scaled("robust"))


def _norm_sql():
    sq = " + ".join(f"coalesce(e{i}, 0) * coalesce(e{i}, 0)" for i in range(X.N_EMB))
    nrm = f"CASE WHEN sqrt({sq}) = 0 THEN 1 ELSE sqrt({sq}) END"
    return X.with_ctes(["emb"], "SELECT id, label, " + ", ".join(
        f"round(e{i} / ({nrm}), 6) AS e{i}" for i in range(X.N_EMB)) + " FROM emb")


@register("normalize_rows_l2", _norm_sql())
def q_normalize(spark, sf):
    """l2 row normalisation of the embedding components."""
    return rounded(N.normalize_rows(X.emb(spark, sf), EMBF, "l2").select("id", "label", *EMBF))


def _yj_sql(v: str, lam: str) -> str:
    return (f"(CASE WHEN {v} >= 0 THEN (CASE WHEN abs({lam}) < 1e-12 THEN ln(1 + {v}) "
            f"ELSE (pow({v} + 1, {lam}) - 1) / {lam} END) "
            f"ELSE (CASE WHEN abs({lam} - 2) < 1e-12 THEN -ln(1 - {v}) "
            f"ELSE -(pow(1 - {v}, 2 - {lam}) - 1) / (2 - {lam}) END) END)")


def _power_sql(steps: int = 25) -> str:
    vals = " UNION ALL ".join(f"SELECT '{x}' AS f, {x} AS v FROM ns WHERE {x} IS NOT NULL" for x in LIF)
    ctes = [_MINCLASS, _NULLSHARE, f"vals AS ({vals})",
            "base AS (SELECT f, count(v) AS n, sum(sign(v) * ln(1 + abs(v))) AS jac FROM vals GROUP BY f)",
            "r0 AS (SELECT f, CAST(-3.0 AS DOUBLE) AS lo, CAST(3.0 AS DOUBLE) AS hi FROM base)"]
    for i in (1, 2, 3):
        ctes += [
            f"g{i} AS (SELECT r.f, r.lo + (r.hi - r.lo) * t.k / {steps - 1} AS lam, r.lo, r.hi "
            f"FROM r{i - 1} r, range({steps}) t(k))",
            f"e{i} AS (SELECT g.f, g.lam, g.lo, g.hi, sum({_yj_sql('v.v', 'g.lam')}) AS s, "
            f"sum({_yj_sql('v.v', 'g.lam')} * {_yj_sql('v.v', 'g.lam')}) AS sq FROM g{i} g JOIN vals v ON v.f = g.f "
            "GROUP BY g.f, g.lam, g.lo, g.hi)",
            f"l{i} AS (SELECT e.*, CASE WHEN e.sq / b.n - (e.s / b.n) * (e.s / b.n) > 0 THEN "
            f"-b.n / 2 * ln(e.sq / b.n - (e.s / b.n) * (e.s / b.n)) + (e.lam - 1) * b.jac END AS ll, "
            f"row_number() OVER (PARTITION BY e.f ORDER BY CASE WHEN e.sq / b.n - (e.s / b.n) * (e.s / b.n) > 0 THEN "
            f"-b.n / 2 * ln(e.sq / b.n - (e.s / b.n) * (e.s / b.n)) + (e.lam - 1) * b.jac END DESC NULLS LAST, "
            f"e.lam DESC) AS rk FROM e{i} e JOIN base b ON b.f = e.f)",
            f"r{i} AS (SELECT f, lam - (hi - lo) / {steps - 1} AS lo, lam + (hi - lo) / {steps - 1} AS hi, lam "
            f"FROM l{i} WHERE rk = 1)"]
    ctes.append(f"mo AS (SELECT r.f, r.lam, avg({_yj_sql('v.v', 'r.lam')}) AS mean, "
                f"CASE WHEN stddev_pop({_yj_sql('v.v', 'r.lam')}) = 0 THEN 1.0 ELSE stddev_pop({_yj_sql('v.v', 'r.lam')}) "
                "END AS scale FROM r3 r JOIN vals v ON v.f = r.f GROUP BY r.f, r.lam)")
    cols = ", ".join(
        f"round(({_yj_sql(x, f'(SELECT lam FROM mo WHERE f = {chr(39)}{x}{chr(39)})')} - "
        f"(SELECT mean FROM mo WHERE f = '{x}')) / (SELECT scale FROM mo WHERE f = '{x}'), 6) AS {x}" for x in LIF)
    return X.with_ctes(["li"], f"SELECT id, label, {cols} FROM ns", ctes)


@register("scale_power", _power_sql())
def q_power(spark, sf):
    """Yeo-Johnson λ per feature (three zooming grid passes), then standardised."""
    out, _ = N.scale(filtered(spark, sf), LIF, "power")
    return rounded(out.select("id", "label", *LIF))


def _quantile_sql(points: int = 1000) -> str:
    back = ", ".join(f"round(max(CASE WHEN f = '{x}' THEN v END), 6) AS {x}" for x in EMBF)
    return X.with_ctes(["emb"], f"SELECT id, label, {back} FROM tv GROUP BY id, label", [
        f"vals AS (SELECT id, label, f, x FROM (UNPIVOT emb ON {', '.join(EMBF)} INTO NAME f VALUE x))",
        "ranked AS (SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) - 1 AS rn FROM vals)",
        f"mm AS (SELECT least({points}, count(*)) AS m, count(*) AS n FROM emb)",
        "pos AS (SELECT f, j, j / (m - 1) AS r, j / (m - 1) * (n - 1) AS h "
        f"FROM (SELECT DISTINCT f FROM vals) d, mm, range({points}) t(j) WHERE j < m)",
        "pts AS (SELECT pos.f, j, r, a.x + (h - floor(h)) * (b.x - a.x) AS q FROM pos "
        "JOIN ranked a ON a.f = pos.f AND a.rn = CAST(floor(h) AS BIGINT) "
        "JOIN ranked b ON b.f = pos.f AND b.rn = CAST(ceil(h) AS BIGINT))",
        "kk AS (SELECT v.*, mm.m, (SELECT count(*) FROM pts p WHERE p.f = v.f AND p.q <= v.x) AS k, "
        "(SELECT count(*) FROM pts p WHERE p.f = v.f AND p.q >= v.x) AS kb FROM vals v, mm)",
        """tv AS (SELECT kk.id, kk.label, kk.f, 0.5 * (
  (CASE WHEN k = 0 THEN 0.0 WHEN k >= m THEN 1.0 ELSE a.r + (kk.x - a.q) * (b.r - a.r) / (b.q - a.q) END)
  + (CASE WHEN kb = 0 THEN 1.0 WHEN kb >= m THEN 0.0 ELSE a2.r + (kk.x - a2.q) * (b2.r - a2.r) / (b2.q - a2.q) END)) AS v
FROM kk LEFT JOIN pts a ON a.f = kk.f AND a.j = k - 1 LEFT JOIN pts b ON b.f = kk.f AND b.j = k
LEFT JOIN pts a2 ON a2.f = kk.f AND a2.j = m - kb LEFT JOIN pts b2 ON b2.f = kk.f AND b2.j = m - kb - 1)"""])


@register("scale_quantile", _quantile_sql())
def q_quantile(spark, sf):
    """Quantile transform to uniform with at most 1,000 reference points (symmetric interpolation)."""
    out, _ = N.scale(X.emb(spark, sf), EMBF, "quantile", n_quantiles=1000)
    return rounded(out.select("id", "label", *EMBF))


# ------------------------------------------------------------------ imputation


def _knn_impute_sql(k: int = 5) -> str:
    d, holes = len(EMBF), [x for x, _, _ in X.EMBN_HOLES]  # only these can be NULL
    term = {x: f"(p.{x} - b.{x}) * (p.{x} - b.{x})" for x in EMBF}
    acc = " + ".join(f"coalesce({t}, 0)" if x in holes else t for x, t in term.items())
    cnt = f"{d - len(holes)} + " + " + ".join(f"CAST(p.{x} IS NOT NULL AND b.{x} IS NOT NULL AS INT)" for x in holes)
    anynull = " OR ".join(f"{x} IS NULL" for x in holes)
    ctes = [f"probes AS MATERIALIZED (SELECT * FROM embn WHERE {anynull})",
            "dd AS MATERIALIZED (SELECT p.id AS pid, b.id AS bid, " + ", ".join(f"b.{x} AS {x}" for x in holes) +
            f", sqrt((CAST({d} AS DOUBLE) / ({cnt})) * ({acc})) AS dist FROM probes p, embn b)"]
    for x in holes:
        ctes.append(f"f_{x} AS (SELECT pid, avg({x}) AS f FROM (SELECT pid, {x}, row_number() OVER "
                    f"(PARTITION BY pid ORDER BY dist, bid) AS rn FROM dd WHERE {x} IS NOT NULL) t "
                    f"WHERE rn <= {k} GROUP BY pid)")
    cols = ", ".join(f"round(coalesce(p.{x}, f_{x}.f, (SELECT avg({x}) FROM embn)), 6) AS {x}" if x in holes
                     else f"round(p.{x}, 6) AS {x}" for x in EMBF)
    joins = " ".join(f"LEFT JOIN f_{x} ON p.id = f_{x}.pid" for x in holes)
    body = (f"SELECT p.id, p.label, {cols} FROM probes p {joins}\nUNION ALL\n"
            f"SELECT id, label, {_r(EMBF)} FROM embn WHERE NOT ({anynull})")
    return X.with_ctes(["emb", "embn"], body, ctes)


@register("impute_knn", _knn_impute_sql(5), headline=True)
def q_impute_knn(spark, sf):
    """kNN imputation (k = 5, NaN-aware distance) of three components with NULLs."""
    out = I.impute_knn(X.embn(spark, sf), X.EMB_SPEC, 5)
    return rounded(out.select("id", "label", *EMBF))


@register("impute_linear")
def q_impute_linear(spark, sf):
    """Chained linear regression imputation of the lineitem NULLs (10 rounds)."""
    out = I.impute_iterative(filtered(spark, sf), X.LI_SPEC, "linear", max_iter=10)
    return rounded(out.select("id", "label", *LIF))


@register("fill_na_mean", X.with_ctes(["li"], "SELECT id, label, " + ", ".join(
    f"round(coalesce({x}, (SELECT avg({x}) FROM li)), 6) AS {x}" for x in LIF) + " FROM li"))
def q_fill_na(spark, sf):
    """I6 fill_na: NULL → column mean."""
    return rounded(I.fill_na(X.li(spark, sf), LIF).select("id", "label", *LIF))


@register("drop_useless_columns", X.with_ctes(["emb"], f"SELECT id, label, {_r(EMBF)} FROM emb"))
def q_drop_useless(spark, sf):
    """A constant and a duplicated column are detected and dropped."""
    e = X.emb(spark, sf).withColumn("const", F.lit(1.0)).withColumn("e0_copy", F.col("e0"))
    out, kept = I.drop_useless(e, EMBF + ["const", "e0_copy"])
    return rounded(out.select("id", "label", *kept))


# ------------------------------------------------------------------ oversampling

_NEED = """cnt AS (SELECT label, count(*) AS n FROM emb GROUP BY label),
need AS (SELECT label, n, max(n) OVER () - n AS need FROM cnt),
cls AS (SELECT e.*, need.n, need.need FROM emb e JOIN need ON e.label = need.label WHERE need.need > 0)"""
_ACC = " + ".join(f"(p.e{i} - b.e{i}) * (p.e{i} - b.e{i})" for i in range(X.N_EMB))


def _copies_sql(src: str, salt: str) -> str:
    return (f"dealt AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_hash('id', salt)}, id) AS rn, "
            f"count(*) OVER (PARTITION BY label) AS ns FROM {src}),\n"
            "copies AS (SELECT *, unnest(generate_series(0, CAST(floor(need / ns) + CASE WHEN rn <= need % ns "
            "THEN 1 ELSE 0 END AS BIGINT) - 1)) AS copy FROM dealt)")


def _interp_sql(k: int = 3) -> str:
    key = "id || '|' || CAST(copy AS VARCHAR)"
    return (f"knn AS (SELECT p.id AS pid, b.id AS bid, row_number() OVER (PARTITION BY p.id ORDER BY sqrt({_ACC}), b.id) "
            f"AS nr FROM cls p JOIN cls b ON p.label = b.label AND p.id <> b.id),\n"
            f"picks AS (SELECT *, 1 + floor({sql_uniform(key, 'nn')} * least({k}, n - 1)) AS pick, "
            f"{sql_uniform(key, 'gap')} AS gap FROM copies),\n"
            "syn AS (SELECT p.id || '#' || CAST(p.copy AS VARCHAR) AS id, p.label, " +
            ", ".join(f"p.e{i} + p.gap * (coalesce(b.e{i}, p.e{i}) - p.e{i}) AS e{i}" for i in range(X.N_EMB)) +
            " FROM picks p LEFT JOIN knn ON knn.pid = p.id AND knn.nr = p.pick LEFT JOIN emb b ON b.id = knn.bid)")


_OUT = (f"SELECT id, label, {_r(EMBF)}, false AS synthetic FROM emb UNION ALL "
        f"SELECT id, label, {_r(EMBF)}, true AS synthetic FROM syn")


def _ov_out(df):
    return rounded(df.select("id", "label", *EMBF, "synthetic"))


@register("oversample_random", X.with_ctes(["emb"], _OUT, [_NEED, _copies_sql("cls", "random"),
          "syn AS (SELECT id || '#' || CAST(copy AS VARCHAR) AS id, label, " + ", ".join(EMBF) + " FROM copies)"]))
def q_oversample_random(spark, sf):
    """O1: minority classes duplicated to the majority count."""
    return _ov_out(O.oversample_random(X.emb(spark, sf), X.EMB_SPEC, 42))


@register("smote", X.with_ctes(["emb"], _OUT, [_NEED, _copies_sql("cls", "smote"), _interp_sql(3)]), headline=True)
def q_smote(spark, sf):
    """O2: SMOTE (k = 3) on the 10 embedding classes."""
    return _ov_out(O.smote(X.emb(spark, sf), X.EMB_SPEC, 3, 42))


def _share_sql(m: int) -> str:
    return (f"nn_all AS (SELECT p.id AS pid, p.label AS plab, b.label AS blab, row_number() OVER (PARTITION BY p.id "
            f"ORDER BY sqrt({_ACC}), b.id) AS nr FROM cls p JOIN emb b ON p.id <> b.id),\n"
            f"share AS (SELECT pid, sum(CASE WHEN blab IS DISTINCT FROM plab THEN 1 ELSE 0 END) AS n_other, "
            f"count(*) AS n_nn FROM nn_all WHERE nr <= {m} GROUP BY pid)")


@register("borderline_smote", X.with_ctes(["emb"], _OUT, [
    _NEED, _share_sql(10),
    "seeds AS (SELECT * FROM cls WHERE id IN (SELECT pid FROM share WHERE n_other * 2 >= n_nn AND n_other < n_nn))",
    _copies_sql("seeds", "borderline"), _interp_sql(3)]))
def q_borderline(spark, sf):
    """Borderline-1 SMOTE (m = 10 neighbours decide the danger set)."""
    return _ov_out(O.borderline_smote(X.emb(spark, sf), X.EMB_SPEC, 3, 10, 42))


@register("adasyn", X.with_ctes(["emb"], _OUT, [
    _NEED, _share_sql(3),
    "tot AS (SELECT c.label, sum(coalesce(s.n_other, 0)) AS t FROM cls c LEFT JOIN share s ON c.id = s.pid "
    "GROUP BY c.label)",
    "cut AS (SELECT c.*, CAST(coalesce(s.n_other, 0) * c.need AS BIGINT) // CAST(tot.t AS BIGINT) AS whole, "
    "CAST(coalesce(s.n_other, 0) * c.need AS BIGINT) % CAST(tot.t AS BIGINT) AS rem "
    "FROM cls c LEFT JOIN share s ON c.id = s.pid JOIN tot ON c.label = tot.label WHERE tot.t > 0)",
    "dealt AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rem DESC, id) AS rk, "
    "need - sum(whole) OVER (PARTITION BY label) AS lft FROM cut)",
    "copies AS (SELECT * EXCLUDE (whole, rem, rk, lft), unnest(generate_series(0, CAST(whole + CASE WHEN rk <= lft THEN 1 "
    "ELSE 0 END AS BIGINT) - 1)) AS copy FROM dealt)",
    _interp_sql(3)]))
def q_adasyn(spark, sf):
    """ADASYN (k = 3): counts proportional to other-class neighbours."""
    return _ov_out(O.adasyn(X.emb(spark, sf), X.EMB_SPEC, 3, 42))


@register("kmeans_smote")
def q_kmeans_smote(spark, sf):
    """KMeans-SMOTE with 2 clusters (neighbours within cluster and class)."""
    return _ov_out(O.kmeans_smote(X.emb(spark, sf), X.EMB_SPEC, 3, 2, 42))


def _cluster_needs_sql() -> str:
    spread = " + ".join(f"coalesce(var_samp({f}), 0)" for f in EMBF)
    return X.with_ctes(["emb"], """
SELECT label, CAST(cluster AS BIGINT) AS cluster, n, CAST(floor(share) + CASE WHEN row_number() OVER (PARTITION BY label ORDER BY share - floor(share)
  DESC, cluster) <= need - sum(floor(share)) OVER (PARTITION BY label) THEN 1 ELSE 0 END AS BIGINT) AS need
FROM (SELECT *, need * exp(lw - top) / sum(exp(lw - top)) OVER (PARTITION BY label) AS share
      FROM (SELECT *, max(lw) OVER (PARTITION BY label) AS top FROM weighed) w) t""", [
        f"cl AS (SELECT label, CASE WHEN e0 > 0 THEN 1 ELSE 0 END AS cluster, count(*) AS n, {spread} AS v "
        "FROM emb GROUP BY 1, 2)",
        "sized AS (SELECT label, sum(n) AS c FROM cl GROUP BY label)",
        "lack AS (SELECT label, (SELECT max(c) FROM sized) - c AS need FROM sized)",
        "part AS (SELECT cl.*, lack.need, sum(n) OVER (PARTITION BY cluster) AS total, "
        "(SELECT sum(need) FROM lack) AS lacking FROM cl JOIN lack ON cl.label = lack.label)",
        "weighed AS (SELECT *, pow(ln(n) / ln(1.6), 1.8) * 0.16 * ln(greatest(sqrt(2 * v), 1e-300)) - ln(n) AS lw FROM part "
        "WHERE need > 0 AND n >= 2 AND n / total >= need / lacking / 2)"])


@register("kmeans_smote_shares", _cluster_needs_sql())
def q_kmeans_shares(spark, sf):
    """A class's lacking rows shared out over given clusters (the sign of one component)."""
    given = X.emb(spark, sf).withColumn("cluster", F.when(F.col("e0") > 0, 1).otherwise(0))
    return rounded(O.cluster_needs(given, X.EMB_SPEC, "cluster"))


@register("svm_smote")
def q_svm_smote(spark, sf):
    """Seeds from the support vectors of RBF machines; safe seeds extrapolate."""
    return _ov_out(O.svm_smote(X.emb(spark, sf), X.EMB_SPEC, 3, 5, 42))


# ------------------------------------------------------------------ categorical oversampling

_DNEED = """c0 AS (SELECT label, count(*) AS n FROM dcat GROUP BY label),
need AS (SELECT label, n, max(n) OVER () - n AS need FROM c0),
cls AS (SELECT x.*, need.n, need.need FROM dcat x JOIN need ON x.label = need.label WHERE need.need > 0)"""


def _mode_sql(col: str) -> str:
    return (f"m_{col} AS (SELECT pid, v FROM (SELECT k.pid, b.{col} AS v, row_number() OVER (PARTITION BY k.pid "
            f"ORDER BY count(*) DESC, b.{col}) AS r FROM knn k JOIN cls b ON b.id = k.bid GROUP BY k.pid, b.{col}) t "
            f"WHERE r = 1)")


_VDM = """pl AS (SELECT 'lang' AS f, lang AS v, label, count(*) AS cnt FROM dcat GROUP BY lang, label
           UNION ALL SELECT 'source', source, label, count(*) FROM dcat GROUP BY source, label),
pv AS (SELECT f, v, sum(cnt) AS nv FROM pl GROUP BY f, v),
labs AS (SELECT DISTINCT label FROM dcat),
pe AS (SELECT pv.f, pv.v, labs.label, coalesce(pl.cnt, 0) / pv.nv AS prob
       FROM pv CROSS JOIN labs LEFT JOIN pl ON pl.f = pv.f AND pl.v = pv.v AND pl.label = labs.label),
dl AS (SELECT a.f, a.v AS va, b.v AS vb, sum(abs(a.prob - b.prob)) AS d FROM pe a JOIN pe b
       ON a.f = b.f AND a.label = b.label GROUP BY a.f, a.v, b.v)"""

_SMOTEN_SQL = X.with_ctes(["dcat"], """
SELECT id, lang, source, label, false AS synthetic FROM dcat
UNION ALL SELECT id, lang, source, label, true FROM syn""", [
    _DNEED, _VDM, _copies_sql("cls", "smoten"),
    """knn AS (SELECT pid, bid FROM (SELECT p.id AS pid, b.id AS bid, row_number() OVER (PARTITION BY p.id
        ORDER BY sqrt(d1.d * d1.d + d2.d * d2.d), b.id) AS nr
      FROM cls p JOIN cls b ON p.label = b.label AND p.id <> b.id
      JOIN dl d1 ON d1.f = 'lang' AND d1.va = p.lang AND d1.vb = b.lang
      JOIN dl d2 ON d2.f = 'source' AND d2.va = p.source AND d2.vb = b.source) t WHERE nr <= 3)""",
    _mode_sql("lang"), _mode_sql("source"),
    """syn AS (SELECT c.id || '#' || CAST(c.copy AS VARCHAR) AS id, coalesce(ml.v, c.lang) AS lang,
        coalesce(ms.v, c.source) AS source, c.label
      FROM copies c LEFT JOIN m_lang ml ON ml.pid = c.id LEFT JOIN m_source ms ON ms.pid = c.id)"""])


@register("smoten", _SMOTEN_SQL)
def q_smoten(spark, sf):
    """O3: SMOTEN on the labelled documents' categorical features (lang, source)."""
    out = O.smoten(X.dcat(spark, sf), X.Spec("id", "label", ()), ["lang", "source"], 3, 42)
    return out.select("id", "lang", "source", "label", "synthetic")


_MIS = "(CASE WHEN p.{c} <> b.{c} THEN h.x ELSE 0 END)"
_SMOTENC_ACC = ("(p.n_chars - b.n_chars) * (p.n_chars - b.n_chars) + (p.n_words - b.n_words) * (p.n_words - b.n_words) + "
                + " + ".join([_MIS.format(c="lang")] * 2 + [_MIS.format(c="source")] * 2))
_SMOTENC_SQL = X.with_ctes(["dcat"], f"""
SELECT id, round(n_chars, 6) AS n_chars, round(n_words, 6) AS n_words, lang, source, label, false AS synthetic FROM dcat
UNION ALL SELECT id, round(n_chars, 6), round(n_words, 6), lang, source, label, true FROM syn""", [
    _DNEED,
    """sd AS (SELECT stddev_pop(n_chars) AS s0, stddev_pop(n_words) AS s1 FROM dcat),
h AS (SELECT ((least(s0, s1) + greatest(s0, s1)) / 2 / 2) * ((least(s0, s1) + greatest(s0, s1)) / 2 / 2) AS x FROM sd)""",
    _copies_sql("cls", "smotenc"),
    f"""knn AS (SELECT pid, bid, nr FROM (SELECT p.id AS pid, b.id AS bid, row_number() OVER (PARTITION BY p.id
        ORDER BY sqrt({_SMOTENC_ACC}), b.id) AS nr FROM cls p JOIN cls b ON p.label = b.label AND p.id <> b.id, h) t
      WHERE nr <= 3)""",
    _mode_sql("lang"), _mode_sql("source"),
    f"""picks AS (SELECT *, 1 + floor({sql_uniform("id || '|' || CAST(copy AS VARCHAR)", 'nn')} * least(3, n - 1)) AS pick,
        {sql_uniform("id || '|' || CAST(copy AS VARCHAR)", 'gap')} AS gap FROM copies)""",
    """syn AS (SELECT p.id || '#' || CAST(p.copy AS VARCHAR) AS id,
        p.n_chars + p.gap * (coalesce(b.n_chars, p.n_chars) - p.n_chars) AS n_chars,
        p.n_words + p.gap * (coalesce(b.n_words, p.n_words) - p.n_words) AS n_words,
        coalesce(ml.v, p.lang) AS lang, coalesce(ms.v, p.source) AS source, p.label
      FROM picks p LEFT JOIN knn ON knn.pid = p.id AND knn.nr = p.pick LEFT JOIN dcat b ON b.id = knn.bid
      LEFT JOIN m_lang ml ON ml.pid = p.id LEFT JOIN m_source ms ON ms.pid = p.id)"""])


@register("smotenc", _SMOTENC_SQL)
def q_smotenc(spark, sf):
    """SMOTENC on documents — numeric n_chars, n_words interpolated; lang, source by
    neighbour mode."""
    out = O.smotenc(X.dcat(spark, sf), X.Spec("id", "label", ("n_chars", "n_words")), ["lang", "source"], 3, 42)
    return rounded(out.select("id", "n_chars", "n_words", "lang", "source", "label", "synthetic"))
