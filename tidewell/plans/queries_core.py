"""Registered queries: assembly, filters, statistics, joins, edits (S1, P*, J*, G*, W*, U*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.columns import sql_list
from tidewell.operators import assemble as A
from tidewell.operators import edit as U
from tidewell.operators import reduce as W
from tidewell.operators import stats as G
from tidewell.plans import fixtures as X
from tidewell.plans.registry import register, rounded, rsel

EPH, MOR = list(X.EPHYS_FEATURES), list(X.MORPH_FEATURES)

# ------------------------------------------------------------------ assembly


def _assembled(spark, sf, **kw):
    return A.assemble(X.meta(spark, sf), X.ephys(spark, sf), X.morph(spark, sf),
                      ambiguous=X.CUST_AMBIGUOUS, superficial=X.CUST_SUPERFICIAL,
                      deep=X.CUST_DEEP, **kw)


def labelled_both(spark, sf):
    return _assembled(spark, sf, taxonomy="Berg", modality="Both", subset="All")[0]


_AMB = sql_list(X.CUST_AMBIGUOUS)
_META_L = f"""meta_l AS (
  SELECT id, L23_depth_normalized,
         CASE WHEN SeuratMapping IN {_AMB} AND Is_deep_FREM3 THEN SeuratMapping || ' deep'
              WHEN SeuratMapping IN {_AMB} AND NOT Is_deep_FREM3 THEN SeuratMapping || ' superficial'
              ELSE SeuratMapping END AS label,
         SEA_AD
  FROM meta)"""
_MORPH_F = """morph_f AS (
  SELECT m.id, m.n_lines, m.avg_qty, m.avg_disc,
         coalesce(m.L23_depth_normalized, mt.L23_depth_normalized) AS L23_depth_normalized
  FROM morph m LEFT JOIN meta mt ON m.id = mt.id)"""
_BOTH = """both_l AS (
  SELECT e.id, e.n_orders, e.total_price, e.avg_price, e.max_price, e.n_urgent,
         f.n_lines, f.avg_qty, f.avg_disc, f.L23_depth_normalized, ml.label
  FROM ephys e JOIN morph_f f ON e.id = f.id JOIN meta_l ml ON e.id = ml.id)"""
_ASM = ["meta", "ephys", "morph"]


@register("assemble_labelled", X.with_ctes(_ASM, rsel(EPH + MOR, ["id", "label"],
          "both_l WHERE label IS DISTINCT FROM 'UNKNOWN'"), [_META_L, _MORPH_F, _BOTH]), headline=True)
def q_assemble_labelled(spark, sf):
    """J7 (Berg, Both, All): labelled rows."""
    return rounded(labelled_both(spark, sf))


@register("assemble_unlabelled", X.with_ctes(_ASM, rsel(EPH + MOR, ["id"],
          "both_l WHERE label = 'UNKNOWN'") .replace('SELECT "id"', 'SELECT "id", CAST(NULL AS VARCHAR) AS label'),
          [_META_L, _MORPH_F, _BOTH]))
def q_assemble_unlabelled(spark, sf):
    """The unlabelled side, label NULL."""
    return rounded(_assembled(spark, sf, taxonomy="Berg", modality="Both", subset="All")[1])


@register("assemble_ephys_depth_superficial", X.with_ctes(_ASM, rsel(EPH + ["L23_depth_normalized"], ["id", "label"],
          f"""(SELECT e.*, ml.L23_depth_normalized, ml.label FROM ephys e JOIN meta_l ml ON e.id = ml.id) t
              WHERE label IS DISTINCT FROM 'UNKNOWN' AND label IN {sql_list(X.CUST_SUPERFICIAL)}"""), [_META_L]))
def q_assemble_ephys_depth(spark, sf):
    """J3 + P5: Ephys with the meta depth as a feature, Superficial classes."""
    lab, _ = _assembled(spark, sf, taxonomy="Berg", modality="Ephys", subset="Superficial", with_depth=True)
    return rounded(lab)


@register("assemble_morph_sea_ad_deep", X.with_ctes(_ASM, rsel(MOR, ["id", "label"],
          """(SELECT f.*, ml.SEA_AD AS label FROM morph_f f JOIN meta_l ml ON f.id = ml.id) t
              WHERE label IS DISTINCT FROM 'UNKNOWN'"""), [_META_L, _MORPH_F]))
def q_assemble_morph_sea_ad(spark, sf):
    """P3 (SEA_AD taxonomy) on Morph, All subset; J4 fills depth from meta."""
    return rounded(_assembled(spark, sf, taxonomy="SEA_AD", modality="Morph", subset="All")[0])


@register("assemble_deep_mouse", X.with_ctes(_ASM, rsel(EPH + MOR, ["id", "label"],
          f"""(SELECT b.id, b.n_orders, b.total_price, b.avg_price, b.max_price, b.n_urgent, b.n_lines,
                      b.avg_qty, b.avg_disc, b.L23_depth_normalized, mt.SeuratMapping AS label
               FROM both_l b JOIN meta mt ON b.id = mt.id) t
              WHERE label IS DISTINCT FROM 'UNKNOWN' AND label IN {sql_list(X.CUST_DEEP + ['HOUSEHOLD'])}"""),
          [_META_L, _MORPH_F, _BOTH]))
def q_assemble_deep_mouse(spark, sf):
    """P3 (Mouse: class unchanged) + P5 Deep subset."""
    return rounded(_assembled(spark, sf, taxonomy="Mouse", modality="Both", subset="Deep")[0])


@register("fill_from_depth", X.with_ctes(["meta", "morph"], rsel(MOR, ["id"], "morph_f"), [_MORPH_F]))
def q_fill_from(spark, sf):
    """NULL depth of the morph table filled from meta by key."""
    return rounded(A.fill_from(X.morph(spark, sf), X.meta(spark, sf), "L23_depth_normalized"))


@register("key_in_meta", X.with_ctes(["meta", "morph"],
          "SELECT id, SeuratMapping FROM meta WHERE id IN (SELECT id FROM morph)"))
def q_key_in(spark, sf):
    """Meta rows whose key has morph features (semi join)."""
    return A.key_in(X.meta(spark, sf).select("id", "SeuratMapping"), X.morph(spark, sf))


@register("rename_features", "SELECT c_custkey AS InputR, c_acctbal AS input_resistance_copy FROM customer")
def q_rename(spark, sf):
    """A feature named like a short name is renamed by the fixed map (InputR→input_resistance)."""
    cu = X.read(spark, sf, "customer").select(F.col("c_custkey").alias("InputR"),
                                               F.col("c_acctbal").alias("input_resistance_copy"))
    out = A.rename_features(cu)
    # the renamed feature is compared under its original name through an alias
    return out.select(F.col("input_resistance").alias("InputR"), "input_resistance_copy")


# ------------------------------------------------------------------ classes and filters

_LI = ["li"]


@register("class_counts", X.with_ctes(_LI, "SELECT label, count(*) AS n FROM li GROUP BY label"), headline=True)
def q_class_counts(spark, sf):
    """G1 on lineitem classes."""
    return G.class_counts(X.li(spark, sf))


@register("class_shares", X.with_ctes(_ASM, "SELECT label, n, round(n / sum(n) OVER (), 6) AS share FROM "
          "(SELECT label, count(*) AS n FROM both_l WHERE label IS DISTINCT FROM 'UNKNOWN' GROUP BY label) t",
          [_META_L, _MORPH_F, _BOTH]))
def q_class_shares(spark, sf):
    """G2 over the assembled labelled table."""
    return rounded(G.class_shares(labelled_both(spark, sf)))


_MINCLASS = """mc AS (SELECT * FROM li WHERE label IN
  (SELECT label FROM li WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 5))"""


@register("filter_min_class", X.with_ctes(_LI, rsel(X.LI_FEATURES, ["id", "label"], "mc"), [_MINCLASS]), headline=True)
def q_filter_min_class(spark, sf):
    """The 3-row class RARE is dropped."""
    return rounded(G.filter_min_class(X.li(spark, sf), "label", 5))


_NULLSHARE = """ns AS (SELECT * FROM mc WHERE
  (CAST(quantity IS NULL AS INT) + CAST(price IS NULL AS INT) + CAST(discount IS NULL AS INT)
   + CAST(tax IS NULL AS INT) + CAST(label IS NULL AS INT)) <= 0.2 * 5)"""


@register("filter_rows", X.with_ctes(_LI, rsel(X.LI_FEATURES, ["id", "label"], "ns"), [_MINCLASS, _NULLSHARE]),
          headline=True)
def q_filter_rows(spark, sf):
    """G3 → P6 (the minimum slice): class filter, then NULL share ≤ 0.2 of 5 columns."""
    return rounded(G.filter_null_share(G.filter_min_class(X.li(spark, sf)), "id", 0.2))


@register("filter_shares", X.with_ctes(_LI, "SELECT label, n, round(n / sum(n) OVER (), 6) AS share FROM "
          "(SELECT label, count(*) AS n FROM ns GROUP BY label) t", [_MINCLASS, _NULLSHARE]))
def q_filter_shares(spark, sf):
    """assemble-free minimum slice end to end: filters → class shares."""
    return rounded(G.class_shares(G.filter_null_share(G.filter_min_class(X.li(spark, sf)), "id", 0.2)))


@register("distinct_labels", X.with_ctes(_LI, "SELECT DISTINCT label FROM li"))
def q_distinct(spark, sf):
    """G17."""
    return G.distinct_values(X.li(spark, sf), "label")


@register("shape_li", X.with_ctes(_LI, "SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_cols FROM li"))
def q_shape(spark, sf):
    """G4."""
    return G.shape(X.li(spark, sf))


@register("schema_info_li", X.with_ctes(_LI, " UNION ALL ".join(
    f"SELECT '{n}' AS feature, '{t}' AS dtype, count({n}) AS non_null FROM li"
    for n, t in [("id", "string"), ("quantity", "double"), ("price", "double"),
                 ("discount", "double"), ("tax", "double"), ("label", "string")])))
def q_schema_info(spark, sf):
    """Type and non-NULL count per column."""
    return G.schema_info(X.li(spark, sf))


def _long_sql(src: str, cols, keep=()) -> str:
    k = "".join(f"{x}, " for x in keep)
    return " UNION ALL ".join(
        f"SELECT {k}'{x}' AS feature, CAST({x} AS DOUBLE) AS value FROM {src} WHERE {x} IS NOT NULL" for x in cols)


_DESC_SQL = X.with_ctes(_LI, f"""SELECT feature, count(value) AS count, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
  round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max
FROM ({_long_sql('li', X.LI_FEATURES)}) t GROUP BY feature""")


@register("describe_numeric", _DESC_SQL, headline=True)
def q_describe(spark, sf):
    """G6 with exact interpolated quartiles (range-partitioned rank)."""
    return rounded(G.describe_numeric(X.li(spark, sf), list(X.LI_FEATURES)))


@register("medians", X.with_ctes(_LI, f"SELECT feature, round(quantile_cont(value, 0.5), 6) AS median FROM "
          f"({_long_sql('li', X.LI_FEATURES)}) t GROUP BY feature"))
def q_medians(spark, sf):
    """G8."""
    return rounded(G.medians(X.li(spark, sf), list(X.LI_FEATURES)))


@register("describe_categorical", X.with_ctes(["meta"], """
SELECT feature, CAST(sum(cnt) AS BIGINT) AS count, count(*) AS n_distinct,
       min(CASE WHEN rk = 1 THEN value END) AS mode, max(cnt) AS freq
FROM (SELECT feature, value, cnt, row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, value) AS rk
      FROM (SELECT feature, value, count(*) AS cnt FROM (
              SELECT 'SeuratMapping' AS feature, SeuratMapping AS value FROM meta
              UNION ALL SELECT 'SEA_AD', SEA_AD FROM meta
              UNION ALL SELECT 'Is_deep_FREM3', CASE WHEN Is_deep_FREM3 THEN 'true' ELSE 'false' END FROM meta) u
            WHERE value IS NOT NULL GROUP BY feature, value) v) w
GROUP BY feature"""))
def q_describe_cat(spark, sf):
    """G7 over the meta table's categorical columns."""
    return G.describe_categorical(X.meta(spark, sf), ["SeuratMapping", "SEA_AD", "Is_deep_FREM3"])


@register("profile_meta", X.with_ctes(["meta"], f"""
SELECT s.feature, s.dtype, n.count, n.mean, n.std, n.min, n.p25, n.p50, n.p75, n.max,
       c.count_cat, c.n_distinct, c.mode, c.freq
FROM (VALUES ('SeuratMapping', 'string'), ('Is_deep_FREM3', 'boolean'), ('SEA_AD', 'string'),
             ('L23_depth_normalized', 'double')) s(feature, dtype)
LEFT JOIN (SELECT feature, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
                  round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25,
                  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
                  round(max(value), 6) AS max
           FROM ({_long_sql('meta', ['L23_depth_normalized'])}) t GROUP BY feature) n ON s.feature = n.feature
LEFT JOIN (SELECT feature, CAST(sum(cnt) AS BIGINT) AS count_cat, count(*) AS n_distinct,
                  min(CASE WHEN rk = 1 THEN value END) AS mode, max(cnt) AS freq
           FROM (SELECT feature, value, cnt, row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, value) AS rk
                 FROM (SELECT feature, value, count(*) AS cnt FROM (
                        SELECT 'SeuratMapping' AS feature, SeuratMapping AS value FROM meta
                        UNION ALL SELECT 'SEA_AD', SEA_AD FROM meta
                        UNION ALL SELECT 'Is_deep_FREM3', CASE WHEN Is_deep_FREM3 THEN 'true' ELSE 'false' END FROM meta) u
                       WHERE value IS NOT NULL GROUP BY feature, value) v) w
           GROUP BY feature) c ON s.feature = c.feature"""))
def q_profile(spark, sf):
    """Numeric and categorical summaries stacked per feature (key excluded)."""
    return rounded(G.profile(X.meta(spark, sf), exclude=["id"]))


@register("boxplot_stats", X.with_ctes(_LI, f"""
WITH_Q AS (SELECT 1)
SELECT t.feature, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3,
       round(min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END), 6) AS whisker_low,
       round(max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END), 6) AS whisker_high,
       CAST(sum(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
       round(q.q3 - q.q1, 6) AS iqr
FROM ({_long_sql('li', X.LI_FEATURES)}) t
JOIN (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM ({_long_sql('li', X.LI_FEATURES)}) u GROUP BY feature) q
  ON t.feature = q.feature
GROUP BY t.feature, q.q1, q.median, q.q3""".replace("WITH_Q AS (SELECT 1)\n", "")))
def q_boxplot(spark, sf):
    """G11."""
    return rounded(G.boxplot_stats(X.li(spark, sf), list(X.LI_FEATURES)))


@register("histogram_price", X.with_ctes(_LI, """
SELECT CAST(b.bin AS BIGINT) AS bin, round(m.mn + b.bin * (m.mx - m.mn) / 10, 6) AS lo,
       round(m.mn + (b.bin + 1) * (m.mx - m.mn) / 10, 6) AS hi, count(li.price) AS n
FROM range(10) b(bin)
CROSS JOIN (SELECT min(price) AS mn, max(price) AS mx FROM li) m
LEFT JOIN li ON li.price IS NOT NULL
  AND least(floor((li.price - m.mn) / ((m.mx - m.mn) / 10)), 9) = b.bin
GROUP BY b.bin, m.mn, m.mx"""))
def q_histogram(spark, sf):
    """10 equal-width bins of the price column."""
    return rounded(G.histogram(X.li(spark, sf), "price", 10))


@register("corr_matrix", X.with_ctes(["emb"], " UNION ALL ".join(
    f"SELECT 'e{a}' AS col_a, 'e{b}' AS col_b, round(corr(e{a}, e{b}), 6) AS corr FROM emb"
    for a in range(X.N_EMB) for b in range(X.N_EMB))))
def q_corr(spark, sf):
    """G13 over all embedding components."""
    return rounded(G.corr_matrix(X.emb(spark, sf), list(X.EMB_FEATURES)))


@register("centroids", X.with_ctes(["emb"], "SELECT label, " + ", ".join(
    f"round(avg(e{i}), 6) AS e{i}" for i in range(X.N_EMB)) + " FROM emb GROUP BY label"))
def q_centroids(spark, sf):
    """G14 per class over all embedding components."""
    return rounded(G.centroids(X.emb(spark, sf), X.EMB_SPEC))


_DIST_SQL = X.with_ctes(["emb"], "SELECT e.id, e.label, round(sqrt(" + " + ".join(
    f"coalesce(pow(abs(e.e{i} - c.e{i}), 2), 0)" for i in range(X.N_EMB)) + "), 6) AS distance "
    "FROM emb e JOIN (SELECT label, " + ", ".join(f"avg(e{i}) AS e{i}" for i in range(X.N_EMB)) +
    " FROM emb GROUP BY label) c ON e.label = c.label")


@register("distance_to_centroid", _DIST_SQL)
def q_distance(spark, sf):
    """G15 (p = 2)."""
    return rounded(G.distance_to_centroid(X.emb(spark, sf), X.EMB_SPEC, 2.0).select("id", "label", "distance"))


@register("distance_manhattan", X.with_ctes(["emb"], "SELECT e.id, e.label, round(" + " + ".join(
    f"abs(e.e{i} - c.e{i})" for i in range(X.N_EMB)) + ", 6) AS distance FROM emb e JOIN (SELECT label, " + ", ".join(
    f"avg(e{i}) AS e{i}" for i in range(X.N_EMB)) + " FROM emb GROUP BY label) c ON e.label = c.label"))
def q_distance_l1(spark, sf):
    """G15 (p = 1)."""
    return rounded(G.distance_to_centroid(X.emb(spark, sf), X.EMB_SPEC, 1.0).select("id", "label", "distance"))


@register("row_max", X.with_ctes(["emb"], f"SELECT id, round(greatest({', '.join(X.EMB_FEATURES)}), 6) AS p_max FROM emb"))
def q_row_max(spark, sf):
    """The largest of all components."""
    return rounded(G.with_row_max(X.emb(spark, sf), list(X.EMB_FEATURES)).select("id", "p_max"))


@register("extremes_li", X.with_ctes(_LI, """
SELECT id,
  coalesce(price = (SELECT max(price) FROM li), false) AS price__is_max,
  coalesce(price = (SELECT min(price) FROM li), false) AS price__is_min,
  price IS NULL AS price__is_null,
  coalesce(quantity = (SELECT max(quantity) FROM li), false) AS quantity__is_max,
  coalesce(quantity = (SELECT min(quantity) FROM li), false) AS quantity__is_min,
  quantity IS NULL AS quantity__is_null
FROM li"""))
def q_extremes(spark, sf):
    """Flag max, min and NULL cells."""
    out = G.extremes(X.li(spark, sf), ["price", "quantity"])
    return out.select("id", "price__is_max", "price__is_min", "price__is_null",
                      "quantity__is_max", "quantity__is_min", "quantity__is_null")


@register("infer_problem_type", X.with_ctes(_LI, "SELECT count(DISTINCT label) AS n_classes, "
          "CASE WHEN count(DISTINCT label) = 2 THEN 'binary' ELSE 'multiclass' END AS problem_type FROM li"))
def q_problem_type(spark, sf):
    """E12."""
    return G.infer_problem_type(X.li(spark, sf))


@register("select_numeric_meta", X.with_ctes(["meta"], "SELECT round(L23_depth_normalized, 6) AS L23_depth_normalized "
          "FROM meta"))
def q_select_numeric(spark, sf):
    """Numeric columns of the meta table."""
    return rounded(G.select_by_type(X.meta(spark, sf), "numeric"))


# ------------------------------------------------------------------ reduction, ranking, edits


_EMBF = list(X.EMB_FEATURES)
_RANKED = ("ranked AS (SELECT e.*, row_number() OVER (PARTITION BY e.label ORDER BY sqrt(" + " + ".join(
    f"coalesce(pow(abs(e.e{i} - c.e{i}), 2), 0)" for i in range(X.N_EMB)) + "), e.id) AS rn, "
    "count(*) OVER (PARTITION BY e.label) AS n, round_even(count(*) OVER (PARTITION BY e.label) * 0.8, 0) AS m "
    "FROM emb e JOIN (SELECT label, " + ", ".join(f"avg(e{i}) AS e{i}" for i in range(X.N_EMB)) +
    " FROM emb GROUP BY label) c ON e.label = c.label)")
_EMB_OUT = "SELECT id, label, " + ", ".join(f"round(e{i}, 6) AS e{i}" for i in range(X.N_EMB)) + " FROM ranked WHERE "


def _reduced(method):
    def run(spark, sf):
        return rounded(W.reduce_per_class(X.emb(spark, sf), X.EMB_SPEC, 0.8, method).select("id", "label", *_EMBF))
    return run


register("reduce_first", X.with_ctes(["emb"], _EMB_OUT + "rn <= m", [_RANKED]), headline=True)(_reduced("first"))
register("reduce_last", X.with_ctes(["emb"], _EMB_OUT + "rn > n - m", [_RANKED]))(_reduced("last"))
register("reduce_proportion", X.with_ctes(["emb"], _EMB_OUT +
         "(n = m OR (rn - 1) % round_even(n / (n - m), 0) <> 0)", [_RANKED]))(_reduced("proportion"))

_PMAX = "pm AS (SELECT *, greatest(p_A, p_N, p_R) AS p_max FROM pw)"


@register("quantile_cut", X.with_ctes(["pw"], """SELECT id, label, round(p_max, 6) AS p_max FROM pm
WHERE p_max >= (SELECT quantile_cont(p_max, 0.75) FROM pm)""", [_PMAX]))
def q_quantile_cut(spark, sf):
    """Rows whose top probability reaches the 75 % point of all row maxima."""
    out = W.quantile_cut(X.probs_wide(spark, sf), ["p_A", "p_N", "p_R"], "75%")
    return rounded(out.select("id", "label", "p_max"))


@register("quantile_cut_mean", X.with_ctes(["pw"], """SELECT id, label, round(p_max, 6) AS p_max FROM pm
WHERE p_max >= (SELECT avg(p_max) FROM pm)""", [_PMAX]))
def q_quantile_cut_mean(spark, sf):
    """W7 with the 'mean' statistic."""
    out = W.quantile_cut(X.probs_wide(spark, sf), ["p_A", "p_N", "p_R"], "mean")
    return rounded(out.select("id", "label", "p_max"))


@register("in_band", X.with_ctes(["pw"], """SELECT id, label, round(p_max, 6) AS p_max FROM pm
WHERE p_max BETWEEN (SELECT quantile_cont(p_max, 0.25) FROM pm) AND (SELECT quantile_cont(p_max, 0.75) FROM pm)""",
          [_PMAX]))
def q_in_band(spark, sf):
    """Row maxima between their 25 % and 75 % points."""
    pm = G.with_row_max(X.probs_wide(spark, sf), ["p_A", "p_N", "p_R"])
    return rounded(W.in_band(pm, "p_max", 0.25, 0.75).select("id", "label", "p_max"))


@register("append_rows", X.with_ctes(["ephys", "morph"],
          "SELECT id, " + ", ".join(f"round({x}, 6) AS {x}" for x in EPH + MOR) +
          " FROM (SELECT * FROM ephys UNION ALL BY NAME SELECT * FROM morph) t"))
def q_append(spark, sf):
    """The two modality tables stacked by name (missing columns NULL)."""
    return rounded(U.append_rows(X.ephys(spark, sf), X.morph(spark, sf)))


@register("union_keep", X.with_ctes(["emb"], "SELECT id, label, " + ", ".join(f"round(e{i}, 6) AS e{i}" for i in range(X.N_EMB)) +
          " FROM (SELECT * FROM emb WHERE e0 > 0 UNION ALL SELECT * FROM emb WHERE label IN ('1', '2')) t"))
def q_union_keep(spark, sf):
    """Confident rows (e0 > 0) plus all rows of classes 1 and 2, duplicates kept."""
    e = X.emb(spark, sf)
    return rounded(U.union_keep(e.filter(F.col("e0") > 0), e, ["1", "2"]))


@register("apply_changes", """
WITH cu AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, c_acctbal, c_mktsegment, c_custkey FROM customer)
SELECT id, c_name, round(CASE WHEN c_custkey % 50 = 1 THEN 0.0 ELSE c_acctbal END, 6) AS c_acctbal,
       CASE WHEN c_custkey % 50 = 1 THEN 'EDITED' ELSE c_mktsegment END AS c_mktsegment
FROM cu WHERE c_custkey % 50 <> 2
UNION ALL
SELECT 'S' || CAST(s_suppkey AS VARCHAR), s_name, round(CAST(CAST(s_acctbal AS VARCHAR) AS DOUBLE), 6), NULL FROM supplier""")
def q_apply_changes(spark, sf):
    """A change set (edits, deletes, additions) applied to the customer table."""
    return rounded(U.apply_changes(X.cust_table(spark, sf), X.cust_changes(spark, sf)))


@register("align_columns", X.with_ctes(["ephys", "morph"],
          "SELECT coalesce(e.id, m.id) AS id, " + ", ".join(f"round(e.{x}, 6) AS {x}" for x in EPH) + ", " +
          ", ".join(f"round(m.{x}, 6) AS {x}" for x in MOR) + " FROM ephys e FULL OUTER JOIN morph m ON e.id = m.id"))
def q_align(spark, sf):
    """Column-wise alignment of two keyed tables (full outer join)."""
    return rounded(U.align_columns(X.ephys(spark, sf), X.morph(spark, sf)))


@register("select_columns", X.with_ctes(["li"], "SELECT id, round(price, 6) AS price, round(tax, 6) AS tax, label FROM li"))
def q_select_columns(spark, sf):
    """Key, two chosen features, label."""
    return rounded(U.select_columns(X.li(spark, sf), ["price", "tax"]))


@register("select_rows", X.with_ctes(["ephys", "morph"], rsel(["n_orders", "avg_price"], ["id"], "ephys") + " WHERE id IN (SELECT id FROM morph)"))
def q_select_rows(spark, sf):
    """P10: the order aggregates of the customers that have line aggregates."""
    return rounded(U.select_rows(X.ephys(spark, sf), X.morph(spark, sf), ["n_orders", "avg_price"]))


def _board(spark, sf):
    """A leaderboard of given scores: one model per line number and half of the parts."""
    l = X.read(spark, sf, "lineitem")
    name = F.concat(F.lit("M"), F.col("l_linenumber").cast("string"), F.when(F.col("l_partkey") % 2 == 0, "_DSTL").otherwise(""))
    return l.groupBy(name.alias("model")).agg(F.round(F.avg("l_discount"), 4).alias("score_test"), F.round(F.avg("l_tax"), 4).alias("score_val"))


_BOARD_SQL = """board AS (
  SELECT 'M' || CAST(l_linenumber AS VARCHAR) || CASE WHEN l_partkey % 2 = 0 THEN '_DSTL' ELSE '' END AS model,
         round(avg(l_discount), 4) AS score_test, round(avg(l_tax), 4) AS score_val
  FROM lineitem GROUP BY ALL)"""


@register("name_contains", X.with_ctes([], "WITH " + _BOARD_SQL + " SELECT model, score_test, score_val FROM board WHERE contains(model, 'DSTL')"))
def q_name_contains(spark, sf):
    """The models whose name contains a text."""
    return W.name_contains(_board(spark, sf), "DSTL")


@register("rank_models", "WITH " + _BOARD_SQL + """ SELECT model, score_test, score_val FROM board
ORDER BY score_test DESC, score_val DESC, model LIMIT 3""")
def q_rank_models(spark, sf):
    """The three best models by test and validation score (a top-k report)."""
    return W.rank_models(_board(spark, sf)).limit(3)


@register("best_student", "WITH " + _BOARD_SQL + """ SELECT model, score_test, score_val FROM board WHERE contains(model, 'DSTL')
ORDER BY score_test DESC, score_val DESC, model LIMIT 1""")
def q_best_student(spark, sf):
    """The best distilled model."""
    return W.best_student(_board(spark, sf))
