"""Keyed feature tables derived from the driver's tables, in Spark and as DuckDB SQL text.

The two derivations are written to give identical values: integer keys become
STRING ids, NULLs are injected by a CASE on the key, sums are rounded at
the source so summation order cannot leak into later steps.

| table | from | label | features |
| --- | --- | --- | --- |
| ``li`` | lineitem, one row per line | l_returnflag, plus a 3-row class 'RARE' | quantity, price, discount, tax (three with NULLs) |
| ``meta`` | customer | c_mktsegment, 'UNKNOWN' for every 5th key | flag, alternative label, depth |
| ``ephys`` | orders per customer | – | five order aggregates |
| ``morph`` | lineitem ⋈ orders per customer, 9 of 10 customers | – | four line aggregates incl. depth with NULLs |
| ``emb`` | embeddings | label as text | e0..e63 (all components) |
| ``docs`` | documents ⟕ labels | quality as text or 'UNKNOWN' | n_chars, n_words |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.spec import Spec

LI_FEATURES = ("quantity", "price", "discount", "tax")
EPHYS_FEATURES = ("n_orders", "total_price", "avg_price", "max_price", "n_urgent")
MORPH_FEATURES = ("n_lines", "avg_qty", "avg_disc", "L23_depth_normalized")
#: components of an embedding
N_EMB = 64
EMB_FEATURES = tuple(f"e{i}" for i in range(N_EMB))
DOC_FEATURES = ("n_chars", "n_words")

# class vocabulary of the customer mapping (ambiguous class split by the flag)
CUST_AMBIGUOUS = ["BUILDING"]
CUST_SUPERFICIAL = ["AUTOMOBILE", "BUILDING superficial", "FURNITURE"]
CUST_DEEP = ["BUILDING deep", "HOUSEHOLD", "MACHINERY"]

LI_SPEC = Spec("id", "label", LI_FEATURES)
EMB_SPEC = Spec("id", "label", EMB_FEATURES)
DOC_SPEC = Spec("id", "label", DOC_FEATURES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id_col():
    """Line key: order, part, supplier, line number and ship day (unique at every scale)."""
    s = lambda x: F.col(x).cast("string")
    return F.concat_ws("|", s("l_orderkey"), s("l_partkey"), s("l_suppkey"), s("l_linenumber"),
                       F.date_format("l_shipdate", "yyyyMMdd")).alias("id")


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    return l.select(
        _id_col(),
        F.when(F.col("l_partkey") % 7 == 3, None).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_suppkey") % 11 == 5, None).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_orderkey") % 13 == 4, None).otherwise(F.col("l_discount")).alias("discount"),
        F.col("l_tax").alias("tax"),
        F.when(F.col("l_orderkey") == 0, "RARE").otherwise(F.col("l_returnflag")).alias("label"),
    )


LI_SQL = """li AS (
  SELECT concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR),
                   CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), strftime(l_shipdate, '%Y%m%d')) AS id,
         CASE WHEN l_partkey % 7 = 3 THEN NULL ELSE l_quantity END AS quantity,
         CASE WHEN l_suppkey % 11 = 5 THEN NULL ELSE l_extendedprice END AS price,
         CASE WHEN l_orderkey % 13 = 4 THEN NULL ELSE l_discount END AS discount,
         l_tax AS tax,
         CASE WHEN l_orderkey = 0 THEN 'RARE' ELSE l_returnflag END AS label
  FROM lineitem)"""


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = read(spark, sf_dir, "customer")
    unknown = F.col("c_custkey") % 5 == 0
    return cu.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.when(unknown, "UNKNOWN").otherwise(F.col("c_mktsegment")).alias("SeuratMapping"),
        (F.col("c_acctbal") > 0).alias("Is_deep_FREM3"),
        F.when(unknown, "UNKNOWN").otherwise(
            F.concat(F.lit("N"), (F.col("c_nationkey") % 4).cast("string"))).alias("SEA_AD"),
        (F.col("c_acctbal") / 10000).alias("L23_depth_normalized"),
    )


META_SQL = """meta AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id,
         CASE WHEN c_custkey % 5 = 0 THEN 'UNKNOWN' ELSE c_mktsegment END AS SeuratMapping,
         c_acctbal > 0 AS Is_deep_FREM3,
         CASE WHEN c_custkey % 5 = 0 THEN 'UNKNOWN' ELSE 'N' || CAST(c_nationkey % 4 AS VARCHAR) END AS SEA_AD,
         c_acctbal / 10000 AS L23_depth_normalized
  FROM customer)"""


def ephys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.round(F.sum("o_totalprice"), 2).alias("total_price"),
        (F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1))).alias("avg_price"),
        F.max("o_totalprice").alias("max_price"),
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).cast("double").alias("n_urgent"),
    )


EPHYS_SQL = """ephys AS (
  SELECT CAST(o_custkey AS VARCHAR) AS id,
         CAST(count(*) AS DOUBLE) AS n_orders,
         round(sum(o_totalprice), 2) AS total_price,
         round(sum(o_totalprice), 2) / count(*) AS avg_price,
         max(o_totalprice) AS max_price,
         CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS DOUBLE) AS n_urgent
  FROM orders GROUP BY o_custkey)"""


def morph(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").filter(F.col("o_custkey") % 10 != 0)
    j = l.join(o, l.l_orderkey == o.o_orderkey)
    agg = j.groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        (F.round(F.sum("l_quantity"), 2) / F.count(F.lit(1))).alias("avg_qty"),
        (F.round(F.sum("l_discount"), 2) / F.count(F.lit(1))).alias("avg_disc"),
        (F.round(F.sum("l_tax"), 2) / F.count(F.lit(1))).alias("__tax"))
    return agg.select(
        F.col("o_custkey").cast("string").alias("id"), "n_lines", "avg_qty", "avg_disc",
        F.when(F.col("o_custkey") % 7 == 3, None).otherwise(F.col("__tax")).alias("L23_depth_normalized"))


MORPH_SQL = """morph AS (
  SELECT CAST(o_custkey AS VARCHAR) AS id,
         CAST(count(*) AS DOUBLE) AS n_lines,
         round(sum(l_quantity), 2) / count(*) AS avg_qty,
         round(sum(l_discount), 2) / count(*) AS avg_disc,
         CASE WHEN o_custkey % 7 = 3 THEN NULL ELSE round(sum(l_tax), 2) / count(*) END AS L23_depth_normalized
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_custkey % 10 <> 0
  GROUP BY o_custkey)"""


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(N_EMB)],
                    F.col("label").cast("string").alias("label"))


EMB_SQL = "emb AS (\n  SELECT CAST(vec_id AS VARCHAR) AS id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(N_EMB)) + \
    ", CAST(label AS VARCHAR) AS label\n  FROM embeddings)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    lb = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lb, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(F.col("text"), " ")).cast("double").alias("n_words"),
        F.when(F.col("quality").isNull(), "UNKNOWN").otherwise(F.col("quality").cast("string")).alias("label"))


DOCS_SQL = """docs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id,
         CAST(d.n_chars AS DOUBLE) AS n_chars,
         CAST(len(string_split(d.text, ' ')) AS DOUBLE) AS n_words,
         CASE WHEN l.quality IS NULL THEN 'UNKNOWN' ELSE CAST(l.quality AS VARCHAR) END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


SQL = {"li": LI_SQL, "meta": META_SQL, "ephys": EPHYS_SQL, "morph": MORPH_SQL,
       "emb": EMB_SQL, "docs": DOCS_SQL}


def with_ctes(names: list[str], body: str, extra: list[str] | None = None) -> str:
    """``WITH <fixture ctes>, <extra ctes> <body>`` for the oracle."""
    parts = [SQL[n] for n in names] + list(extra or [])
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


def embn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``emb`` with NULLs injected in three components (for imputation)."""
    e = emb(spark, sf_dir)
    k = F.col("id").cast("bigint")
    return e.withColumns({x: F.when(k % m == r, None).otherwise(F.col(x)) for x, m, r in EMBN_HOLES})


#: components of ``embn`` with NULLs: name, modulus and remainder of the key
EMBN_HOLES = (("e0", 7, 3), ("e1", 11, 5), ("e2", 13, 4))
EMBN_SQL = "embn AS (\n  SELECT id, " + ", ".join(
    [f"CASE WHEN CAST(id AS BIGINT) % {m} = {r} THEN NULL ELSE {x} END AS {x}" for x, m, r in EMBN_HOLES]
    + [x for x in EMB_FEATURES if x not in {h for h, _, _ in EMBN_HOLES}]) + ", label\n  FROM emb)"
SQL["embn"] = EMBN_SQL


def sql_uniform(key_sql: str, salt: str | None = None, seed: int = 42) -> str:
    """DuckDB text of :func:`tidewell.functions.columns.hash_uniform`."""
    inner = f"'{seed}|' || {key_sql}" + (f" || '|{salt}'" if salt is not None else "")
    return f"(CAST(('0x' || substr(md5({inner}), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def sql_hash(key_sql: str, salt: str | None = None, seed: int = 42) -> str:
    inner = f"'{seed}|' || {key_sql}" + (f" || '|{salt}'" if salt is not None else "")
    return f"md5({inner})"


# ---------------------------------------------------------------- predictions without a model
CLASSES3 = ("A", "N", "R")


def _pexprs():
    return {"A": 1 + F.col("l_partkey") % 5, "N": 1 + F.col("l_suppkey") % 7, "R": 1 + F.col("l_orderkey") % 3}


def _qexprs():
    return {"A": 1 + F.col("l_linenumber") % 4, "N": 1 + F.col("l_partkey") % 3, "R": 1 + F.col("l_suppkey") % 5}





def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, actual, predicted): actual = lineitem label (with the 3-row class RARE, never
    predicted); predicted = argmax of the key-derived probabilities (ties → first class)."""
    l = read(spark, sf_dir, "lineitem")
    p = _pexprs()
    pred = (F.when((p["A"] >= p["N"]) & (p["A"] >= p["R"]), "A").when(p["N"] >= p["R"], "N").otherwise("R"))
    return l.select(_id_col(), F.when(F.col("l_orderkey") == 0, "RARE").otherwise(F.col("l_returnflag")).alias("actual"),
                    pred.alias("predicted"))


def probs(spark: SparkSession, sf_dir: str, student: bool = False) -> DataFrame:
    """(id, class, p): three positive key expressions divided by their sum."""
    l = read(spark, sf_dir, "lineitem")
    e = _qexprs() if student else _pexprs()
    tot = e["A"] + e["N"] + e["R"]
    return l.select(_id_col(), F.explode(F.array(*[F.struct(F.lit(k).alias("class"), (v / tot).alias("p"))
                                                   for k, v in e.items()])).alias("kv")).select("id", "kv.class", "kv.p")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preds(spark, sf_dir).select("id", F.col("actual").alias("label"))


_SQL_ID = ("concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), "
           "CAST(l_linenumber AS VARCHAR), strftime(l_shipdate, '%Y%m%d'))")
_PA, _PN, _PR = "(1 + l_partkey % 5)", "(1 + l_suppkey % 7)", "(1 + l_orderkey % 3)"
_QA, _QN, _QR = "(1 + l_linenumber % 4)", "(1 + l_partkey % 3)", "(1 + l_suppkey % 5)"
PREDS_SQL = f"""preds AS (
  SELECT {_SQL_ID} AS id, CASE WHEN l_orderkey = 0 THEN 'RARE' ELSE l_returnflag END AS actual,
         CASE WHEN {_PA} >= {_PN} AND {_PA} >= {_PR} THEN 'A' WHEN {_PN} >= {_PR} THEN 'N' ELSE 'R' END AS predicted
  FROM lineitem)"""
PROBS_SQL = "probs AS (\n" + "\n  UNION ALL ".join(
    f"SELECT {_SQL_ID} AS id, '{k}' AS class, CAST({v} AS DOUBLE) / ({_PA} + {_PN} + {_PR}) AS p FROM lineitem"
    for k, v in (("A", _PA), ("N", _PN), ("R", _PR))) + ")"
SPROBS_SQL = "sprobs AS (\n" + "\n  UNION ALL ".join(
    f"SELECT {_SQL_ID} AS id, '{k}' AS class, CAST({v} AS DOUBLE) / ({_QA} + {_QN} + {_QR}) AS p FROM lineitem"
    for k, v in (("A", _QA), ("N", _QN), ("R", _QR))) + ")"
TRUTH_SQL = "truth AS (SELECT id, actual AS label FROM preds)"
SQL.update({"preds": PREDS_SQL, "probs": PROBS_SQL, "sprobs": SPROBS_SQL, "truth": TRUTH_SQL})


def regression_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, pred): price against a quantity-based guess."""
    l = read(spark, sf_dir, "lineitem")
    # price in thousands, so sums of squares stay within double precision at 6 places
    return l.select(_id_col(), (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_quantity") * 1.5).alias("pred"))


REG_SQL = (f"reg AS (SELECT {_SQL_ID} AS id, l_extendedprice / CAST(1000.0 AS DOUBLE) AS y, "
           f"l_quantity * CAST(1.5 AS DOUBLE) AS pred FROM lineitem)")
SQL["reg"] = REG_SQL


def probs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, p_A, p_N, p_R) — the teacher probabilities as one column per class."""
    l = read(spark, sf_dir, "lineitem")
    e = _pexprs()
    tot = e["A"] + e["N"] + e["R"]
    return l.select(_id_col(), F.when(F.col("l_orderkey") == 0, "RARE").otherwise(F.col("l_returnflag")).alias("label"),
                    *[(v / tot).alias(f"p_{k}") for k, v in e.items()])


PWIDE_SQL = (f"pw AS (SELECT {_SQL_ID} AS id, CASE WHEN l_orderkey = 0 THEN 'RARE' ELSE l_returnflag END AS label, "
             + ", ".join(f"CAST({v} AS DOUBLE) / ({_PA} + {_PN} + {_PR}) AS p_{k}"
                         for k, v in (("A", _PA), ("N", _PN), ("R", _PR))) + " FROM lineitem)")
SQL["pw"] = PWIDE_SQL


def cust_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = read(spark, sf_dir, "customer")
    return cu.select(F.col("c_custkey").cast("string").alias("id"), "c_name", "c_acctbal", "c_mktsegment")


def cust_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(op, id, col, value): edits for every 50th customer, deletes for the next, and
    one added row per supplier."""
    cu = read(spark, sf_dir, "customer")
    su = read(spark, sf_dir, "supplier")
    k = F.col("c_custkey")
    cid = k.cast("string")
    e1 = cu.filter(k % 50 == 1).select(F.lit("edit").alias("op"), cid.alias("id"), F.lit("c_acctbal").alias("col"),
                                       F.lit("0.0").alias("value"))
    e2 = cu.filter(k % 50 == 1).select(F.lit("edit"), cid, F.lit("c_mktsegment"), F.lit("EDITED"))
    d = cu.filter(k % 50 == 2).select(F.lit("delete"), cid, F.lit(None).cast("string"), F.lit(None).cast("string"))
    sid = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    a1 = su.select(F.lit("add"), sid, F.lit("c_name"), F.col("s_name"))
    a2 = su.select(F.lit("add"), sid, F.lit("c_acctbal"), F.col("s_acctbal").cast("string"))
    return e1.union(e2).union(d).union(a1).union(a2)


def dcat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with categorical (lang, source) and numeric (n_chars, n_words)
    features; label = quality (imbalanced)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    lb = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lb, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), "lang", "source",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(F.col("text"), " ")).cast("double").alias("n_words"),
        F.col("quality").cast("string").alias("label"))


DCAT_SQL = """dcat AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS n_chars,
         CAST(len(string_split(d.text, ' ')) AS DOUBLE) AS n_words, CAST(l.quality AS VARCHAR) AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
SQL["dcat"] = DCAT_SQL
