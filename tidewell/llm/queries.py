"""Registered queries of the training-data operators, with DuckDB texts where SQL can say the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import (
    collocations,
    embeddings,
    exact,
    language_model,
    mixing,
    packing,
    quality,
    repeats,
    secrets,
    simhash,
    spelling,
    toxicity,
    training_order,
)
from tidewell.llm.common import crc32_mod, read_table, scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _labelled_fold() -> tuple:
    return F.col("doc_id"), (crc32_mod("doc_id", 5) == 0).alias("held_out")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select(
        *_labelled_fold(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select(*_labelled_fold(), "score",
                         (F.col("score") >= quality.KEEP_FROM).cast("int").alias("predicted"))


@query
def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


ORACLE["op3_poisson_mixing"] = f"""
WITH sized AS (
  SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN pow(size, {mixing.FLATTEN}) / (SELECT sum(pow(size, {mixing.FLATTEN})) FROM sized)
                        * (SELECT sum(size) FROM sized) / size ELSE 1.0 END AS rate FROM sized),
parted AS (SELECT source, rate, greatest(1, ceil(rate / {mixing.PART}))::INT AS parts FROM rates),
cdf AS (
  SELECT source, parts, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1.0)))
           OVER (PARTITION BY source ORDER BY k) AS c
  FROM parted, generate_series(0, 200) AS g(k)
  WHERE k <= ceil(rate / parts + 12 * sqrt(rate / parts) + 24)),
cdfs AS (SELECT source, max(parts) AS parts, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(0, parts), lambda p: len(list_filter(cs, lambda c: c <
           (CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || p), 1, 13) AS BIGINT)
            + 0.5) / 4503599627370496.0))))::INT AS n
  FROM documents d JOIN cdfs s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       md5('order:{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM drawn)
"""


@query
def op4_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_model.score_documents(docs, crc32_mod("doc_id", 7) != 2).withColumn(
        "held_out", crc32_mod("doc_id", 7) == 2)


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{name}")
             for k, name in enumerate(secrets.KINDS[:3])]
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", *count, F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
                        secrets.span_text(F.col("spans")).alias("spans"))


def _secret_sql() -> str:
    def matches(kind: str) -> str:
        k, p = secrets.KINDS.index(kind), secrets.PATTERNS[kind].replace("'", "''")
        ok = f"len(unnest(regexp_extract_all(t, '{p}', 2))) >= {secrets.ASSIGN_LEAST}" if kind == "assign" else "true"
        return f"""SELECT doc_id, {k} AS kind, unnest(range(0, len(regexp_extract_all(t, '{p}')))) AS n,
          len(unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))])) AS gap,
          unnest(regexp_extract_all(t, '{p}')) AS s, {ok} AS ok FROM d WHERE regexp_matches(t, '{p}')"""
    w = secrets.WINDOW
    table = "[0, 0, " + ", ".join(str(round(c * math.log2(c) * secrets.UNIT)) for c in range(2, w + 1)) + "]"
    limit = " ".join(f"WHEN {secrets.KINDS.index(n)} THEN {secrets.entropy_limit(b)}" for n, b in secrets.BOUNDS.items())
    allow = " OR ".join(f"regexp_matches(s, '{p}')" for p in secrets.ALLOW)
    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"

    def text(where: str) -> str:
        return f"""coalesce(string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)
            FILTER (WHERE {where}), '')"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(matches(k) for k in secrets.KINDS)}),
placed AS (
  SELECT *, CAST(sum(gap + len(s)) OVER (PARTITION BY doc_id, kind ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM m),
located AS (SELECT *, stop - len(s) AS start FROM placed),
chars AS (
  SELECT doc_id, kind, start, unnest(range(0, len(s))) AS pos, unnest(string_split(s, '')) AS ch
  FROM located WHERE kind > 2 AND NOT ({allow})),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, kind, start, ch ORDER BY pos RANGE BETWEEN {w - 1} PRECEDING AND 1 PRECEDING) AS k,
         count(*) OVER (PARTITION BY doc_id, kind, start, ch ORDER BY pos RANGE BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS m
  FROM chars),
steps AS (
  SELECT *, ({table})[k + 2] - ({table})[k + 1] AS enter, ({table})[m] - ({table})[m + 1] AS leave FROM counted),
summed AS (
  SELECT *, sum(enter) OVER (PARTITION BY doc_id, kind, start ORDER BY pos ROWS UNBOUNDED PRECEDING)
       + coalesce(sum(leave) OVER (PARTITION BY doc_id, kind, start ORDER BY pos
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND {w} PRECEDING), 0) AS total FROM steps),
hits AS (SELECT * FROM summed WHERE pos >= {w - 1} AND total <= CASE kind {limit} END),
marked AS (
  SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, kind, start ORDER BY pos) <= {w} THEN 0 ELSE 1 END AS new
  FROM hits),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, kind, start ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM marked),
spans AS (
  SELECT doc_id, kind, start, stop FROM located WHERE kind < 3 AND ok
  UNION ALL
  SELECT doc_id, kind, start + min(pos) - {w - 1}, start + max(pos) + 1 FROM islands GROUP BY doc_id, kind, start, island),
agg AS (
  SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
         count(*) FILTER (WHERE kind = 2) AS n_hex, {text("kind < 3")} AS base, {text("kind >= 0")} AS spans
  FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, n_assign, n_access, n_hex, sha256(base) AS base_sha256, spans FROM agg
"""


ORACLE["op5_secret_scan"] = _secret_sql()


@query
def op6_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark_copies(read_table(spark, sf_dir, "documents"))


ORACLE["op8_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM w
"""


@query
def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "shards")
    shape = training_order.write_training_order(read_table(spark, sf_dir, "documents"), path)
    return training_order.slot_digests(spark, path, shape)


@query
def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read_table(spark, sf_dir, "embeddings"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.spelling_variants(read_table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def _collocation_sql() -> str:
    c = collocations
    upper = "".join(map(chr, range(65, 91)))
    lengths = range(1, c.LONGEST + 1)
    grams = " UNION ALL ".join(f"""
  SELECT lang, {k} AS length, unnest(list_transform(range(1, len(ws) - {k} + 2),
         lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) AS phrase FROM pieces WHERE len(ws) >= {k}""" for k in lengths)

    def part(a, z):
        return f"b.lang || chr(10) || array_to_string(b.w[{a}:{z}], ' ')"
    cuts = " UNION ALL ".join(f"""
  SELECT b.lang, b.phrase, b.n AS a, {k} AS k, x.n AS l, y.n AS r,
         CAST(b.n AS HUGEINT) * b.n * {c.UNIT} // (CAST(x.n AS HUGEINT) * y.n) AS score
  FROM often b JOIN often x ON x.key = {part(1, k)} JOIN often y ON y.key = {part(k + 1, m)}
  WHERE b.length = {m}""" for m in lengths for k in range(1, m))
    inner = " UNION ALL ".join(f"""
  SELECT {part(i, i + m - 1)} AS key, b.n FROM often b WHERE b.length = {q}"""
                               for q in range(3, c.LONGEST + 1) for m in range(2, q) for i in range(1, q - m + 2))
    return f"""
WITH pieces AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
grams AS ({grams}),
f AS MATERIALIZED (SELECT lang, length, phrase, count(*) AS n FROM grams GROUP BY ALL),
words AS MATERIALIZED (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE length = 1 GROUP BY lang),
often AS MATERIALIZED (
  SELECT lang, length, phrase, n, lang || chr(10) || phrase AS key, string_split(phrase, ' ') AS w FROM f WHERE n >= {c.LEAST}),
cuts AS ({cuts}),
scored AS (
  SELECT lang, phrase, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score
  FROM cuts GROUP BY lang, phrase, a),
held AS (SELECT key, max(n) AS longer FROM ({inner}) GROUP BY key),
free AS (
  SELECT s.* FROM scored s LEFT JOIN held h ON h.key = s.lang || chr(10) || s.phrase
  WHERE h.longer IS NULL OR 100 * h.longer < {c.COVER} * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, w.n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN words w ON w.lang = r.lang WHERE r.rank <= {c.TOP}
"""


ORACLE["op12_phrase_collocations"] = _collocation_sql()


@query
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.cut_repeats(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op13_suffix_dedup"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS x,
         octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
blocks AS (
  SELECT row, doc_id, b, least(1000, n_bytes - {repeats.THRESHOLD - 1} - b) AS n, substr(x, 2 * b + 1, {2 * (1000 + repeats.THRESHOLD)}) AS x
  FROM (SELECT row, doc_id, n_bytes, x, unnest(range(0, n_bytes - {repeats.THRESHOLD - 1}, 1000)) AS b FROM d)),
windows AS MATERIALIZED (
  SELECT row, doc_id, b + unnest(range(0, n)) AS p,
         unnest(list_transform(range(0, n), lambda p: substr(x, 2 * p + 1, {2 * repeats.THRESHOLD}))) AS w FROM blocks),
first AS (SELECT w, min(doc_id) AS low FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
lowest AS (SELECT w.row, w.p, w.doc_id, f.low FROM windows w JOIN first f ON f.w = w.w),
hits AS (
  SELECT row, p, CASE WHEN p - lag(p) OVER (PARTITION BY row ORDER BY p) <= {repeats.THRESHOLD} THEN 0 ELSE 1 END AS new
  FROM lowest WHERE low < doc_id),
islands AS (SELECT *, sum(new) OVER (PARTITION BY row ORDER BY p ROWS UNBOUNDED PRECEDING) AS island FROM hits),
spans AS (SELECT row, min(p) AS start, max(p) + {repeats.THRESHOLD} AS stop FROM islands GROUP BY row, island),
gaps AS (
  SELECT row, lag(stop, 1, 0) OVER (PARTITION BY row ORDER BY start) AS start, start AS stop FROM spans
  UNION ALL SELECT row, max(stop), 1099511627776 FROM spans GROUP BY row),
pieces AS (
  SELECT g.row, string_agg(substr(d.x, 2 * g.start + 1, 2 * (least(g.stop, d.n_bytes) - g.start)), '' ORDER BY g.start) AS kept
  FROM gaps g JOIN d USING (row) GROUP BY g.row),
cut AS (SELECT row, count(*) AS n_spans, CAST(sum(stop - start) AS BIGINT) AS n_removed FROM spans GROUP BY row)
SELECT d.doc_id, d.n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(p.kept, d.x))) AS kept_sha256
FROM d LEFT JOIN cut c USING (row) LEFT JOIN pieces p USING (row)
"""
