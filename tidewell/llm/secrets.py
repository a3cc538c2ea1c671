"""Secret scan in DataFrame functions only: pattern hits, and high-entropy windows.

Candidate strings are long runs of key characters.  A window of ``WINDOW`` characters slides
over each; its Shannon entropy per character class comes from incremental counts: entering,
a character with count k adds f(k+1) - f(k) to the sum of f(count), leaving with count m it
adds f(m-1) - f(m), where f(c) = c log2 c in whole millionths, so sums are exact integers.
Windows whose entropy reaches the class's bound are merged into spans, unless the candidate is
on the allow-list.  The classes are hex digits, one case with digits (lower or upper), and mixed
case with or without the signs of base64, whose random windows have the same low quantile.

Positions come from the lengths of the pieces between matches.  Everything after the scan
works on hits, not texts: hits of a text are one hash key, at most one document's hits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import text_of

WINDOW = 20
UNIT = 1_000_000
#: least entropy of a window in bits, by class: about the 2 % quantile over random windows of the
#: class's alphabet (3.684 for both 62 and 64 symbols, 3.446 for 36; for 16 symbols 3.0 is 3 %)
BOUNDS = {"entropy_key": 3.684, "entropy_hex": 3.0, "entropy_lower": 3.446, "entropy_upper": 3.446}
#: kinds in their order; the first three are the base kinds
KINDS = ("assign", "access", "hex", "entropy_key", "entropy_hex", "entropy_lower", "entropy_upper")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


def _one_case(more: str, hexes: str, either: str) -> str:
    """Runs of ``either`` with a character of ``more`` within their first ``WINDOW``, so that
    runs of hex digits alone are left to the hex class.  A run starts at most WINDOW - 1 hex
    digits before that character: every window with it is kept, and any text scans in linear
    time."""
    out = f"{more}{either}*"
    for left in range(1, WINDOW):
        out = f"{more}{either}{{{left},}}|{hexes}(?:{out})"
    return f"(?:{out})"


ASSIGN = ("(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
          + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 12
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}",
            "entropy_key": f"[A-Za-z0-9+/_=-]{{{WINDOW},}}", "entropy_hex": f"[0-9A-Fa-f]{{{WINDOW},}}",
            "entropy_lower": _one_case("[g-z]", "[0-9a-f]", "[a-z0-9]"),
            "entropy_upper": _one_case("[G-Z]", "[0-9A-F]", "[A-Z0-9]")}
#: candidates that are no secrets: letters in the case pattern of a word or of words run together,
#: numbers, words joined by one kind of joiner, identifiers in the usual eight-four-four-four-twelve
#: form, documentation keys
ALLOW = (r"^[A-Z]?[a-z]+([A-Z][a-z]+)*$", r"^[A-Z]+$", r"^[0-9]+$", r"^[A-Z]?[a-z]+([_/=+-][A-Z]?[a-z]+)*$",
         r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", r"EXAMPLE$")
KEY = ["__tw_id", "__tw_hash", "__tw_len"]


def _matches(text: Column, kind: str) -> Column:
    """Every match of a kind: its number, the length of the text between it and the one before,
    its own length, whether it passes, and (candidates) the string.  The split into pieces runs
    only where there is a match."""
    at = KINDS.index(kind)
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    if kind == "assign":
        ok = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda g: F.length(g) >= ASSIGN_LEAST)
    else:
        ok = F.transform(found, lambda m: F.lit(True))
    rows = F.transform(F.arrays_zip(F.transform(found, lambda m: m).alias("m"), F.transform(pieces, lambda p: F.length(p)).alias("g"),
                                    ok.alias("ok")),
                       lambda r, i: F.struct(F.lit(at).alias("kind"), i.alias("n"), r["g"].alias("gap"),
                                             F.length(r["m"]).alias("len"), r["ok"].alias("ok"),
                                             (r["m"] if at > 2 else F.lit(None).cast("string")).alias("s")))
    rows = F.filter(rows, lambda r: r["len"].isNotNull())  # the piece behind the last match
    quick = F.contains(text, F.lit("AKIA")) if kind == "access" else F.regexp_like(text, F.lit(pattern))
    none = F.array().cast("array<struct<kind:int,n:int,gap:int,len:int,ok:boolean,s:string>>")
    return F.when(quick, rows).otherwise(none)


def _xlog(c: Column, window: int) -> Column:
    """c log2 c in whole millionths, by table."""
    values = [0, 0, *[round(k * math.log2(k) * UNIT) for k in range(2, window + 1)]]
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), (c + 1).cast("int"))


def entropy_limit(bits: float, window: int = WINDOW) -> int:
    """The largest sum of f(count) at which a window still has ``bits`` of entropy."""
    return math.floor(window * (math.log2(window) - bits) * UNIT)


def entropy_spans(candidates: DataFrame, key: Sequence[str], bounds=None, window: int = WINDOW) -> DataFrame:
    """(key, kind, start, end): merged windows that reach their class's bound, from
    (key, kind, start, s).  Incremental counts as window functions: each character's count
    among the characters that share the window with it, and one running sum per candidate."""
    bounds = bounds or BOUNDS
    one = [*key, "kind", "start"]
    chars = candidates.select(*one, F.posexplode(F.split("s", "")).alias("pos", "ch")).where("ch <> ''")
    same = Window.partitionBy(*one, "ch").orderBy("pos")
    line = Window.partitionBy(*one).orderBy("pos")
    inside = F.count(F.lit(1)).over(same.rangeBetween(-(window - 1), -1))
    leaving = F.count(F.lit(1)).over(same.rangeBetween(0, window - 1))
    steps = (chars.withColumn("k", inside).withColumn("m", leaving)
             .withColumn("enter", _xlog(F.col("k") + 1, window) - _xlog(F.col("k"), window))
             .withColumn("leave", _xlog(F.col("m") - 1, window) - _xlog(F.col("m"), window)))
    total = (F.sum("enter").over(line.rowsBetween(Window.unboundedPreceding, 0))
             + F.coalesce(F.sum("leave").over(line.rowsBetween(Window.unboundedPreceding, -window)), F.lit(0)))
    limit = F.when(F.lit(False), F.lit(0).cast("bigint"))
    for name, bits in bounds.items():
        limit = limit.when(F.col("kind") == KINDS.index(name), F.lit(entropy_limit(bits, window)).cast("bigint"))
    hits = steps.withColumn("sum", total).where((F.col("pos") >= window - 1) & (F.col("sum") <= limit))
    new = (F.col("pos") - F.lag("pos").over(line) > window) | F.lag("pos").over(line).isNull()
    island = hits.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(line))
    return (island.groupBy(*one, "island").agg(F.min("pos").alias("a"), F.max("pos").alias("z"))
            .select(*key, "kind", (F.col("start") + F.col("a") - (window - 1)).alias("start"),
                    (F.col("start") + F.col("z") + 1).alias("end")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: Sequence[str] = ALLOW,
                 bounds=None) -> DataFrame:
    """One row per input row: the id and ``spans``, an array of (start, kind, end) in code
    points, end exclusive, by start, then kind (numbers of ``KINDS``); empty where nothing is
    found, as in empty and NULL texts.  The allow-list drops entropy spans only.

    Rows are matched to their spans by id, hash and length of the text, so ids may repeat or be
    NULL, and repeated rows all get their spans; other columns play no part."""
    text = text_of(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("__tw_id"), F.xxhash64(text).alias("__tw_hash"),
                       F.length(text).alias("__tw_len"), text.alias("__tw_text"))
    found = rows.select(*KEY, F.explode(F.concat(*[_matches(F.col("__tw_text"), k) for k in KINDS])).alias("h"))
    found = (found.select(*KEY, "h.*").repartition(*KEY).dropDuplicates([*KEY, "kind", "n"]))
    run = Window.partitionBy(*KEY, "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = (found.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run))
              .withColumn("start", F.col("end") - F.col("len")))
    base = placed.where("kind < 3 AND ok").select(*KEY, "kind", "start", "end")
    allowed = F.lit(False)
    for pattern in allow:
        allowed = allowed | F.regexp_like("s", F.lit(pattern))
    extra = entropy_spans(placed.where(F.col("kind") > 2).where(~allowed).select(*KEY, "kind", "start", "s"), KEY, bounds)
    spans = (base.unionByName(extra).groupBy(*[F.col(c).alias(f"{c}_s") for c in KEY])
             .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans")))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_s")) for c in KEY]
    joined = rows.drop("__tw_text").join(spans, same, "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return joined.select(F.col("__tw_id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
