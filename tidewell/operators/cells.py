"""Pruned exact kNN join: pivot cells, triangle-inequality bounds, two rounds.

Base rows belong to the cell of their nearest pivot (a hashed sample of base rows) and, in
a large cell, to a shell of distances from it; (partition, cell, shell) is a *block* with a
least and a greatest radius.  A probe at distance d from the pivot is at least
max(d − greatest, least − d) away from every row of the block, and, as these rows are no
nearer to any other pivot, as far as the plane halfway between their pivot and one that is
nearer to the probe.  The bounds use only the coordinates that no row lacks: the NaN-aware
distance is never below the Euclidean distance over them, nor is the grouped one, so they hold
for every distance of ``knn``.

Round one lets a probe visit the few nearest blocks and gives it k neighbours, hence a
distance it need not look beyond; round two visits just the blocks whose bound does not
exceed that distance.  The result is the same as that of comparing all pairs, ties included.

The pivots (at most ``MOST_PIVOTS`` rows) and the block table (about one row per
``base_block`` base rows) are all that reaches the driver.  Blocks above ``base_block`` rows
are cut by hash and blocks with many visitors meet them in chunks, so a task never holds more
than one chunk and one block.  Blocks that nobody visits are not shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.columns import c
from tidewell.session import cut_lineage

MOST_PIVOTS, MOST_SHELLS = 1024, 256
#: blocks that the first round visits at most
FIRST = 6
#: nearest pivots of a probe whose planes bound the other cells
PLANES = 4
#: cells of a table of rows and blocks looked at together, and rows sent on together
_LOOK, _SEND = 1 << 20, 16_384
_KEY, _CELL, _R, _TAU = "__key", "__cell", "__r", "__tau"


def _key(parts: Sequence[str]):
    """One text per combination of partition values, NULL apart from every text."""
    return F.concat_ws("|", F.lit(""), *[F.coalesce(F.concat(F.lit("="), F.regexp_replace(c(p).cast("string"), r"([\\|])", r"\\$1")), F.lit("~"))
                                         for p in parts])


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    if not names:
        return np.zeros((batch.num_rows, 0))
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    for i, p in enumerate(pivots):
        out[:, i] = np.sqrt(((x - p) ** 2).sum(1))
    return out


def _planes(to: np.ndarray, hi: np.ndarray, d: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Least distances (probes × blocks) behind the planes halfway between a probe's pivot, ``d`` away,
    and the pivots of the blocks, ``to`` away: (to² − d²) / (2 · gap), less what rounding may add.
    Rows of a block are at most ``hi`` from its pivot; values out of the range of squares bound nothing."""
    near, far = (d * d)[:, None], to * to
    with np.errstate(all="ignore"):
        out = (far - near - 1e-9 * (far + near + hi * hi)) / (2 * gap)
    return np.where(np.isfinite(out) & (gap > 1e-100), out, 0.0)


def _slices(batch: pa.RecordBatch, rows: int):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _hash(ids: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(i.encode("utf-8", "surrogatepass")) for i in ids), np.int64, len(ids))


class CellIndex:
    """The blocks of a base table; ``always``: features that neither side lacks."""

    def __init__(self, base: DataFrame, feats: Sequence[str], always: Sequence[str], id_col: str,
                 partition_cols: Sequence[str], passthrough: Sequence[str], n_base: int, base_block: int):
        self.feats, self.always, self.block = list(feats), list(always), base_block
        self.keep = list(passthrough)
        spark = base.sparkSession
        rows = base.select(_key(partition_cols).alias(_KEY), c(id_col).cast("string").alias("__bid"),
                           *[c(f).cast("double").alias(f) for f in feats], *[c(p).alias(p) for p in passthrough])
        rows = rows.where(F.col("__bid").isNotNull())
        count = int(min(MOST_PIVOTS, max(8, 2 * n_base // base_block)))
        chosen = rows.orderBy(F.xxhash64("__bid"), "__bid").limit(count).select(*always).collect()
        pivots = np.unique(np.array([tuple(r) for r in chosen], float).reshape(len(chosen), len(always)), axis=0)
        self.pivots, names = pivots, list(always)
        schema = T.StructType(rows.schema.fields + [T.StructField(_CELL, T.IntegerType()), T.StructField(_R, T.DoubleType())])
        shared = spark.sparkContext.broadcast(pivots)

        def assign(batches):
            for batch in batches:
                d = _to_pivots(_matrix(batch, names), shared.value)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                                                 names=[*batch.schema.names, _CELL, _R])
        # read by the shells, the blocks and both rounds
        self.rows = cut_lineage(rows.mapInArrow(assign, schema))
        sizes = self.rows.groupBy(_KEY, _CELL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > base_block)
        shells = {(r[_KEY], r[_CELL]): min(MOST_SHELLS, -(-r["n"] // base_block)) for r in sizes.collect()}
        bounds = {}
        if shells:
            most = max(shells.values())
            cut = (self.rows.join(F.broadcast(sizes.select(F.col(_KEY).alias("__k"), F.col(_CELL).alias("__c"))),
                                  (F.col(_KEY) == F.col("__k")) & (F.col(_CELL) == F.col("__c")))
                   .groupBy(_KEY, _CELL).agg(F.percentile_approx(_R, [i / most for i in range(1, most)] or [0.5], 10 * most).alias("q")))
            for r in cut.collect():  # one row per oversized cell
                n = shells[r[_KEY], r[_CELL]]
                bounds[r[_KEY], r[_CELL]] = np.unique([r["q"][max(0, round(i * most / n) - 1)] for i in range(1, n)])
        self.bounds = spark.sparkContext.broadcast(bounds)
        bound = self.bounds

        def shell(batches):
            for batch in batches:
                key, cell = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                r = batch.column(2).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_shell(key, cell, r, bound.value)), batch.column(2)],
                                                 names=[_KEY, _CELL, "shell", _R])
        table = (self.rows.select(_KEY, _CELL, _R).mapInArrow(shell, f"{_KEY} string, {_CELL} int, shell int, {_R} double")
                 .groupBy(_KEY, _CELL, "shell").agg(F.count(F.lit(1)).alias("n"), F.min(_R).alias("lo"), F.max(_R).alias("hi"))).collect()
        self.first, self.parts, by_key = {}, {}, {}
        ids = 0
        for r in sorted(table, key=lambda r: (r[_KEY], r[_CELL], r["shell"])):
            place, parts = (r[_KEY], r[_CELL], r["shell"]), -(-r["n"] // base_block)
            self.first[place], self.parts[place] = ids, parts
            by_key.setdefault(r[_KEY], []).append((r[_CELL], r["lo"], r["hi"], r["n"], ids, parts))
            ids += parts
        self.size = {b + i: n / k for t in by_key.values() for _, _, _, n, b, k in t for i in range(k)}
        self.table = {k: np.array(v, float) for k, v in by_key.items()}

    # -- probes

    def visits(self, probes: DataFrame, need: int, chunks: dict[int, int] | None) -> DataFrame:
        """(__bb, __pc, __pid, features...): a row per probe and block it visits.  ``probes`` has
        ``__key``, ``__pid``, the features and ``__tau``, the distance to look up to (NULL: the first
        round, which takes the nearest blocks that hold ``need`` rows)."""
        always, feats = self.always, self.feats
        shared = probes.sparkSession.sparkContext.broadcast((self.pivots, self.table, chunks))

        def run(batches):
            pivots, table, chunk = shared.value
            widest = max([len(pivots), 1, *[len(t) for t in table.values()]])
            apart = _to_pivots(pivots, pivots)
            for batch in (part for whole in batches for part in _slices(whole, max(1, _LOOK // widest))):
                d = _to_pivots(_matrix(batch, always), pivots)
                planes = min(PLANES, len(pivots))
                closest = np.argpartition(d, planes - 1, axis=1)[:, :planes]
                keys = np.array(batch.column(_KEY).to_pylist(), object)
                tau = batch.column(_TAU).to_numpy(zero_copy_only=False).astype(float)
                who, where = [], []
                for key in dict.fromkeys(keys.tolist()):
                    t = table.get(key)
                    if t is None:
                        continue
                    mine = np.flatnonzero(keys == key)
                    cell, lo, hi, n, block, parts = t.T
                    to = d[mine][:, cell.astype(int)]
                    bound = np.nan_to_num(np.maximum(np.maximum(to - hi, lo - to), 0.0), nan=0.0)
                    for own in closest[mine].T:
                        bound = np.maximum(bound, _planes(to, hi, d[mine, own], apart[own][:, cell.astype(int)]))
                    first = np.isnan(tau[mine])
                    go = bound * (1 - 1e-9) <= tau[mine][:, None]
                    if first.any():
                        near = np.argsort(np.nan_to_num(to[first]) + bound[first], axis=1, kind="stable")[:, :FIRST]
                        held = np.cumsum(n[near], axis=1)
                        take = np.concatenate([np.ones((len(near), 1), bool), held[:, :-1] < need], axis=1)
                        go[np.flatnonzero(first)[:, None], near] = take
                    p, b = np.nonzero(go)
                    k = parts[b].astype(int)
                    who.append(np.repeat(mine[p], k))
                    where.append(np.repeat(block[b].astype(int), k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
                if not who:
                    continue
                who, where = np.concatenate(who), np.concatenate(where)
                pid = batch.column("__pid")
                deal = _hash(pid.to_pylist())[who] % np.array([chunk.get(b, 1) for b in where.tolist()] if chunk else [1] * len(where), np.int64)
                for i in range(0, len(who), _SEND):
                    at = pa.array(who[i:i + _SEND])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(where[i:i + _SEND].astype(np.int32)), pa.array(deal[i:i + _SEND].astype(np.int32)), pid.take(at),
                         *[batch.column(f).take(at) for f in feats]], names=["__bb", "__pc", "__pid", *feats])
        fields = [T.StructField("__bb", T.IntegerType()), T.StructField("__pc", T.IntegerType()), T.StructField("__pid", T.StringType()),
                  *[T.StructField(f, T.DoubleType()) for f in feats]]
        return probes.select(_KEY, "__pid", _TAU, *feats).mapInArrow(run, T.StructType(fields))

    def stored(self, chunks: dict[int, int]) -> DataFrame:
        """(__bb, __pc, __bid, features..., passthrough...) of the blocks in ``chunks``, once per chunk of visitors."""
        rows, keep = self.rows, [*self.feats, *self.keep]
        shared = rows.sparkSession.sparkContext.broadcast((self.first, self.parts, chunks))
        bound = self.bounds

        def run(batches):
            first, parts, chunk = shared.value
            for batch in batches:
                key, cell, bid = (batch.column(n).to_pylist() for n in (_KEY, _CELL, "__bid"))
                shell = _shell(key, cell, batch.column(_R).to_numpy(zero_copy_only=False), bound.value).tolist()
                places = list(zip(key, cell, shell))
                block = np.array([first[p] for p in places], np.int64) + _hash(bid) % np.array([parts[p] for p in places], np.int64)
                times = np.array([chunk.get(b, 0) for b in block.tolist()], np.int64)
                at = np.repeat(np.arange(len(block)), times)
                pc = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                for i in range(0, len(at), _SEND):
                    some = at[i:i + _SEND]
                    take = pa.array(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block[some].astype(np.int32)), pa.array(pc[i:i + _SEND].astype(np.int32)), batch.column("__bid").take(take),
                         *[batch.column(n).take(take) for n in keep]], names=["__bb", "__pc", "__bid", *keep])
        fields = [T.StructField("__bb", T.IntegerType()), T.StructField("__pc", T.IntegerType()), T.StructField("__bid", T.StringType()),
                  *[rows.schema[n] for n in keep]]
        return rows.mapInArrow(run, T.StructType(fields))

    def meet(self, probes: DataFrame, need: int, kernel, schema: str, probe_block: int) -> tuple[DataFrame, int]:
        """(what the kernel makes of every visited pair of chunk and block, pairs compared)."""
        seen = {r["__bb"]: r["n"] for r in self.visits(probes, need, None).groupBy("__bb").agg(F.count(F.lit(1)).alias("n")).collect()}
        chunks = {b: -(-n // probe_block) for b, n in seen.items()}
        left, right = self.visits(probes, need, chunks), self.stored(chunks)
        made = left.groupBy("__bb", "__pc").cogroup(right.groupBy("__bb", "__pc")).applyInPandas(kernel, schema)
        return made, int(sum(n * self.size[b] for b, n in seen.items()))


def _shell(key: list, cell: list, r: np.ndarray, bounds: dict) -> np.ndarray:
    out = np.zeros(len(r), np.int32)
    if bounds:
        for i, place in enumerate(zip(key, cell)):
            b = bounds.get(place)
            if b is not None:
                out[i] = np.searchsorted(b, r[i], side="left")
    return out


def pruned_join(probe: DataFrame, base: DataFrame, k: int, feats: Sequence[str], always: Sequence[str], have: dict[str, int],
                kernel, schema: str, *, id_col: str, partition_cols: Sequence[str], exclude_self: bool, donors: bool,
                passthrough: Sequence[str], probe_block: int, base_block: int, n_base: int) -> tuple[DataFrame, dict[str, int]]:
    """(the kernel's rows over all pairs that can matter, {round: pairs compared}).

    ``have``: base rows that have each feature; with ``donors`` a probe looks for the k nearest rows
    that have each feature it lacks."""
    index = CellIndex(base, feats, always, id_col, partition_cols, passthrough, n_base, base_block)
    probes = probe.select(_key(partition_cols).alias(_KEY), c(id_col).cast("string").alias("__pid"), *[c(f).cast("double").alias(f) for f in feats])
    probes = probes.where(F.col("__pid").isNotNull())
    need = (k + int(exclude_self)) * (4 if donors else 1)
    home, first = index.meet(probes.withColumn(_TAU, F.lit(None).cast("double")), need, kernel, schema, probe_block)
    per = ["probe_id", "feature"] if donors else ["probe_id"]
    rank = F.row_number().over(Window.partitionBy(*per).orderBy("dist", "base_id"))
    if donors:
        wanted = {f: min(k, have[f]) for f in feats if have[f]}
        last = F.element_at(F.create_map(*[x for f, n in wanted.items() for x in (F.lit(f), F.lit(n))]), F.col("feature"))
        missing = sum((F.col(f).isNull() | F.isnan(f)).cast("int") for f in wanted) if wanted else F.lit(0)
    else:
        last, missing = F.lit(k), F.lit(1)
    found = (home.select(*per, "base_id", "dist").withColumn("__n", rank).where(F.col("__n") == last)
             .groupBy("probe_id").agg(F.max("dist").alias("__d"), F.count(F.lit(1)).alias("__m")))
    # a probe that lacks one of its k-th neighbours looks everywhere
    limits = cut_lineage(found)
    known = probes.withColumn("__missing", missing)
    narrowed = (known.join(limits, known["__pid"] == limits["probe_id"], "left")
                .withColumn(_TAU, F.when(F.col("__missing") == 0, F.lit(-1.0))
                            .when(F.col("__m") >= F.col("__missing"), F.col("__d")).otherwise(F.lit(float("inf"))))
                .select(*probes.columns, _TAU))
    made, second = index.meet(narrowed, need, kernel, schema, probe_block)
    return made, {"first": first, "second": second}
