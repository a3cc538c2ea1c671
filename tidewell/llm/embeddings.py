"""Embedding near-duplicates by cross-polytope hashing.

Equal vectors collapse to one representative with a multiplicity.  In each of ``TABLES`` tables
a vector is turned by pseudo-random rotations (three rounds of random signs and a fast
Hadamard transform) and hashed to the nearest axis, ``HASHES`` rotations per bucket.  It is
stored in its own bucket and also probes the ``PROBES`` next nearest ones.  Pairs that meet in a
bucket are verified by their cosine in double precision.

Each pair counts in one place only: both vectors carry their buckets, so the task that finds
a pair can tell whether an earlier table or bucket finds it too.  Buckets therefore report link
counts and a spanning set of links, never all pairs.  A bucket with more than ``BLOCK`` entries
is dealt into blocks; every pair of blocks is a task group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialise, shuffle_partitions
from tidewell.llm.components import components
from tidewell.llm.simhash import _join_labels

COSINE = 0.95
TABLES, HASHES, PROBES = 8, 2, 2
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform along the last axis (a power of two)."""
    n, step = x.shape[-1], 1
    while step < n:
        y = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x


def hash_vectors(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES,
                 seed: int = 5) -> np.ndarray:
    """Bucket numbers, shape (vectors, tables, 1 + probes): the own bucket, then the probed ones
    in the order of how little the vector would have to move."""
    n, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    padded = np.zeros((n, width))
    padded[:, :dim] = unit
    out = np.empty((n, tables, 1 + probes), np.int64)
    rng = np.random.default_rng(seed)
    signs = rng.choice([-1.0, 1.0], size=(tables, hashes, 3, width))
    deep = min(2 * width, probes + 1)
    for t in range(tables):
        near, loss = [], []
        for h in range(hashes):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[t, h, r]) / np.sqrt(width)
            both = np.concatenate([y, -y], axis=1)  # closeness to each axis and its opposite
            top = np.argpartition(-both, deep - 1, axis=1)[:, :deep]
            value = np.take_along_axis(both, top, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            near.append(np.take_along_axis(top, order, 1))
            value = np.take_along_axis(value, order, 1)
            loss.append((value[:, :1] - value) ** 2)
        # combinations that change one or more hashes, by summed loss
        code, cost = near[0], loss[0]
        for h in range(1, hashes):
            code = (code[:, :, None] * (2 * width) + near[h][:, None, :]).reshape(n, -1)
            cost = (cost[:, :, None] + loss[h][:, None, :]).reshape(n, -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :1 + probes]
        out[:, t] = np.take_along_axis(code, best, 1)
    return out


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v, float) for v in column.to_numpy(zero_copy_only=False)]


def _route(tables: int, hashes: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            many = batch.column(1).to_numpy(zero_copy_only=False)
            vec = _vectors(batch.column(2))
            sizes = np.array([len(v) for v in vec])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                for lo in range(0, len(at), 512):
                    part = at[lo:lo + 512]
                    x = np.stack([vec[i] for i in part])
                    buckets = hash_vectors(x, tables, hashes, probes)
                    narrow = x.astype(np.float32)
                    x = narrow if (narrow == x).all() else x
                    n, per = len(part), tables * (1 + probes)
                    own = [b.tobytes() for b in buckets]
                    raw = [v.tobytes() for v in x]
                    rep = np.repeat(np.arange(n), per)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n * per, dim, np.int32)), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), n)),
                         pa.array(buckets.reshape(-1)), pa.array(np.tile(np.arange(1 + probes) > 0, n * tables).astype(np.int32)),
                         pa.array(ids[part][rep]), pa.array(many[part][rep]),
                         pa.array(raw, pa.binary()).take(pa.array(rep)), pa.array(own, pa.binary()).take(pa.array(rep))],
                        names=["dim", "tab", "bucket", "probe", "id", "many", "vec", "own"])
    return run


ROUTED = "dim int, tab int, bucket long, probe int, id long, many long, vec binary, own binary"


def _met_before(own_i: np.ndarray, own_j: np.ndarray, table: int, bucket: int, low_i: np.ndarray) -> np.ndarray:
    """Whether an earlier table, or another bucket of this one, finds the pair too and counts it."""
    base_i, base_j = own_i[:, :, 0], own_j[:, :, 0]
    same = base_i == base_j
    i_probes = (own_i[:, :, 1:] == base_j[:, :, None]).any(axis=2)
    j_probes = (own_j[:, :, 1:] == base_i[:, :, None]).any(axis=2)
    met = same | i_probes | j_probes
    before = met[:, :table].any(axis=1)
    # in this table the pair may meet in both own buckets: the smaller id's own bucket counts it
    twice = ~same[:, table] & i_probes[:, table] & j_probes[:, table]
    low_base = np.where(low_i, base_i[:, table], base_j[:, table])
    return before | (twice & (low_base != bucket))


def _bucket_links(table, bucket, side, probe, ids, many, x, own, cosine):
    """Links of one task group: side 0 against side 1, or within side 0 where there is no side 1."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    inner = len(right) == 0
    if inner:
        right = left
    norm = np.sqrt((x * x).sum(axis=1))
    found = []
    for lo in range(0, len(left), 256):
        part = left[lo:lo + 256]
        sim = (x[part] @ x[right].T) / (norm[part][:, None] * norm[right][None, :])
        a, b = np.nonzero(sim >= cosine)
        i, j = part[a], right[b]
        keep = (probe[i] + probe[j] < 2) & ((ids[i] < ids[j]) if inner else (ids[i] != ids[j]))
        i, j = i[keep], j[keep]
        for s in range(0, len(i), 1 << 14):
            p, q = i[s:s + (1 << 14)], j[s:s + (1 << 14)]
            new = ~_met_before(own[p], own[q], table, bucket, ids[p] < ids[q])
            found.append((p[new], q[new]))
    return (np.concatenate([f[0] for f in found]) if found else left[:0],
            np.concatenate([f[1] for f in found]) if found else left[:0])


def _verify(cosine: float, tables: int, probes: int):
    def group_rows(g: dict) -> pa.RecordBatch | None:
        x = np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * g["dim"] else np.float64) for v in g["vec"]]).astype(np.float64)
        own = np.stack([np.frombuffer(o, np.int64) for o in g["own"]]).reshape(-1, tables, 1 + probes)
        ids, many = np.array(g["id"]), np.array(g["many"])
        i, j = _bucket_links(g["tab"], g["bucket"], np.array(g["side"]), np.array(g["probe"]), ids, many, x, own, cosine)
        if not len(i):
            return None
        links = np.bincount(i, weights=many[j], minlength=len(ids)) + np.bincount(j, weights=many[i], minlength=len(ids))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        labels = np.arange(len(ids))
        _join_labels(labels, place[i], place[j])
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at].astype(np.int64)),
                                           pa.array(ids[order[labels[place[at]]]])], names=["id", "links", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("dim", "tab", "bucket", "ga", "gb", "side", "probe", "id", "many", "vec", "own")}
            for r in range(batch.num_rows):
                now = (cols["dim"][r], cols["tab"][r], cols["bucket"][r], cols["ga"][r], cols["gb"][r])
                if now != key:
                    if held is not None and len(held["id"]) > 1:
                        out = group_rows(held)
                        if out is not None:
                            yield out
                    key = now
                    held = {"dim": now[0], "tab": now[1], "bucket": now[2],
                            "side": [], "probe": [], "id": [], "many": [], "vec": [], "own": []}
                for n in ("side", "probe", "id", "many", "vec", "own"):
                    held[n].append(cols[n][r])
        if held is not None and len(held["id"]) > 1:
            out = group_rows(held)
            if out is not None:
                yield out
    return run


def vector_links(reps: DataFrame, cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES,
                 probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(id, links, low): per task group, the linked vectors of ``reps`` (id, many, vec), how many
    vectors they link with there, and the least id of their chain of links there."""
    routed = reps.mapInArrow(_route(tables, hashes, probes), ROUTED)
    routed = materialise(routed, "routed")
    key = ["dim", "tab", "bucket"]
    # buckets with one entry, or with probes only, have no pair
    sizes = (routed.groupBy(*[F.col(k).alias(f"{k}_s") for k in key])
             .agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("p")).where("n > 1 AND p = 0")
             .withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n", "p"))
    dealt = (routed.join(sizes, [F.col(k) == F.col(f"{k}_s") for k in key]).drop(*[f"{k}_s" for k in key])
             .withColumn("mine", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("ga", F.least("mine", "other")).withColumn("gb", F.greatest("mine", "other"))
             .withColumn("side", (F.col("mine") > F.col("other")).cast("int")).drop("mine", "other", "blocks"))
    order = [*key, "ga", "gb"]
    dealt = dealt.repartition(shuffle_partitions(reps.sparkSession), *order).sortWithinPartitions(*order, "side")
    return dealt.mapInArrow(_verify(cosine, tables, probes), "id long, links long, low long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE,
                 tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """One row per input row: the id, ``n_links`` (other rows found with ``cosine`` or more),
    ``component_id`` (smallest id reachable over links) and ``kept`` (it is its own component).

    Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing;
    vectors of different lengths never link.  Equal vectors link with each other.  Ids are
    integers; rows that share an id and a vector are copies of each other.  Other columns play
    no part; an empty table gives an empty result."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    fine = (v.isNotNull() & (F.size(v) > 0)
            & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
            & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    good = rows.where(fine).withColumn("h", F.xxhash64("v"))
    reps = materialise(good.groupBy("h", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("many")), "vectors")
    links = materialise(vector_links(reps.select("id", "many", "v"), cosine, tables, hashes, probes), "vector-links")
    degree = links.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("id").alias("a"), F.col("low").alias("b")))
    of = (reps.join(degree.withColumnRenamed("id", "i1"), F.col("id") == F.col("i1"), "left")
          .join(roots, F.col("id") == F.col("node"), "left")
          .select("h", "v", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
                  F.coalesce("root", "id").alias("component_id")))
    of = materialise(of, "vector-groups").withColumnsRenamed({"h": "h2", "v": "v2"})
    linked = good.join(of, (F.col("h") == F.col("h2")) & (F.col("v") == F.col("v2"))).select("id", "n_links", "component_id")
    alone = rows.where(~fine).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
