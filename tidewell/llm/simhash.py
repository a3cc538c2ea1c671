"""SimHash near-duplicates: fingerprints, and links by BK-trees.

A fingerprint is the bitwise majority of the XXH64 of a text's word shingles.  Equal
fingerprints collapse to one node first.  Two fingerprints within ``max_distance`` bits agree
in at least one of the chosen block sets (pigeonhole), so each fingerprint is sent to the
shards of its block values, and every shard holds a BK-tree: children hang below their
parent by integer Hamming distance, and a search follows only the edges within the radius.
A shard has at most about ``SHARD`` fingerprints; the members of a larger bucket are dealt
into several shards and each shard tree is sent to every block of its bucket's queries.
Shard trees travel through the shuffle to the blocks that can match instead of to every
executor: their number grows with the data, so a broadcast of all would have no bound.

A shard reports only a spanning set of links (each member with the least member linked to
it), never all pairs; connected components join these across shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ROW, materialise, packed, shuffle_partitions, text_of, unpacked
from tidewell.llm.components import components

SHINGLE = 4
MAX_DISTANCE = 4
SHARD = 2048
#: query × tree cells that one step of a search may hold
CELLS = 1 << 20
_BITS = 64


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer.  Fewer words than a shingle: the whole
    sequence is one shingle; no words (empty or NULL): zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        hashes = [h(joined[a:z], 42) for a, z in zip((ends - size).tolist(), ends[shingle - 1:].tolist())]
    bits = np.zeros(_BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at:at + (1 << 16)], "<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", carry=("doc_id",),
                 shingle: int = SHINGLE) -> DataFrame:
    """``carry`` and ``fp`` (the fingerprint's bits as a signed long).  Whole texts; each text
    is one value of one task, whatever its length."""
    carry = [c for c in carry if c != "fp"]
    src = docs.select(packed(docs, carry), text_of(f"`{text_col}`").alias("__tw_text"))
    schema = src.drop("__tw_text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint_of(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[ROW, "fp"])

    return src.mapInArrow(run, schema).select(*unpacked(carry), "fp")


# ---- block keys -----------------------------------------------------------------------

def block_sets(max_distance: int, nodes: int) -> list[list[tuple[int, int]]]:
    """Sets of (first bit, width) of which any two fingerprints within ``max_distance`` share
    one.  With max_distance + s blocks, every s of them form a set: each step of s halves the
    bits left to chance, so that buckets stay near a thousand nodes.  Exact for every s."""
    s = 1
    while s < 3 and nodes / 2 ** (s * _BITS / (max_distance + s)) > SHARD / 2:
        s += 1
    cuts = np.linspace(0, _BITS, max_distance + s + 1).astype(int).tolist()
    blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    return [list(c) for c in combinations(blocks, s)]


def _keys(fp, sets):
    """One long per block set: a hash of the set's number and the bits of its blocks."""
    def bits(at, width):
        return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
    return F.array(*[F.xxhash64(F.lit(i), *[bits(a, w) for a, w in blocks]) for i, blocks in enumerate(sets)])


# ---- BK-trees -------------------------------------------------------------------------

def bk_forest(keys: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Children table of many BK-trees at once: ``child[node, distance]`` or -1.

    ``keys`` are distinct within a tree; ``root[i]`` is the index of the first item of i's
    tree.  All trees grow level by level: an item compares itself with its current node and
    becomes that node's child at this distance, or moves on to the child that is there.
    """
    child = np.full((len(keys), _BITS + 1), -1, np.int32)
    at = root.astype(np.int64)
    live = np.flatnonzero(at != np.arange(len(keys)))
    while len(live):
        d = np.bitwise_count(keys[live] ^ keys[at[live]]).astype(np.int64)
        code = at[live] * (_BITS + 1) + d
        _, first, group = np.unique(code, return_index=True, return_inverse=True)
        new = live[first]
        child.reshape(-1)[code[first]] = new
        at[live] = new[group]
        live = live[at[live] != live]
    return child


def bk_search(keys: np.ndarray, child: np.ndarray, queries: np.ndarray, start: np.ndarray,
              radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query numbers, nodes) within ``radius``; follows only edges whose distance differs
    from the query's distance to the node by the radius at most."""
    q, node = np.arange(len(queries)), start
    edges = np.arange(-radius, radius + 1)
    while len(q):
        d = np.bitwise_count(queries[q] ^ keys[node]).astype(np.int64)
        hit = d <= radius
        if hit.any():
            yield q[hit], node[hit]
        to = d[:, None] + edges
        nxt = np.where((to >= 0) & (to <= _BITS), child[node[:, None], np.clip(to, 0, _BITS)], -1)
        at, col = np.nonzero(nxt >= 0)
        q, node = q[at], nxt[at, col]


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the sets of a[i] and b[i]; ``labels`` end as the least item of each set."""
    while True:
        la, lb = labels[a], labels[b]
        if (la == lb).all():
            return
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _search_rows(group: np.ndarray, fp: np.ndarray, query_only: np.ndarray, radius: int):
    """Links of whole groups (sorted by group, tree members before query-only members)."""
    keys = fp.view(np.uint64)
    n = len(keys)
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
    size = np.diff(np.r_[first, n])
    root = np.repeat(first, size)
    asked = ~np.repeat(np.logical_or.reduceat(query_only, first), size) | query_only
    root_is_tree = ~query_only[root]
    inside = ~query_only
    child = np.full((n, _BITS + 1), -1, np.int32)
    tree = np.flatnonzero(inside)
    renum = np.cumsum(inside) - 1
    sub = bk_forest(keys[tree], renum[root[tree]])
    child[tree] = np.where(sub >= 0, tree[np.maximum(sub, 0)], -1)
    labels = np.arange(n)
    ask = np.flatnonzero(asked & root_is_tree)
    cost = np.cumsum(np.repeat(size, size)[ask])
    at = 0
    while at < len(ask):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + CELLS)))
        part = ask[at:to]
        for q, node in bk_search(keys, child, keys[part], root[part], radius):
            _join_labels(labels, part[q], node)
        at = to
    low = np.flatnonzero(labels != np.arange(n))
    return fp[low], fp[labels[low]]


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "ga", "gb", "query_only", "fp"]

        def flush(cols):
            group = np.stack([cols[0], cols[1], cols[2]], axis=1)
            a, b = _search_rows(group, cols[4], cols[3].astype(bool), radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            got = [batch.column(n).cast(pa.int64()).to_numpy(zero_copy_only=False) for n in names]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got)]
            if len(held[0]) >= 1 << 15:  # whole groups only: the last one may go on
                last = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
                cut = len(last) - int(last.sum())
                if cut:
                    yield flush([x[:cut] for x in held])
                    held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield flush(held)
    return run


def fingerprint_links(nodes: DataFrame, max_distance: int = MAX_DISTANCE, shard: int = SHARD) -> DataFrame:
    """(a, b): links that span every component of the distinct fingerprints ``nodes.fp`` under
    "at most ``max_distance`` differing bits".  No link is lost and none is added: every
    reported link joins fingerprints that a chain of such pairs joins."""
    spark = nodes.sparkSession
    sets = block_sets(max_distance, nodes.count())
    routed = nodes.select("fp", F.explode(_keys(F.col("fp"), sets)).alias("key"))
    shards = (routed.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("k", F.ceil(F.col("n") / shard).cast("int").alias("shards")))
    mine = F.pmod(F.xxhash64("fp", F.lit("shard")), F.col("shards")).cast("int")
    dealt = (routed.join(shards, F.col("key") == F.col("k")).withColumn("mine", mine)
             .select("key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other"))
             .select("key", F.least("mine", "other").alias("ga"), F.greatest("mine", "other").alias("gb"),
                     (F.col("mine") > F.col("other")).cast("int").alias("query_only"), "fp"))
    parts = shuffle_partitions(spark)
    dealt = dealt.repartition(parts, "key", "ga", "gb").sortWithinPartitions("key", "ga", "gb", "query_only", "fp")
    return dealt.mapInArrow(_search(max_distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per input row: the id, ``text_hash`` (XXH64 of the text as it is), ``fp`` and
    ``component_id``, the smallest id reachable over links of ``max_distance`` bits at most.

    NULL and empty texts have fingerprint zero and are linked like any other; repeated rows
    and ties share a fingerprint and so a component; NULL ids are never the smallest unless
    alone (then the component is NULL).  An empty table gives an empty result.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("__tw_id"), F.xxhash64(text_of(f"`{text_col}`")).alias("text_hash"),
                       F.col(f"`{text_col}`").alias("__tw_text"))
    marked = materialise(fingerprints(slim, "__tw_text", ["__tw_id", "text_hash"], shingle), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("__tw_id").alias("first"))
    links = materialise(fingerprint_links(nodes, max_distance), "links")
    roots = components(links)
    of = (nodes.join(roots, F.col("fp") == F.col("node"), "left")
          .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    best = of.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    of = materialise(of.join(best, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), "groups")
    return (marked.join(of, F.col("fp") == F.col("f"))
            .select(F.col("__tw_id").alias(id_col), "text_hash", "fp", "component_id"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                  max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The row with the smallest id of each component, with the columns of ``docs``.

    Rows that agree in id and text are one document and leave one row."""
    found = near_duplicates(docs, id_col, text_col, shingle, max_distance)
    keep = (found.where(F.col(id_col).eqNullSafe(F.col("component_id")))
            .select(F.col(id_col).alias("__tw_k"), F.col("text_hash").alias("__tw_h")).distinct())
    own = docs.withColumn("__tw_th", F.xxhash64(text_of(f"`{text_col}`")))
    return (own.join(keep, F.col(f"`{id_col}`").eqNullSafe(F.col("__tw_k")) & (F.col("__tw_th") == F.col("__tw_h")), "left_semi")
            .dropDuplicates([id_col, "__tw_th"]).select(*[F.col(f"`{c}`") for c in docs.columns]))
