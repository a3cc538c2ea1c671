import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import MEDIUM, SMALL
from tidewell.llm import components, embeddings, exact, simhash
from tidewell.llm.common import read_table


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def union(pairs, nodes):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact_brute_force(spark, odd, none):
    got = exact.mark_copies(odd, carry=["doc_id", "text", "kept"]).collect()
    assert exact.mark_copies(odd, carry=["doc_id", "kept"]).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = odd.collect()
    groups = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append(r)
    assert len(got) == len(rows)
    for g in got:
        same = groups[norm(g.text)]
        best = min(same, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        assert (g.keep_id, g.group_size) == (best.doc_id, len(same))
        assert g.text_sha256 == hashlib.sha256(norm(g.text).encode()).hexdigest()
    kept = exact.exact_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted(groups)
    assert exact.mark_copies(none).count() == 0 == exact.exact_dedup(none).count()


def test_exact_hot_group_is_sliced(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.concat(
        F.lit("hot text"), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int")))).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = exact.mark_copies(rows)
    hot = got.where("group_size > 1")
    assert hot.count() == 2000 and hot.select("keep_id").distinct().collect()[0][0] == 4
    assert got.where("kept").count() == 1001


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_is_majority_of_shingle_hashes(odd):
    for r in odd.collect():
        assert simhash.fingerprint_of(r.text) == brute_fingerprint(r.text)


def test_simhash_brute_force(spark, odd, none):
    docs = read_table(spark, SMALL, "documents").select("doc_id", "text").unionByName(
        odd.where("doc_id is not null").select((F.col("doc_id") + 100000).alias("doc_id"), "text"))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    fps = {}
    for r in got:
        fps.setdefault(r.fp & (2 ** 64 - 1), []).append(r.doc_id)
    keys = sorted(fps)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if (a ^ b).bit_count() <= 4]
    root = union(pairs, keys)
    least = {}
    for k in keys:
        least[root[k]] = min(least.get(root[k], 1 << 60), min(fps[k]))
    assert all(r.component_id == least[root[r.fp & (2 ** 64 - 1)]] for r in got)
    kept = simhash.simhash_dedup(odd)
    assert kept.columns == odd.columns
    assert simhash.near_duplicates(none).count() == 0 == simhash.simhash_dedup(none).count()
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert 8 in ids and 9 not in ids and ids.count(8) == 1  # copies, other case, and the repeated row


def test_links_over_shards_and_block_sets(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(30)]
    keys = {c for c in centres}
    for c in centres:
        for _ in range(40):
            keys.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    keys = sorted(keys)
    signed = np.array(keys, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(k,) for k in signed], "fp long")
    want = union([(a, b) for i, a in enumerate(signed) for b in signed[i + 1:]
                  if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 4], signed)
    links = [(r.a, r.b) for r in simhash.fingerprint_links(nodes, shard=16).collect()]
    assert union(links, signed) == want
    for many in (10, 10 ** 8, 10 ** 12):  # every choice of block sets is exact
        sets = simhash.block_sets(4, many)
        assert sum(w for s in sets[:1] for _, w in s) >= 12
        for a, b in [(signed[i], signed[j]) for i in range(0, 400, 7) for j in range(i + 1, 400, 11)]:
            x = (a ^ b) & (2 ** 64 - 1)
            if x.bit_count() <= 4:
                assert any(all(not x >> p & ((1 << w) - 1) for p, w in s) for s in sets)


def test_components_of_path_star_and_loops(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    want = union(pairs, {x for p in pairs for x in p})
    assert {r.node: r.root for r in got} == {n: r for n, r in want.items() if n != r}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, cosine=0.95):
    fine = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(fine)
    pairs = []
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            a, b = fine[i], fine[j]
            if len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                pairs.append((i, j))
    return pairs, [i for i, _ in rows]


def test_vectors_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, at = [], 0
    for _ in range(25):
        c = rng.normal(size=32)
        for _ in range(12):
            rows.append((at, (c + rng.normal(size=32) * rng.choice([0.05, 0.2])).astype(np.float32).tolist()))
            at += 1
    rows += [(at + i, rows[0][1]) for i in range(5)]
    at += 5
    rows += [(at, None), (at + 1, []), (at + 2, [0.0] * 32), (at + 3, [float("nan")] + [1.0] * 31), (at + 4, [None] + [1.0] * 31),
             (at + 5, [float("inf")] + [1.0] * 31), (at + 6, [1.0, 2.0, 3.0]), (at + 7, [2.0, 4.0, 6.0])]
    df = spark.createDataFrame([(*r, 3, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    pairs, ids = brute_vectors(rows)
    assert sorted(got) == sorted(ids)
    found = sum(r.n_links for r in got.values()) / 2
    assert 0.95 * len(pairs) <= found <= len(pairs)
    degree = dict.fromkeys(ids, 0)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    assert all(got[i].n_links <= degree[i] for i in ids)
    root = union(pairs, ids)
    assert sum(got[i].component_id == root[i] for i in ids) >= 0.97 * len(ids)
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    for i in range(at, at + 6):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[at + 7].component_id == at + 6
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_blocks_count_each_pair_once(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=16)
    rows = [(i, 1 + i % 3, (c + rng.normal(size=16) * 0.1).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, many long, v array<double>")
    got = {}
    for r in embeddings.vector_links(df, tables=4, block=16).collect():
        got[r.id] = got.get(r.id, 0) + r.links
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = near @ np.array([r[1] for r in rows])
    assert all(got.get(i, 0) <= want[i] for i in range(150))
    assert sum(got.values()) >= 0.9 * want.sum()


def test_hadamard_is_orthogonal():
    h = embeddings.hadamard(np.eye(16))
    assert np.array_equal(h @ h.T, 16 * np.eye(16))


@pytest.mark.parametrize("sf", [MEDIUM])
def test_recall_on_the_given_vectors(spark, sf):
    df = read_table(spark, sf, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    pairs, _ = brute_vectors(rows)
    links = embeddings.near_vectors(df).agg(F.sum("n_links")).first()[0] / 2
    assert 0.9 * len(pairs) <= links <= len(pairs)
