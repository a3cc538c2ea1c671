import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_dedup import brute_fingerprint, norm, union
from tidewell.llm import mixing, packing, quality, tokenizing, training_order
from tidewell.llm.common import materialise, read_table, remove_written, scratch_folder


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(spark, tok, odd):
    with open(tokenizing.default_vocabulary(), "rb") as f:
        enc = tokenizing.Encoder(f.read())
    texts = [r.text for r in read_table(spark, SMALL, "documents").collect()] + [r.text for r in odd.collect()]
    texts += ["<|endoftext|> it's 'S 'sandwich ''s don't", "a b c\x1cd\x85e", "é İI ıſ ΑΣ ς σ Ǆ", "x‍😀️ 12³½ ⅷ", "ﬁ ß ẞ", "\x00\x01"]
    # every character near and in the range of the pattern scan, alone and inside words
    near = [chr(i) for r in (range(1, 0x260), range(0x2000, 0x2070), range(0x20a0, 0x20c1)) for i in r]
    texts += [t for c in near for t in (c, f"a{c}b", f"'{c}s I'll {c}{c} x1{c}2")]
    for _ in range(2):  # the second time from the tables
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode_many(texts)] == [tok(t) for t in texts]


def test_packing_round_trip(spark, odd, none, tok):
    docs = odd.where("doc_id is null or doc_id != 8")  # repeated rows apart, below
    rows = packing.pack(docs, length=64, with_ids=True)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]
    got = rows.collect()
    want = {r.doc_id: np.array([*tok(r.text), 1], "<u4") for r in docs.collect()}
    by = defaultdict(list)
    for g in got:
        ids = want[g.doc_id][g.start:g.start + g.length]
        assert (len(ids), g.doc_tokens, g.ids_crc32) == (g.length, len(want[g.doc_id]), zlib.crc32(ids.tobytes()))
        by[g.doc_id].append((g.start, g.length))
    for i, ids in want.items():
        at = 0
        for start, size in sorted(by[i]):
            assert start == at
            at += size
        assert at == len(ids)
    seqs = defaultdict(list)
    for g in got:
        seqs[g.sequence_id].append((g.offset, g.length, g.ids))
    assert sorted(seqs) == list(range(len(seqs)))
    whole = {r.sequence_id: r for r in packing.sequences(materialise(rows, "t"), 64).collect()}
    for s, parts in seqs.items():
        at = 0
        for offset, size, _ in sorted(parts):
            assert offset == at
            at += size
        assert at <= 64
        raw = b"".join(bytes(p[2]) for p in sorted(parts))
        padded = at if at & (at - 1) == 0 else 64
        assert bytes(whole[s].ids) == raw + b"\0" * 4 * (padded - at) and whole[s].n_tokens == at
    assert packing.pack(none).count() == 0
    twice = packing.pack(odd, length=64).where("doc_id = 8").collect()
    assert len(twice) == 2 and len({(t.sequence_id, t.offset) for t in twice}) == 2


def test_shortest_pack_first_places_every_length_once():
    rng = np.random.default_rng(8)
    for _ in range(30):
        hist = {int(k): int(rng.integers(1, 400)) for k in rng.choice(np.arange(1, 65), rng.integers(1, 40), replace=False)}
        plan = packing.shortest_pack_first(hist, 64)
        fill, ranks = defaultdict(list), Counter()
        for i, (size, rank, first, offset) in enumerate(plan):
            end = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == size else hist[size]
            for r in range(rank, end):
                fill[first + r - rank].append((offset, size))
                ranks[size] += 1
        assert dict(ranks) == hist and sorted(fill) == list(range(len(fill)))
        for parts in fill.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at <= 64
    many = {k: 1000 for k in range(1, 65)}
    plan = packing.shortest_pack_first(many, 64)
    assert len(plan) < 4000
    packs = max(first for _, _, first, _ in plan)
    assert packs < 1.08 * sum(k * n for k, n in many.items()) / 64


def test_mixing_follows_the_poisson_inverse(spark, odd, none):
    weights = {"s0": 3.0, None: 1.0}
    got = mixing.mix(odd, weights)
    assert got.columns == [c for c in odd.columns if c != "copies"] + ["copy", "shuffle_key"]
    rates = {r.source: r.rate for r in mixing.repetition_rates(odd, weights).collect()}
    chars = Counter()
    for r in odd.collect():
        chars[r.source] += len(r.text or "")
    total = sum(chars.values())
    assert rates["s0"] == pytest.approx(0.75 * total / chars["s0"])
    seen = Counter((g.doc_id, g.text) for g in got.collect())
    import hashlib
    for r, times in Counter((r.doc_id, r.text, r.source) for r in odd.collect()).items():
        n = 0
        parts = max(1, math.ceil(rates[r[2]] / mixing.PART))
        lam = rates[r[2]] / parts
        for part in range(parts):
            h = hashlib.md5(f"{mixing.SEED}:{'' if r[0] is None else r[0]}:{part}".encode()).hexdigest()
            u, k, p = (int(h[:13], 16) + 0.5) / 2 ** 52, 0, math.exp(-lam)
            c = p
            while c < u:
                k += 1
                p *= lam / k
                c += p
            n += k
        assert seen[(r[0], r[1])] == n * times
    keys = [r.shuffle_key for r in got.collect()]
    assert keys == sorted(keys) and len(set(keys)) >= len(keys) - 12
    assert mixing.mix(none).count() == 0


def test_mixing_shares_and_large_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"),
                                    F.when(F.col("id") < 40, "rare").otherwise("hot").alias("source"))
    got = {r.source: r.n for r in mixing.mix(docs, {"rare": 1, "hot": 1}).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got["rare"] == pytest.approx(2000, rel=0.1) and got["hot"] == pytest.approx(2000, rel=0.1)
    assert {r.source for r in mixing.mix(docs, {"hot": 1}).select("source").distinct().collect()} == {"hot"}


@pytest.mark.parametrize("count", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_keyed_permutation(count):
    x = np.arange(count)
    slots = training_order.feistel_slots(x, count)
    assert sorted(slots.tolist()) == x.tolist()
    assert np.array_equal(training_order.feistel_slots(slots, count, inverse=True), x)
    if count >= 64:
        assert not np.array_equal(slots, training_order.feistel_slots(x, count, key=9))
        assert abs(np.corrcoef(x, slots)[0, 1]) < 0.2


def test_shards_round_trip_and_resume(spark, odd, none, tok):
    path = scratch_folder(spark, "test-shards")
    docs = read_table(spark, SMALL, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    shape = training_order.write_training_order(docs, path, length=128, per_shard=32)
    files = training_order.shard_files(spark, path).collect()
    assert all(len(f.content) % shape["stride"] == 0 for f in files) and len({f.shard for f in files}) == len(files)
    read = list(training_order.read_slots(spark, path, shape))
    assert [r[0] for r in read] == list(range(shape["sequences"]))
    slots = training_order.feistel_slots(np.array([r[1] for r in read]), shape["sequences"])
    assert slots.tolist() == list(range(shape["sequences"]))
    texts = Counter()
    ids = np.concatenate([r[2] for r in sorted(read, key=lambda r: r[1])])
    for part in np.split(ids, np.flatnonzero(ids == 1) + 1):
        texts[tuple(part.tolist())] += 1
    want = Counter((*tok(r.text), 1) for r in docs.collect())
    texts.pop((), None)
    assert texts == want
    again = list(training_order.read_slots(spark, path, shape, first=50))
    assert [a[0] for a in again] == list(range(50, shape["sequences"])) and np.array_equal(again[0][2], read[50][2])
    digest = {r.slot: r for r in training_order.slot_digests(spark, path, shape).collect()}
    assert all(digest[s].sequence == q and digest[s].n_tokens == len(x) and digest[s].ids_crc32 == zlib.crc32(x.tobytes())
               for s, q, x in read)
    empty = training_order.write_training_order(none, scratch_folder(spark, "no-shards"), length=128)
    assert empty["sequences"] == 0 and training_order.slot_digests(spark, "", empty).count() == 0


def test_pipeline_stages_by_brute_force(spark, tok):
    docs = read_table(spark, SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact", "near", "mixing", "packing"]
    held = {"in": materialise(docs, "t")}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = held[name] = materialise(stage(spark, now, SMALL), "t")
        if name != "packing":
            assert now.columns == docs.columns
    rows = {n: df.collect() for n, df in held.items()}
    model = quality.fit_quality(docs, read_table(spark, SMALL, "labels"))
    good = {r.doc_id for r in quality.score_quality(docs, model).where("score >= 0.3").collect()}
    assert {r.doc_id for r in rows["quality"]} == good
    best = {}
    for r in rows["quality"]:
        k = norm(r.text)
        best[k] = min(best.get(k, (0, 1 << 60)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in rows["exact"]) == sorted(i for _, i in best.values())
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows["exact"]}
    ids = sorted(fps)
    root = union([(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (fps[a] ^ fps[b]).bit_count() <= 4], ids)
    assert sorted(r.doc_id for r in rows["near"]) == sorted(set(root.values()))
    assert {r.doc_id for r in rows["mixing"]} <= {r.doc_id for r in rows["near"]}
    size = {r.doc_id: len(tok(r.text)) + 1 for r in rows["near"]}
    assert sum(r.length for r in rows["packing"]) == sum(size[r.doc_id] for r in rows["mixing"])
    assert corpus_pipeline.run(spark, SMALL).count() == len(rows["packing"])


def test_written_tables_are_removed(spark):
    path = materialise(spark.range(3), "gone").inputFiles()[0]
    remove_written()
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
