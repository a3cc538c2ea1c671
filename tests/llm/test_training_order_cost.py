"""Shards are dealt by their number, in one pass over the slots; the encoder's quick look at a text."""
import numpy as np
from pyspark.sql.classic.dataframe import DataFrame

from tidewell.llm import tokenizing, training_order


def test_shards_need_no_pass_for_range_bounds(spark, tmp_path, monkeypatch):
    def refused(*a, **b):
        raise AssertionError("a range partitioning reads all slots once more")

    monkeypatch.setattr(DataFrame, "repartitionByRange", refused)
    docs = spark.createDataFrame([(i, f"some words {i} of a text " * (i % 40)) for i in range(200)], "doc_id long, text string")
    path = str(tmp_path / "shards")
    shape = training_order.write_training_order(docs, path, length=64, per_shard=16)
    got = sorted(tuple(r) for r in training_order.slot_digests(spark, path, shape).select("slot", "shard", "sequence").collect())
    n = shape["sequences"]
    assert n > 64 and [r[0] for r in got] == list(range(n)) and all(r[1] == r[0] // 16 for r in got)
    assert [r[0] for r in sorted(got, key=lambda r: r[2])] == training_order.feistel_slots(np.arange(n), n).tolist()
    assert training_order.shard_files(spark, path).count() == -(-n // 16)


def test_quick_look_meets_what_the_pattern_meets():
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x10400)]):
        for text in (c, "plain " + c, "é" + c + "€"):
            assert tokenizing._outside(text) == bool(tokenizing.OUTSIDE.search(text))
