"""What a worker holds at once while it counts lexicon entries."""
import tracemalloc

import numpy as np
import pyarrow as pa

from tidewell.llm import tokenizing, toxicity


def test_text_slices_are_the_ranges_of_slices():
    texts = ["a" * n for n in (3, 0, 5, 9, 1, 1, 20, 0)] + [None, "ä€𝄞"]
    for size in (1, 4, 5, 10, 100):
        got = [(a, a + len(x), x) for a, x in tokenizing.text_slices(pa.array(texts), size)]
        assert got == [(a, z, texts[a:z]) for a, z in tokenizing.slices(texts, size)]
    assert list(tokenizing.text_slices(pa.array([], pa.string()))) == []


def test_entry_counts_hold_a_bounded_table():
    texts = [" ".join(f"w{i:05d}x{k:03d}" for k in range(150)) for i in range(3000)]
    batch = pa.record_batch([pa.array(texts), pa.array([i % 5 for i in range(3000)], pa.int32())], names=["text", "fold"])
    texts = None
    for slots, most in ((None, 110), (np.zeros(1 << 10, bool), 30)):  # MB
        tracemalloc.start()
        n = sum(out.column(0).value_counts().field("counts").to_numpy().sum()
                for out in toxicity.count_entries(iter([batch]), slots))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most << 20
        assert n > 0


def test_entry_counts_are_whole_across_flushes(monkeypatch):
    texts = [f"one two{i} three{i % 7}" for i in range(200)]
    batch = pa.record_batch([pa.array(texts), pa.array([i % 5 for i in range(200)], pa.int32())], names=["text", "fold"])

    def total():
        held = {}
        for out in toxicity.count_entries(iter([batch, batch]), None):
            for row in zip(*[c.to_pylist() for c in out.columns]):
                held[row[0]] = [x + y for x, y in zip(held.get(row[0], [0] * 5), row[1:])]
        return held

    whole = total()
    monkeypatch.setattr(toxicity, "ENTRIES", 1)
    assert total() == whole and whole[""] == [80] * 5
