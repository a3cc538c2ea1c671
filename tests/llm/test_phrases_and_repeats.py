"""Spelling variants, collocations and repeated windows against brute force."""
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewell.llm import collocations, repeats, spelling
from tidewell.llm.common import read_table

LOWER = {i: i + 32 for i in range(65, 91)}


def texts_of(df):
    return [(r.doc_id, r.lang, r.text) for r in df.collect()]


# ---- repeated windows -----------------------------------------------------------------

def brute_cut(rows, size):
    def rank(i):
        return 1 << 62 if i is None else i
    low = {}
    for i, _, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            w = b[p:p + size]
            low[w] = min(low.get(w, 1 << 63), rank(i))
    out = []
    for i, _, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if low[b[p:p + size]] < rank(i):
                gone[p:p + size] = b"\1" * size
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(b), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def cut(df, **kw):
    return sorted([(r[0], r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in repeats.cut_repeats(df, **kw).collect()], key=str)


@pytest.fixture(scope="module")
def passages(spark):
    rnd = random.Random(5)
    shared = ["".join(rnd.choice("abcdefg é") for _ in range(rnd.randint(20, 250))) for _ in range(12)]
    rows = []
    for i in range(90):
        t = "".join(rnd.choice(shared)[rnd.randint(0, 30):] if rnd.random() < .6 else
                    "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 150))) for _ in range(rnd.randint(0, 5)))
        rows.append((i, "en", t))
    rows += [(200, "en", "a" * 500), (201, "en", "a" * 300 + "b"), (202, "en", "ab" * 200), (203, "en", "ab" * 100 + "c"),
             (None, "en", shared[0] + shared[1]), (None, "en", shared[0]), (5, "en", shared[2]), (5, "en", shared[2])]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)


@pytest.mark.parametrize("size, chunk, block", [(50, 4 << 20, 1 << 16), (50, 2000, 300), (9, 3000, 64), (2, 1 << 20, 64)])
def test_cut_repeats_brute_force(passages, monkeypatch, size, chunk, block):
    for name, v in (("CHUNK", chunk), ("BUCKET", chunk), ("BLOCK", block)):
        monkeypatch.setattr(repeats, name, v)
    assert cut(passages, threshold=size) == brute_cut(texts_of(passages), size)


def test_cut_repeats_odd_inputs(odd, none):
    rows = [(r.doc_id, r.lang, r.text) for r in odd.collect() if len(r.text or "") < 5000]
    small = odd.where("coalesce(length(text), 0) < 5000")
    assert cut(small, threshold=4) == brute_cut(rows, 4)
    # two very long texts with one passage over and over: the second goes as a whole, the first stays
    long = {r.doc_id: r for r in repeats.cut_repeats(odd).collect()}
    assert long[6].spans == [] and len(long[6].kept) == long[6].n_bytes
    assert [tuple(s) for s in long[7].spans] == [(0, long[6].n_bytes)] and bytes(long[7].kept) == b"x"
    assert repeats.cut_repeats(none).count() == 0
    assert repeats.cut_repeats(none.drop("kept").withColumnRenamed("doc_id", "kept"), id_col="kept").columns == ["kept", "n_bytes", "spans", "kept_"]


def test_suffix_runs_depend_on_the_window_alone():
    rnd = random.Random(2)
    a = bytes(rnd.choice(b"abc ") for _ in range(3000))
    for block in (64, 1 << 16):
        repeats.BLOCK, old = block, repeats.BLOCK
        try:
            start, count, anchor, digit = repeats.suffix_runs(a, np.array([1000, 1020, 3000]), 50)
        finally:
            repeats.BLOCK = old
        covered = sorted(p for s, n in zip(start.tolist(), count.tolist()) for p in range(s, s + n))
        assert covered == [*range(951), *range(1020, 2951)]
        by = defaultdict(set)
        for s, n, to, d in zip(start.tolist(), count.tolist(), anchor.tolist(), digit.tolist()):
            for p in range(s, s + n):
                by[a[p:p + 50]].add((to - p, d))
        assert all(len(v) == 1 for v in by.values())


def test_radix_windows_groups():
    buf = np.frombuffer(b"abcdefghijklXabcdefghijkmXabcdefghijkl", np.uint8)
    item, group = repeats.radix_windows(buf, np.array([0, 13, 26]), np.zeros(3, np.int64), 12)
    assert sorted(item.tolist()) == [0, 2] and len(set(group.tolist())) == 1


# ---- spelling variants ----------------------------------------------------------------

def brute_words(rows):
    n = Counter()
    for i, _, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute_variants(words):
    gaps = defaultdict(set)  # a word with one place left out or one place open
    for w in words:
        for i in range(len(w) + 1):
            gaps[0, w[:i], w[i:]].add(w)
            if i < len(w):
                gaps[0, w[:i], w[i + 1:]].add(w)
                gaps[1, w[:i], w[i + 1:]].add(w)
    near = defaultdict(set)
    for (kind, *_), same in gaps.items():
        for a in same:
            near[a] |= {b for b in same if a != b and (kind or len(a) != len(b))}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 2 * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root))
    return sorted(out)


def variants(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


@pytest.mark.parametrize("shard", [20_000, 60])
def test_spelling_variants_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(spelling, "SHARD", shard)
    docs = read_table(spark, SMALL, "documents")
    want = brute_words(texts_of(docs))
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == want
    assert variants(spelling.spelling_variants(docs)) == brute_variants(want)


def test_spelling_on_given_words(spark):
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abcé") for _ in range(rnd.randint(4, 7))): rnd.randint(3, 60) for _ in range(400)}
    words |= {"z" * 70: 9, "z" * 71: 30, "z" * 70 + "y": 3, "z" * 5000: 4, "z" * 5001: 8, "漢字仮名交": 4, "漢字仮名文": 9}
    rows = spark.createDataFrame([(w, k) for w, k in words.items()], "word string, n long")
    assert variants(spelling.group_spellings(rows)) == brute_variants(words)
    # repeated rows add up, NULL and empty words are left out
    twice = rows.unionByName(rows).unionByName(spark.createDataFrame([(None, 5), ("", 5)], "word string, n long"))
    assert variants(spelling.group_spellings(twice)) == brute_variants({w: 2 * k for w, k in words.items()})


def test_spelling_odd_inputs(odd, none):
    want = brute_words(texts_of(odd))
    assert {r.word: r.n for r in spelling.word_counts(odd).collect()} == want
    assert variants(spelling.spelling_variants(odd)) == brute_variants(want)
    assert spelling.spelling_variants(none).count() == 0


def test_one_edit():
    assert spelling.one_edit("abcd", "abd") and spelling.one_edit("abd", "abcd") and spelling.one_edit("abcd", "abxd")
    assert not any(spelling.one_edit(*p) for p in (("abcd", "abcd"), ("abcd", "acbd"), ("abcd", "ab"), ("ab", "ba")))


def test_trie_search_stays_in_budget():
    words = ["stone", "stones", "store", "tones", "notes", "onset", "zzzzz"]
    trie = spelling.Trie(words)
    counts, _ = spelling._letters(["stone"])
    reached = {trie.words[s] for _, part in trie.search(counts) for s in part.tolist()}
    assert reached == {"stone", "stones", "store", "tones", "notes", "onset"}  # same or near letter counts
    assert {words[s] for s in trie.near(["stone"])[1].tolist()} == {"stones", "store"}


# ---- collocations ---------------------------------------------------------------------

def brute_collocations(rows, longest=3, least=10, cover=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q[i:i + m] for q, b in found.items() for m in range(2, len(q)) for i in range(len(q) - m + 1)
                if 100 * b >= cover * found.get(q[i:i + m], 1 << 60)}
        rank = []
        for p, a in found.items():
            if p not in gone:
                s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rank.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, le, ri, n[lang], -s) for r, (s, a, p, le, ri) in enumerate(sorted(rank)[:top])]
    return sorted(out)


@pytest.mark.parametrize("kw", [{}, {"longest": 4, "least": 6, "shards": 2, "top": 30}, {"shards": 1}])
def test_collocations_brute_force(spark, monkeypatch, kw):
    monkeypatch.setattr(collocations, "CHUNK", 30_000)
    monkeypatch.setattr(collocations, "BUCKET", 200_000)
    docs = read_table(spark, SMALL, "documents").repartition(4)
    got = sorted(tuple(r) for r in collocations.collocations(docs, **kw).collect())
    assert got == brute_collocations(texts_of(docs), **{k: v for k, v in kw.items() if k != "shards"}) and len(got) > 50


def test_collocations_with_full_slots_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 30_000)
    monkeypatch.setattr(collocations, "SLOT_BITS", 16)
    real = collocations._slot
    monkeypatch.setattr(collocations, "_slot", lambda h, lang: real(h, lang) & 63)  # nearly every phrase shares a slot
    table = collocations._slot(np.arange(5, dtype=np.uint64), "en")
    assert table.max() < 64
    ids, words, end = collocations._words(collocations.normalised(b"a b a b, a"))
    slots = {1: np.full(1 << 16, collocations._NEVER, np.uint8)}
    slots[1][:64] = 0
    found = {k: [(" ".join(words[int(p[i])].as_py().decode() for p in parts), int(m)) for i, m in enumerate(n)]
             for k, parts, n, _ in collocations.active_phrases(ids, words, end, "en", 1, 3, 3, slots)}
    assert sorted(found[2]) == [("a b", 2), ("b a", 1)]


def test_collocations_odd_inputs(odd, none):
    got = sorted(tuple(r) for r in collocations.collocations(odd, least=2).collect())
    assert got == brute_collocations(texts_of(odd), least=2) and got
    assert collocations.collocations(none).count() == 0
    assert odd.where(F.col("lang").isNull()).count() == 1  # counted as "und"
