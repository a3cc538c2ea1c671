import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import MEDIUM
from tidewell.llm import language_model as lm
from tidewell.llm import queries, quality, secrets, toxicity
from tidewell.llm.common import read_table


def held(i, mod=5):
    return zlib.crc32(str(i).encode()) % mod == 0


@pytest.mark.parametrize("name,label,least", [("op2_quality_rules", "quality", 0.97), ("op1_toxicity", "toxic", 0.8)])
def test_held_out_accuracy(spark, name, label, least):
    rows = queries.QUERIES[name](spark, MEDIUM).collect()
    labels = {r.doc_id: r[label] for r in read_table(spark, MEDIUM, "labels").collect()}
    assert len(rows) == read_table(spark, MEDIUM, "documents").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    pos = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 1]
    neg = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 0]
    auc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    assert auc >= least


def label_rows(spark, n, both=True):
    rows = [(i, int(i % 4 != 0) if both else 1, int(i % 4 == 0) if both else 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_on_odd_rows(spark, odd, none):
    train = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.repeat(F.lit("BAD!! "), 30)).otherwise(
        F.concat_ws(" ", F.lit("Plain words go on and on."), "id")).alias("text"))
    model = quality.fit_quality(train, label_rows(spark, 200))
    assert model.rules
    scored = quality.score_quality(odd, model)
    assert scored.columns == [c for c in odd.columns if c != "score"] + ["score"]
    assert all(0 <= r.score <= 1 for r in scored.collect()) and scored.count() == odd.count()
    assert quality.score_quality(none, model).count() == 0
    bad = quality.score_quality(train, model).where("(score >= 0.3) != (doc_id % 4 != 0)")
    assert bad.count() == 0
    kept = quality.keep_quality(odd, label_rows(spark, 12, both=False))
    assert kept.columns == odd.columns and kept.count() == odd.count()  # one class only: nothing to reject
    assert quality.fit_quality(none.select("doc_id", "text"), label_rows(spark, 3)).score is not None


def test_rules_are_the_models_paths(spark):
    rule = quality.Rule(quality._tidy((("a", True, 1.0), ("a", True, 2.0), ("b", False, 3.0), ("b", False, 2.5))), 1.5)
    assert rule.terms == (("a", True, 2.0), ("b", False, 2.5))
    model = quality.RuleModel((rule,), -0.5)
    got = spark.createDataFrame([(3.0, 1.0), (2.0, 1.0), (3.0, 3.0)], "a double, b double").select(model.score().alias("p")).collect()
    assert [round(r.p, 9) for r in got] == [round(1 / (1 + math.exp(-m)), 9) for m in (1.0, -0.5, -0.5)]


def test_toxicity_on_odd_rows(spark, odd, none):
    train = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.concat_ws(
        " ", F.lit("you are such a wretch, you wretch"), "id")).otherwise(F.concat_ws(" ", F.lit("a calm line about tea"), "id")).alias("text"))
    model = toxicity.fit_toxicity(train, label_rows(spark, 400))
    assert any("wretch" in e for e in model.lexicon)
    scored = toxicity.score_toxicity(odd, model, carry=odd.columns)
    assert scored.columns == [c for c in odd.columns if c != "score"] + ["score"]
    assert scored.count() == odd.count() and all(0 <= r.score <= 1 for r in scored.collect())
    assert toxicity.score_toxicity(none, model).count() == 0
    wrong = toxicity.score_toxicity(train, model).where("(score >= 0.5) != (doc_id % 4 == 0)")
    assert wrong.count() == 0
    flat = toxicity.fit_toxicity(train, label_rows(spark, 30, both=False))
    assert {r.score for r in toxicity.score_toxicity(odd, flat).collect()} == {flat.values[0]}


def test_lexicon_counts_all_labelled_rows(spark):
    words = ["".join(chr(97 + int(ch, 16)) for ch in hashlib.md5(str(k).encode()).hexdigest()[:9]) for k in range(50)]
    texts = [(i, f"a calm line about tea {i}" + (f" {words[i // 4 % 50]}" if i % 4 == 0 else "")) for i in range(4000)]
    model = toxicity.fit_toxicity(spark.createDataFrame(texts, "doc_id long, text string"), label_rows(spark, 4000), fit_rows=400)
    assert set(words) <= set(model.lexicon)  # about 16 texts each, one or two of them in the sample


def test_lexicon_of_a_fold_leaves_it_out(spark):
    rows = [("nasty" if i % 2 else "calm", i % 2, i // 2 % toxicity.FOLDS) for i in range(40)] + [("vile", 1, 2)] * 9
    rows = spark.createDataFrame(rows, "text string, label int, fold int")
    counts = {r.entry: r for r in toxicity.candidate_counts(rows).collect()}
    assert (counts[""].t, counts[""].c, counts["vile"].t, counts["vile"].t2, counts["nasty"].t, counts["nasty"].t1) == (29, 20, 9, 9, 20, 4)
    whole, others = toxicity.learn_lexicons(rows)
    assert "vile" in whole and ["vile" in x for x in others] == [True, True, False, True, True]


def test_entries_of_shared_slots(spark):
    """Counts do not depend on the number of slots: entries that share one drop out in the join."""
    rows = [(f"bad{i % 3} word{i % 7} calm", i % 2, i % toxicity.FOLDS) for i in range(90)]
    rows = spark.createDataFrame(rows, "text string, label int, fold int")
    plain = {}
    for r in rows.collect():
        for e in {e for w in r.text.split() for e in toxicity._entries(w)} | {""}:
            at = plain.setdefault(e, [[0] * toxicity.FOLDS, [0] * toxicity.FOLDS])
            at[1 - r.label][r.fold] += 1
    want = {e: (sum(t), sum(c), *[x for p in zip(t, c) for x in p]) for e, (t, c) in plain.items()
            if sum(t) >= toxicity.LEAST_TEXTS}
    for n in (1 << 22, 3):
        assert {r[0]: tuple(r)[1:] for r in toxicity.candidate_counts(rows, n).collect()} == want


def test_marks_for_letters_at_the_ends_and_capitals():
    words = toxicity._Words({"stupid": 3.0, "idiot": 2.0, "ass": 5.0})
    texts = ["$tupid", "!diot", "a$$", "stup1d", "idiot!", "calm!", "yOu IdIoT"]
    x = [dict(zip(toxicity.NAMES, r)) for r in words.rows(texts)]
    assert [r["top_weight"] for r in x] == [3.0, 2.0, 5.0, 3.0, 2.0, 0.0, 2.0]
    assert [r["obfuscated"] for r in x] == [1, 1, 1, 1, 0, 0, 0]
    assert x[-1]["capitals"] == 4 / 9 and x[-1]["capital_words"] == 0


def test_obfuscated_words_and_distance():
    words = toxicity._Words({"wretch": 5.0})
    x = dict(zip(toxicity.NAMES, words.rows(["you are a wr3tch, WRETCH w.r.e.t.c.h", ""])[0]))
    assert x["log_hits"] == pytest.approx(math.log1p(3)) and x["log_obfuscated_hits"] == pytest.approx(math.log1p(2))
    assert x["log_near_person"] == pytest.approx(math.log1p(3)) and x["capital_words"] == pytest.approx(1 / 6)
    assert words.rows([""])[0].sum() == 0


def brute_words(t):
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if w] + [b""]


def test_language_model_base_and_normalisation(spark, odd, none):
    docs = read_table(spark, MEDIUM, "documents").limit(150).select("doc_id", "text").unionByName(
        odd.select((F.col("doc_id") + 100000).alias("doc_id"), "text"))
    rows = docs.collect()
    train = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7) != 2
    got = lm.score_documents(docs, train).collect()
    counts = Counter()
    for r in rows:
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2:
            counts.update(brute_words(r.text))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        ws = brute_words(r.text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        want[(r.doc_id, len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 4))] += 1
    assert Counter((g.doc_id, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 4)) for g in got) == want
    assert all(g.score < 0 for g in got)
    fresh = [g for g in got if zlib.crc32(str(g.doc_id).encode()) % 7 == 2]
    assert sum(g.score for g in fresh) > sum(g.base_score for g in fresh)
    assert lm.score_documents(none, train).count() == 0
    unlearnt = lm.score_documents(odd, F.lit(False)).collect()
    assert all(u.train_tokens == 0 and u.base_score == 0 and u.n_known == 0 for u in unlearnt)


def test_language_model_score_against_plain_python(spark):
    docs = read_table(spark, MEDIUM, "documents").limit(60).select("doc_id", "text")
    learn, text = docs.where("doc_id % 3 <> 0"), F.coalesce("text", F.lit(""))
    model = lm.fit(learn, lm.word_counts(learn, text), text)
    p, head = model.parameters, {w: i for i, w in enumerate(model.head)}
    counts = Counter(w for r in learn.collect() for w in brute_words(r.text))
    rest = [w for w in counts if w not in head]
    ending = {k: [w for w in rest if (w[-1] % lm.ENDINGS if w else 0) == k] for k in range(lm.ENDINGS)}
    got = {r.doc_id: r.score for r in lm.score_documents(docs, F.col("doc_id") % 3 != 0).collect()}
    for r in docs.limit(8).collect():
        want, past = 0.0, [len(head) + lm.ENDINGS] * lm.CONTEXT
        for w in brute_words(r.text):
            k = w[-1] % lm.ENDINGS if w else 0
            cls = head.get(w, len(head) + k)
            v = sum(p.q[h].astype(float) * p.c[i] for i, h in enumerate(past))
            s = p.r.astype(float) @ v + p.b
            want += (s[cls] - math.log(np.exp(s).sum())) / math.log(10)
            if w not in head:
                inside = sum(counts[x] for x in ending[k]) + len(ending[k]) + 1
                want += math.log10((counts[w] + 1) / inside)
            past = [cls, *past[:-1]]
        assert got[r.doc_id] == pytest.approx(want, rel=1e-4)


def test_log_probabilities_sum_to_one_and_nce_learns():
    rng = np.random.default_rng(0)
    n = 40
    stream = [np.tile(rng.permutation(n), 200) for _ in range(2)]
    share = np.full(n, 1 / n)
    p = lm.start_parameters(share)
    targets, contexts = lm.examples(stream, n)
    assert contexts[0].tolist() == [n] * lm.CONTEXT and contexts[2].tolist()[:2] == stream[0][:2][::-1].tolist()
    before = lm.log_probabilities(p, targets, contexts).mean()
    scales = lm.new_scales(n)
    for _ in range(15):
        lm.nce_pass(p, targets, contexts, share, rng, 0.3, scales)
    assert lm.log_probabilities(p, targets, contexts).mean() > before + 1.0
    one = np.repeat(contexts[5:6], n, axis=0)
    assert np.exp(lm.log_probabilities(p, np.arange(n), one)).sum() == pytest.approx(1, abs=1e-4)
    back = lm.Parameters.of(p.rows(), n)
    assert np.allclose(back.b, p.b) and np.allclose(back.c, p.c) and np.allclose(back.r, p.r) and np.allclose(back.q, p.q)


# ---- secrets --------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_base(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return out


def brute_entropy(t):
    out, w = [], secrets.WINDOW
    for kind in (3, 4):
        for m in re.finditer(secrets.PATTERNS[secrets.KINDS[kind]], t or ""):
            s = m[0]
            if any(re.search(p, s) for p in secrets.ALLOW):
                continue
            good = []
            for i in range(len(s) - w + 1):
                total = sum(round(c * math.log2(c) * secrets.UNIT) for c in Counter(s[i:i + w]).values())
                if total <= secrets.entropy_limit(secrets.BOUNDS[secrets.KINDS[kind]]):
                    good.append(i)
            spans = []
            for i in good:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + w
                else:
                    spans.append([i, i + w])
            out += [(m.start() + a, kind, m.start() + z) for a, z in spans]
    return out


def test_secrets_brute_force(spark, odd, none):
    rng = np.random.default_rng(3)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    key = "".join(rng.choice(letters, 70))
    texts = [f'é token = "{key[:20]}" and PassWord:short', "token: secret= 'abcdefghijklmnop'", "AKIA" + "A1" * 7 + " AKIAAKIA" + "Z9" * 8,
             "x " + "0123456789abcdef" * 3 + " 12345678901234567890", key + "a" * 40 + key[::-1], "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
             "123e4567-e89b-12d3-a456-426614174000", "漢字 api_key='" + key + "'" * 3, "K token=ſecret: abcdefghijkl", f"{key} {key}\n{key}",
             ("token = " + key[:14] + "\n") * 300, "deadbeef" * 4000]
    docs = spark.createDataFrame([(1000 + i, t, 0) for i, t in enumerate(texts + texts[:2])], "doc_id long, text string, kind int").unionByName(
        odd.select("doc_id", "text", F.lit(1).alias("kind")))
    rows = docs.collect()
    got = secrets.find_secrets(docs).collect()
    want = Counter((r.doc_id, tuple(sorted(brute_base(r.text) + brute_entropy(r.text)))) for r in rows)
    assert Counter((g.doc_id, tuple((s.start, s.kind, s.end) for s in g.spans)) for g in got) == want
    assert sum(s.kind > 2 for g in got for s in g.spans) >= 5
    assert secrets.find_secrets(none).count() == 0


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
                                     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
                                     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
                                     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_planted_keys_of_each_class_are_found(spark, letters):
    rng = np.random.default_rng(len(letters))
    texts = ["a key: " + "".join(rng.choice(list(letters), size)) + " ." for size in (20, 24, 32) for _ in range(300)]
    found = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    missed = Counter(len(texts[g.doc_id]) for g in found if not any(s.kind > 2 for s in g.spans))
    assert max(missed.values(), default=0) <= 18  # 6 % of 300; bounds are set for about 2 %


def test_words_and_hex_runs_are_no_one_case_keys(spark):
    texts = ["internationalisierungsprozess", "INTERNATIONALISIERUNGSPROZESS", "getElementsByClassNameAndTag",
             "0123456789abcdef" * 4000, "0123456789abcdef" * 3 + "k1j2h3g4z5"]
    spans = {g.doc_id: [(s.start, s.kind, s.end) for s in g.spans] for g in secrets.find_secrets(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert not spans[0] and not spans[1] and not spans[2]
    assert all(kind < 5 for _, kind, _ in spans[3])
    assert (48 - 19, 5, 58) in spans[4]  # every window with the first letter behind the hex digits
