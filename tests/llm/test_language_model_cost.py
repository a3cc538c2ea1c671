"""The language model's join sorts no words; contexts are decoded from their codes."""
import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import language_model as L


def test_words_of_texts_are_joined_without_a_sort(spark):
    docs = spark.createDataFrame([(i, f"alpha beta w{i} w{i % 3}") for i in range(30)], "doc_id long, text string")
    out = L.score_documents(docs, F.col("doc_id") % 5 != 0)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert out.count() == 30


def test_normalised_over_all_classes():
    n = 7
    p = L.start_parameters(np.full(n, 1 / n))
    contexts = np.array([[a, b, c] for a in range(n + 1) for b in (0, n) for c in (n, 3, 3)])
    logs = np.stack([L.log_probabilities(p, np.full(len(contexts), t), contexts) for t in range(n)])
    v = sum(p.q[contexts[:, i]] * p.c[i] for i in range(L.CONTEXT))
    want = v @ p.r.T + p.b
    want -= np.log(np.exp(want).sum(axis=1, keepdims=True))
    assert np.allclose(logs.T, want, atol=1e-5)
