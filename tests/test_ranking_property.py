"""Property: the sliced group rank equals row_number over (group, order) for any data."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators.ranking import group_rank

rows_st = st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", None]),
                             st.integers(min_value=-3, max_value=3)), min_size=1, max_size=120)


@settings(max_examples=6, deadline=None)
@given(rows=rows_st, parts=st.integers(min_value=1, max_value=9))
def test_group_rank_equals_window(spark, rows, parts):
    data = [(f"{i:04d}", g, float(v)) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id string, g string, v double")
    ours = group_rank(df, ["g"], ["v", "id"], "rn", "n", partitions=parts, hash_ordered=False)
    ref = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    got = {r["id"]: (r["rn"], r["n"]) for r in ours.collect()}
    exp = {r["id"]: r["rn2"] for r in ref.collect()}
    sizes = {}
    for _, g, _ in data:
        sizes[g] = sizes.get(g, 0) + 1
    assert set(got) == set(exp)
    for i, g, _ in data:
        assert got[i] == (exp[i], sizes[g])
