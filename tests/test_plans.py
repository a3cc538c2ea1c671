"""Plan shapes that carry the scale design (checked on physical plans, not timings)."""

from tidewell.operators import sample as O
from tidewell.operators import split as T
from tidewell.operators import stats as G
from tidewell.plans import fixtures as X
from tests.conftest import SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_numbers_rows_per_class_and_slice(spark):
    plan = _plan(T.assign_split(X.li(spark, SMALL), "id", "label", 0.2))
    # the numbering window is partitioned by (label, slice), never by the label alone
    assert "__tw_slice" in plan
    assert "rangepartitioning" not in plan.lower()


def test_per_class_joins_are_broadcast_without_aqe(spark):
    old_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    old_thr = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for df in (G.filter_min_class(X.li(spark, SMALL)),
                   G.distance_to_centroid(X.emb(spark, SMALL), X.EMB_SPEC)):
            plan = _plan(df)
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        plan = _plan(O.oversample_random(X.emb(spark, SMALL), X.EMB_SPEC))
        assert "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old_aqe)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old_thr)


def test_fixture_scan_is_pruned(spark):
    plan = _plan(G.class_counts(X.li(spark, SMALL)))
    # only the columns behind the label reach the scan
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in \
        G.class_counts(X.li(spark, SMALL))._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan
