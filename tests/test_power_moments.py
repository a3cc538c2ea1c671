"""Power transform: moments of all λ by one numpy pass equal SQL's."""
import math

import numpy as np
from pyspark.sql import functions as F

from tidewell.operators import scale as N


def test_moments_match_sql_and_need_no_wide_aggregate(spark):
    rng = np.random.default_rng(1)
    vals = [(float(x),) for x in rng.normal(2, 3, 400)] + [(None,), (0.0,), (-1.5,)]
    df = spark.createDataFrame(vals, "x double").repartition(5)
    for method, tf in (("yeo-johnson", N._yj), ("box-cox", N._bc)):
        lams = [-1.0, 0.0, 0.5, 2.0]
        got = N._power_moments(df, {"x": lams}, method)
        want = df.agg(F.count("x").alias("n"), *[F.var_pop(tf(F.col("x"), lam)).alias(f"v{k}") for k, lam in enumerate(lams)]).first()
        assert got["x", -1][0] == want["n"] == 402
        for k in range(len(lams)):
            n, _, dev = got["x", k]
            a, b = dev / n, want[f"v{k}"]
            assert (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 1e-9 * abs(b)


def test_all_null_column_keeps_its_parameters(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "x double, y double")
    p = {r["feature"]: r for r in N.fit_power(df, ["x", "y"]).collect()}
    assert p["y"]["lmbda"] == 1.0 and p["y"]["mean"] is None and p["x"]["mean"] is not None
