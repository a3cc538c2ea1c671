"""Row-wise operators run unchanged on a streaming DataFrame."""

import shutil
import tempfile

from pyspark.sql import functions as F

from tidewell.operators import models as M
from tidewell.operators import scale as N
from tidewell.plans import fixtures as X
from tests.conftest import SMALL


def test_predict_and_scale_on_a_stream(spark):
    e = X.emb(spark, SMALL)
    m = M.fit_model(e, X.EMB_SPEC, "LR")
    params = N.fit(e, list(X.EMB_FEATURES), "standard")
    schema = spark.read.parquet(f"{SMALL}/embeddings.parquet").schema
    src = tempfile.mkdtemp(prefix="tw-stream-src-", dir="/tmp")  # a file stream reads a directory
    shutil.copy(f"{SMALL}/embeddings.parquet", f"{src}/part-0.parquet")
    stream = spark.readStream.schema(schema).parquet(src)
    feats = stream.select(F.col("vec_id").cast("string").alias("id"),
                          *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(X.N_EMB)])
    scored = M.predict(m, N.apply(feats, params, "standard"))
    name = "tw_stream_pred"
    q = (scored.writeStream.format("memory").queryName(name).outputMode("append")
               .option("checkpointLocation", tempfile.mkdtemp(prefix="tw-stream-", dir="/tmp"))
               .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.sql(f"SELECT * FROM {name}")
    assert got.count() == e.count()
    batch = M.predict(m, N.apply(e, params, "standard"))
    j = got.join(batch.withColumnRenamed("predicted", "b"), "id")
    assert j.filter(F.col("predicted") != F.col("b")).count() == 0
