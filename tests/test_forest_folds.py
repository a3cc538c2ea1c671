"""Fold forests grow one after another, as they grow in the driver's memory."""
import threading
import time

from tidewell.operators import ensemble as ENS
from tidewell.operators import models as M
from tidewell.spec import Spec


def test_one_forest_grows_at_a_time(spark, monkeypatch):
    now, most, lock = [0], [0], threading.Lock()

    def fit(train, spec, family, *a, **kw):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.1)
        with lock:
            now[0] -= 1
        return M.Trained(family, family, [], [])
    monkeypatch.setattr(M, "fit_model", fit)
    tf = spark.range(3).selectExpr("id", "id AS fold")
    assert len(ENS._fold_models(tf, Spec("id", "label", ()), "RandomForestEntr", 3, 42, [])) == 3 and most == [1]
