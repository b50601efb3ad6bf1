"""Density clusters send no growing table through the driver."""

import numpy as np

from quire import storage
from quire.operators import components, density


def test_no_join_is_a_broadcast(spark, monkeypatch):
    plans = []

    def watched(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return storage.written(df, purpose)

    monkeypatch.setattr(density, "written", watched)
    monkeypatch.setattr(components, "written", watched)
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(40, 2)) * 0.2 + c for c in ((0, 0), (6, 6))])
    table = spark.createDataFrame([(str(i), [float(x) for x in p]) for i, p in enumerate(v)], "pmid string, embedding array<double>")
    found = density.density_clusters(table, 8, 5, components=None, levels=4)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 80 and sum("Join" in p for p in plans) > 5
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastExchange" in p]
