"""Topic mixtures keep to the whole table in each pass, and shuffle no texts."""

import numpy as np

from quire.operators import mixtures


def test_a_pass_against_loops(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{j}x" for j in rng.integers(0, 9, int(n))) for n in rng.integers(0, 40, 60)]
    words = [f"w{j}x" for j in range(7)]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "pmid string, text_content string")
    weights = mixtures._weights(rng.random((7, 3)))
    want = np.zeros((7, 3))
    for t in texts:
        known = [words.index(w) for w in t.split() if w in words]
        shares = np.full(3, 1 / 3)
        for _ in range(mixtures.ROUNDS):
            each = weights[known] * shares
            each /= each.sum(axis=1, keepdims=True)
            shares = (each.sum(axis=0) + mixtures.PRIOR) / (len(known) + 3 * mixtures.PRIOR)
        np.add.at(want, known, each)
    counted = mixtures._counted(rows, words)
    got = mixtures._expected(counted, weights)
    assert np.isclose(got.sum(), sum(w in words for t in texts for w in t.split())) and np.allclose(got, want, atol=0.05)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "RDD" not in plan.replace("Scan ExistingRDD", "")
