"""Mixtures, soft assignments, merges, maps, sketches and sentences by cosine, against NumPy and plain counts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.operators import hierarchy, latent, mixtures, sketches, summaries


@pytest.fixture(scope="module")
def themes(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i), " ".join(f"t{i % 3}w{j}" for j in rng.integers(0, 12, 30))) for i in range(150)]
    return spark.createDataFrame(rows, "pmid string, text_content string")


def test_mixtures(spark, themes):
    mixture = mixtures.TopicMixture.fit(themes, 3, passes=30)
    got = {r["pmid"]: r["shares"] for r in mixture.shares(themes).collect()}
    assert len(got) == 150 and all(math.isclose(sum(s), 1, rel_tol=1e-9) and len(s) == 3 for s in got.values())
    main = [[int(np.argmax(got[str(i)])) for i in range(t, 150, 3)] for t in range(3)]
    assert len({max(set(m), key=m.count) for m in main}) == 3 and all(m.count(max(set(m), key=m.count)) >= 48 for m in main)
    assert 11 < mixture.perplexity < 20  # a theme has 12 words, all have 36
    assert mixture.perplexity_of(themes.filter(F.lit(False))) is None
    words = mixture.topic_words(5).collect()
    assert len(words) == 15 and all(len({r["word"][:2] for r in words if r["topic_id"] == t}) == 1 for t in range(3))
    odd = spark.createDataFrame([("a", "unknown words"), ("b", ""), ("c", None), ("d", "t1w1 " * 20_000)], "pmid string, text_content string").withColumn("counts", F.lit(1))
    shares = {r["pmid"]: r["shares"] for r in mixture.shares(odd).collect()}
    assert set(shares) == {"a", "d"} and np.allclose(shares["a"], 1 / 3) and max(shares["d"]) > 0.99


def test_soft_assignments(spark):
    centres = spark.createDataFrame([(4, [0.0, 0.0]), (2, [3.0, 0.0])], "topic_id int, centre array<double>")
    rows = spark.createDataFrame([("a", [0.0, 1.0]), ("b", None), ("c", [1.5, 0.0])], "pmid string, embedding array<float>")
    got = {(r["pmid"], r["topic_id"]): r["probability"] for r in mixtures.soft_assignments(rows, centres).collect()}
    assert set(got) == {("a", 2), ("a", 4), ("c", 2), ("c", 4)} and got["c", 2] == got["c", 4] == 0.5
    assert math.isclose(got["a", 4], 1 / (1 + math.exp(1 - 10)))
    assert mixtures.soft_assignments(rows, centres.limit(0)).count() == 0


def by_pairs(centres, sizes):
    """Merges by the mean over all pairs of members, each as often as its size."""
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    groups, out = {i: [i] for i in range(len(centres))}, []

    def mean(a, b):
        w = [(sizes[i] * sizes[j], 1 - unit[i] @ unit[j]) for i in groups[a] for j in groups[b]]
        return sum(x * y for x, y in w) / sum(x for x, _ in w)

    for step in range(len(centres) - 1):
        d, a, b = min((round(mean(a, b), 10), a, b) for a in groups for b in groups if a < b)
        groups[len(centres) + step] = groups.pop(a) + groups.pop(b)
        out.append((step, a, b, d, sum(sizes[i] for i in groups[len(centres) + step])))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merges_by_pairs(seed):
    rng = np.random.default_rng(seed)
    centres, sizes = rng.normal(size=(12, 5)), rng.integers(1, 50, 12)
    got, want = hierarchy.merge_table(centres, sizes), by_pairs(centres, sizes.tolist())
    assert [(s, a, b, n) for s, a, b, _, n in got] == [(s, a, b, n) for s, a, b, _, n in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want])
    assert hierarchy.merge_table(centres[:1], sizes[:1]) == hierarchy.merge_table(np.zeros((0, 3)), np.zeros(0)) == []


def test_hierarchy_and_map(spark):
    v = {0: [1.0, 0.0, 0.0], 1: [0.9, 0.1, 0.0], 5: [0.0, 0.0, 1.0], -1: [0.0, 5.0, 0.0]}
    rows = spark.createDataFrame([(f"{t}-{i}", x, t) for t, x in v.items() for i in range(2 + (t == 5))], "pmid string, embedding array<double>, topic_id int")
    merges = [(r["step"], r["left"], r["right"], r["size"], r["topics"]) for r in hierarchy.topic_hierarchy(rows, rows).collect()]
    assert merges == [(0, 0, 1, 4, [0, 1]), (1, 5, 0, 7, [0, 1, 5])] or merges == [(0, 0, 1, 4, [0, 1]), (1, 0, 5, 7, [0, 1, 5])]
    places = {r["topic_id"]: np.array([r["x"], r["y"]]) for r in hierarchy.topic_map(rows, rows).collect()}
    for a in places:
        for b in places:  # three centres lie in a plane, so all distances stay
            assert math.isclose(np.linalg.norm(places[a] - places[b]), np.linalg.norm(np.subtract(v[a], v[b])), abs_tol=1e-9)
    assert hierarchy.topic_hierarchy(rows.limit(0), rows.limit(0)).count() == hierarchy.topic_map(rows.limit(0), rows.limit(0)).count() == 0


def test_sketches_unite(spark):
    rows = spark.range(300_000).select(F.concat(F.lit("20"), F.lpad((F.col("id") % 10).cast("string"), 2, "0")).alias("year"), (F.col("id") % 90_000).cast("string").alias("author"))
    each = sketches.period_sketches(rows.unionByName(spark.createDataFrame([(None, "x"), ("2003", None)], "year string, author string")), F.col("year"), "author")
    bound = 4 * 1.04 / math.sqrt(1 << sketches.SKETCH_BITS)
    for first, last in ((None, None), ("2002", "2004"), ("2009", None)):
        part = rows.filter((F.col("year") >= (first or "")) & (F.col("year") <= (last or "9")))
        got, want = sketches.distinct_between(each, first, last).first(), part.select("author").distinct().count()
        assert abs(got["distinct_values"] / want - 1) < bound and got["rows"] == part.count()
    assert tuple(sketches.distinct_between(each, "2050").first()) == (0, 0)
    running = [r["distinct_values"] for r in sketches.running_distinct(each).orderBy("period").collect()]
    assert len(running) == 10 and all(abs(x / (9_000 * (i + 1)) - 1) < bound for i, x in enumerate(running))


def test_sentences_by_cosine(spark, themes):
    config = EngineConfig(latent_dim=3, summary_sentences=2)
    model = latent.LatentEmbedder(config).fit(themes)
    said = ["T0w1 and t0w2 are the first of these.", "T1w1 with t1w5 and t1w7 comes next here.", "Nothing known is in this sentence.", "T1w2 or t0w3 or t2w4 are all over the place."]
    rows = spark.createDataFrame([("1", " ".join(said)), ("2", None), ("3", "")], "pmid string, text_content string").withColumn("summary", F.lit("clash"))
    wanted = np.array(model.embed_text(spark, "t1w3 t1w9"))
    near = [float(np.dot(wanted, model.embed_text(spark, s))) for s in said]
    got = summaries.semantic_summary(rows, model, "t1w3 t1w9", config=config)
    best = sorted(np.lexsort((range(4), -np.round(near, 6)))[:2])
    found = {r["pmid"]: r["summary"] for r in got.collect()}
    assert found["1"] == " ".join(said[i] for i in best) and found["2"] == found["3"] == "" and 1 in best
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
