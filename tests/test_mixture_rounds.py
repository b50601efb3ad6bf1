"""A text's shares come from all rounds, alike in any company; learning and sharing out read the texts once."""

import numpy as np
from pyspark.sql import functions as F

from quire.operators import mixtures, topics


def test_rows_against_loops_whatever_their_company():
    rng = np.random.default_rng(5)
    weights = mixtures._weights(rng.random((50, 4)))
    sizes = [0, 1, 3, 50, 0, 7, 2, 2, 49, 31, *rng.integers(0, 50, 40)]
    at = np.concatenate([rng.permutation(50)[:n] for n in sizes]).astype(int)
    counts, offsets = rng.integers(1, 9, len(at)).astype(float), np.concatenate([[0], np.cumsum(sizes)])
    shares, parts = mixtures._settled(weights, at, counts, offsets)
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        own, each = np.full(4, 1 / 4), np.zeros((0, 4))
        for _ in range(mixtures.ROUNDS if b > a else 0):
            each = weights[at[a:b]] * own
            each *= (counts[a:b] / each.sum(axis=1))[:, None]
            own = (each.sum(axis=0) + mixtures.PRIOR) / (counts[a:b].sum() + 4 * mixtures.PRIOR)
        alone = mixtures._settled(weights, at[a:b], counts[a:b], offsets[i : i + 2] - a)
        assert np.allclose(shares[i], own, rtol=0, atol=1e-12) and np.allclose(parts[a:b], each, rtol=0, atol=1e-12)
        assert np.allclose(alone[0][0], shares[i], rtol=0, atol=1e-12)


def test_shares_of_the_learnt_papers(spark, monkeypatch):
    kept, write = [], mixtures.written
    monkeypatch.setattr(mixtures, "written", lambda df, purpose: kept.append(purpose) or write(df, purpose))
    rows = [(str(i % 57), " ".join(f"w{(i * j) % 11}x" for j in range(i % 9))) for i in range(60)] + [(None, "w1x w2x"), ("n", None)]
    papers = spark.createDataFrame(rows, "pmid string, text_content string").repartition(3)
    mixture, shares = mixtures.TopicMixture.fit_shares(papers, 3, held_out=4, passes=3)
    assert kept == ["terms", "counted"] and "terms" not in "".join(shares.inputFiles())
    plain = lambda df: sorted((str(r["pmid"]), *(round(x, 9) for x in r["shares"])) for r in df.collect())
    again = mixtures.TopicMixture.fit(papers, 3, held_out=4, passes=3)
    assert plain(shares) == plain(again.shares(papers)) == plain(mixture.shares(papers)) and len(plain(shares)) == sum(bool(t) for _, t in rows)
    assert np.isclose(mixture.perplexity, again.perplexity)


def test_words_counted_in_batches(spark, monkeypatch):
    monkeypatch.setattr(mixtures, "WORDS", 3)
    rows = [("a", "cell cell gene"), ("b", "gene tumour gene virus cell"), ("c", None), ("d", ""), ("e", "virus")]
    for more in ([], [("b", "cell cell"), (None, "gene gene")]):
        papers = spark.createDataFrame(rows + more, "pmid string, text_content string")
        found = papers.select("pmid", topics.terms(F.col("text_content")).alias("t"))
        got = topics.vocabulary_of(found, papers.select("pmid"), 1, 9, mixtures._tallied).collect()
        assert got == topics.vocabulary(papers, 1, 1, 9).collect() and len(got) == 4
