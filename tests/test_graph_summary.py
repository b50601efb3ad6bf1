"""Graph-ranked summaries against a dense version, planted texts, odd rows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.functions.rouge import rouge_n
from quire.operators import graph_summary as g
from quire.operators import summaries

GRAPH = EngineConfig(summary_method="graph", summary_sentences=3)


def dense_ranks(sentences):
    words = sorted({w for s in sentences for w in s})
    x = np.array([[s.count(w) for w in words] for s in sentences], float).reshape(len(sentences), len(words))
    x = x * np.log((1 + len(x)) / (0.5 + (x > 0).sum(axis=0)))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1)
    w = x @ x.T
    np.fill_diagonal(w, 0)
    degree = w.sum(axis=1)
    n = len(w)
    move = np.array([w[i] / degree[i] if degree[i] > 1e-12 else np.full(n, 1 / n) for i in range(n)])
    rank = np.full(n, 1 / n)
    for _ in range(3000):
        rank = (1 - g.DAMPING) / n + g.DAMPING * move.T @ rank
    return rank, w


def dense_pick(sentences, lengths, n, most):
    rank, w = dense_ranks(sentences)
    rank, taken, left, words = rank / rank.max(), [], list(range(len(sentences))), 0
    while len(taken) < n and left:
        i = max(left, key=lambda j: (round(rank[j] * (1 - max((w[j, t] for t in taken), default=0)), 6), -j))
        left.remove(i)
        if not taken or words + lengths[i] <= most:
            taken.append(i)
            words += lengths[i]
    return sorted(taken)


sentence = st.lists(st.sampled_from("alpha beta gamma delta eps zeta".split()), max_size=6)


@settings(max_examples=60, deadline=None)
@given(st.lists(sentence, min_size=1, max_size=9))
def test_ranks_are_those_of_the_dense_walk(sentences):
    rank, w = dense_ranks(sentences)
    graph = g.SentenceGraph(sentences)
    assert np.allclose(graph.ranks(), rank, atol=1e-6) and abs(graph.ranks().sum() - 1) < 1e-6
    assert all(np.allclose(graph.cosines(i), w[i]) for i in range(len(sentences)))


@pytest.mark.parametrize("seed", range(8))
def test_picks_are_those_of_the_dense_walk(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    sentences = [[rng.choice(words) for _ in range(rng.randint(3, 15))] for _ in range(30)]
    lengths = [len(s) for s in sentences]
    for n, most in ((3, 1000), (6, 40), (50, 100)):
        assert g.picked(sentences, lengths, n, most) == dense_pick(sentences, lengths, n, most)


def test_long_texts_take_linear_memory():
    rng = random.Random(1)
    sentences = [[f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(12)] for _ in range(20_000)]
    taken = g.picked(sentences, [12] * len(sentences), 6, 150)
    assert len(taken) == 6 and taken == sorted(taken)


STORY = [
    "Good morning to everybody who came here today for the talk.",
    "Please switch your telephones off and take any free chair.",
    "Coffee will be served next door when all this is over.",
    "The glacier lost nine metres of ice during the warm summer.",
    "Warm summer winds made the glacier lose its ice faster than before.",
    "Researchers measured the ice of the glacier every warm summer week.",
    "My neighbour keeps two cats and an old parrot at home.",
    "Without cold winters the glacier and its ice will be gone by 2050.",
]


def test_summary_says_what_the_text_is_about(spark):
    rows = spark.createDataFrame([("1", " ".join(STORY))], "pmid string, text_content string")
    score = lambda config: summaries.add_summary(rows, config=config).select("summary", rouge_n(F.col("summary"), F.lit(" ".join(STORY[3:6] + STORY[7:]))).alias("r")).first()
    graph, lead = score(GRAPH), score(EngineConfig(summary_sentences=3))
    assert graph["r"] > 0.6 > 0.3 > lead["r"]
    assert "glacier" in graph["summary"] and "Coffee" not in graph["summary"]


def test_nothing_is_said_twice(spark):
    same = "The glacier lost nine metres of ice during the warm summer."
    other = "Snow fell on the lake and the glacier in the cold winter months."
    rows = spark.createDataFrame([("1", " ".join([same] * 5 + [other] + STORY[:2]))], "pmid string, text_content string")
    assert summaries.add_summary(rows, config=GRAPH).first()["summary"].count("nine metres") == 1


def test_odd_rows(spark):
    """Null, empty, short, no sentence long enough, one sentence, other letters, many words, clashing names."""
    rows = [("1", None), ("2", ""), ("3", "Short."), ("4", "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2), ("5", "One sentence of a rather fair length stands here all alone."), ("6", "Été à Paris où tout le monde aime la glace au citron. " * 3), ("7", "word " * 5000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "pmid string, text_content string, summary string")
    got = {r["pmid"]: r for r in summaries.add_summary(table, config=GRAPH).collect()}
    assert {p for p, r in got.items() if r["error"]} == {"1", "2", "3"} and len(got) == 7
    assert got["5"]["summary"] == "One sentence of a rather fair length stands here all alone." and got["7"]["summary_length"] <= 150
    assert summaries.add_summary(table.limit(0), config=GRAPH).count() == 0
