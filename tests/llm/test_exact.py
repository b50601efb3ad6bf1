"""Similar documents against exact Jaccard similarity by brute force."""

import random

import corpus_pipeline
from quire.llm import exact, simhash

import numpy as np
import pytest


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def least_of_components(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if shared * 5 >= every * 4:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, least.get(root(k))) for k, (i, _) in enumerate(rows)]


def edited(rng, words, edits):
    words = list(words)
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"edit{rng.random()}"
    return " ".join(words)


def made(rng):
    rows = []
    for i in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 300, 1500]))]
        rows += [(10 * i + k, edited(rng, words, round(len(words) * 0.007 * k))) for k in range(5)]
    return rows


def near(docs):
    return simhash.near_duplicates(docs, 14, 5, least=(4, 5))


@pytest.mark.parametrize("group", [256, 5])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(exact, "GROUP", group)
    rng = random.Random(6)
    rows = made(rng) + [(None, "one two"), (900, None), (901, " \n"), (902, "One TWO"), (903, "one two three"), (900, "a second row of this id"), (905, "word " * 30_000), (None, rows_text := "only null ids have this text here"), (None, rows_text)]
    got = [(r["doc_id"], r["component_id"]) for r in near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(least_of_components(rows), key=repr)
    assert near(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_group_without_a_middle(spark, monkeypatch):
    """Copies with edits of their own, of which some are linked by chains only."""
    monkeypatch.setattr(exact, "GROUP", 8)
    rng = random.Random(11)
    words = [f"w{rng.randrange(9000)}" for _ in range(70)]
    rows = [(i, edited(rng, words, 1 + i % 2)) for i in range(60)] + [(100 + i, edited(rng, words, 3)) for i in range(20)]
    got = [(r["doc_id"], r["component_id"]) for r in near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    want = least_of_components(rows)
    assert sorted(got) == sorted(want) and 1 < len({c for _, c in want}) < 80


def test_similar_pairs():
    rng = np.random.default_rng(2)
    for n in (2, 5, 40):
        sets = [np.unique(rng.choice(60, rng.integers(1, 60), replace=False)).astype(np.uint64) for _ in range(n)]
        sets[-1] = sets[0]
        own = [set(s.tolist()) for s in sets]
        for split in (0, n // 2):
            want = {(i, j) for i in range(n) for j in range(i + 1, n) if 2 * len(own[i] & own[j]) >= len(own[i] | own[j]) and (not split or i < split <= j)}
            assert set(zip(*(x.tolist() for x in exact.similar_pairs(sets, split, (1, 2))), strict=True)) == want


def test_stage_drops_copies_of_similarity_above_four_fifths(spark, sf):
    rng = random.Random(7)
    words = [f"w{rng.randrange(5000)}" for _ in range(1600)]
    rows = [(1, " ".join(words), "en", "s", 1), (2, edited(rng, words, 32), "en", "s", 1), (3, edited(rng, words, 300), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf).collect()) == [1, 3]
