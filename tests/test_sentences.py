"""The trained splitter: what it learns against plain counters, what it splits, odd rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.functions import sentences as sn
from quire.operators import prepare

NAMES = "Novak Laurent Okafor Lindgren Sato Moreau Haas Petrov".split()
VERBS = "measured described found reported examined observed compared".split()
THINGS = "samples patients cells glaciers mice stars proteins rivers soils".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    one = rng.choice
    ways = [
        lambda: f"Dr. {one(NAMES)} {one(VERBS)} the {one(THINGS)}.",
        lambda: f"We {one(VERBS)} {one(THINGS)}, e.g. {one(THINGS)} and {one(THINGS)}.",
        lambda: f"The {one(THINGS)} are shown in Fig. {rng.randint(1, 9)} of the paper.",
        lambda: f"The {one(THINGS)} were {one(VERBS)} by {one(NAMES)} et al. in {rng.randint(1950, 2020)}.",
        lambda: f"In this work the {one(THINGS)} of {one(NAMES)} were used.",
        lambda: f"They {one(VERBS)} no {one(THINGS)}, cf. Table {rng.randint(1, 9)}.",
        lambda: f"However, many {one(THINGS)} remain.",
        lambda: f"Few {one(THINGS)} remain today, and one paper used {one(THINGS)} of them.",
        lambda: f"J. {one(NAMES)} {one(VERBS)} them first!",
    ]
    return [" ".join(one(ways)() for _ in range(12)) for _ in range(120)]


@pytest.fixture(scope="module")
def splitter(spark, corpus):
    return sn.train(spark.createDataFrame([(t,) for t in corpus], "text_content string").repartition(3))


def words_of(text):
    out = []
    for w in text.split():
        w = w.lstrip("\"'“‘«([").rstrip("\"'”’»)],;:")
        out += [w] if w else []
    return out


def kind(w):
    w = w.rstrip(".!?…")
    return "##" if w.replace(".", "").replace(",", "").isdigit() else w.lower()


def likelihood(both, a, b, n):
    clip = lambda p: min(max(p, 1e-12), 1 - 1e-12)
    like = lambda k, m, p: k * math.log(clip(p)) + (m - k) * math.log(1 - clip(p))
    rest, other = max(n - a, 1.0), max(b - both, 0.0)
    return 2 * (like(both, a, both / a) + like(other, rest, other / rest) - like(both, a, b / n) - like(other, rest, b / n)) if both / a > b / n else 0.0


def test_learns_what_counters_tell(splitter, corpus):
    with_stop, n, follow = Counter(), Counter(), Counter()
    for text in corpus:
        found = words_of(text)
        for w, after in zip(found, [*found[1:], None]):
            t = kind(w)
            n[t] += 1
            if len(w) > 1 and w[-1] == "." and w[-2] != ".":
                with_stop[t] += 1
                if after:
                    follow[t, kind(after)] += 1
    total, stops = sum(n.values()), sum(with_stop.values())
    score = {}
    for t, k in with_stop.items():
        if t[0].isalpha() and all(c.isalpha() or c == "." for c in t):
            letters, without = len(t.replace(".", "")), n[t] - k
            gain = k * (math.log(0.99) - math.log(stops / total)) + without * (math.log(0.01) - math.log(1 - stops / total))
            score[t] = max(0, 2 * gain) * math.exp(-letters) * (t.count(".") + 1) / letters**without
    want = {t for t, s in score.items() if s >= sn.ABBREVIATION}
    assert splitter.abbreviations == want >= {"dr", "e.g", "fig", "al", "cf"}
    ends = Counter()
    for (a, b), k in follow.items():
        if a not in want:
            ends[b] += k
    starters = {b for b, k in ends.items() if k >= sn.SEEN and b[0].isalpha() and likelihood(k, stops, n[b], total) >= sn.STARTER}
    pairs = {(a, b) for (a, b), k in follow.items() if k >= sn.SEEN and b not in starters and (a in want or a == "##") and likelihood(k, with_stop[a], n[b], total) >= sn.COLLOCATION}
    assert splitter.collocations == pairs and ("fig", "##") in pairs
    assert splitter.starters == starters >= {"we", "however", "they"}


CASES = [
    (["Dr. Novak measured the cells.", "We compared mice, e.g. Laurent and others."]),
    (["The stars are shown in Fig. 3 of the paper.", "The soils were used."]),
    (["Rivers were found by Okafor et al. in 1990.", "However, many cells remain."]),
    (["J. Sato observed them first!", "They found no mice, cf. Table 4.", "The end came."]),
    (["It was described by Moreau et al.", "The cells remain."]),
    (['He said: "We found no cells."', "They remain."]),
    (["Is it so?", "Yes (in part).", "No more is known..."]),
    (["They grew by 4.5 per cent.", "In this work they shrank."]),
]


@pytest.mark.parametrize("want", CASES)
def test_splits(splitter, want):
    assert splitter.split(" ".join(want)) == want


def test_most_ends_are_right(splitter, corpus):
    wrong = lambda s: sum(abs(len(s.split(t)) - 12) for t in corpus) / (12 * len(corpus))
    assert wrong(splitter) <= 0.04 and wrong(sn.Splitter()) >= 0.3


def test_column_and_process(spark, splitter):
    text = "Dr. Novak measured the cells of all the mice. The stars are shown in Fig. 3 of the paper."
    rows = spark.createDataFrame([("1", "A title", text), ("2", "A title", None), ("3", None, "")], "pmid string, title string, abstract string").withColumns({c: F.lit(None).cast(t) for c, t in (("journal", "string"), ("authors", "array<string>"), ("pub_date", "string"), ("mesh_terms", "array<string>"))})
    got = {r["pmid"]: r["s"] for r in rows.select("pmid", sn.split_trained(F.col("abstract"), splitter).alias("s")).collect()}
    assert got == {"1": ["Dr. Novak measured the cells of all the mice.", "The stars are shown in Fig. 3 of the paper."], "2": [], "3": []}
    trained = {r["pmid"]: r["sentences"] for r in prepare.process(rows, EngineConfig(), splitter).collect()}
    ruled = {r["pmid"]: r["sentences"] for r in prepare.process(rows, EngineConfig()).collect()}
    assert trained["1"] == ["Dr. Novak measured the cells of all the mice.", "The stars are shown in Fig. 3 of the paper"]
    assert ruled["1"] == ["Novak measured the cells of all the mice.", "The stars are shown in Fig."]


def test_odd_texts(spark):
    empty = sn.train(spark.createDataFrame([(None,), ("",)], "text_content string").limit(0))
    assert empty == sn.Splitter() == sn.train(spark.createDataFrame([(None,), ("",), ("...",)], "text_content string"))
    assert empty.split(None) == empty.split("  ") == [] and empty.split("No stop") == ["No stop"]
    assert empty.split("One. Two! Three? four... five. Six") == ["One.", "Two!", "Three?", "four... five.", "Six"]
    long = "This is one sentence. " * 50_000
    assert len(empty.split(long)) == 50_000
    assert len(empty.split("x" * 300_000 + ". " + "Y" * 300_000)) == 2
