"""Runs against their definition, on random words with planted repetitions and on the smallest tables."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import periodic_runs as pr


def by_definition(words, min_words=6, min_periods=4):
    found = {}
    for q in range(1, len(words) // min_periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_words, min_periods * q) and j > i:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


repetition = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(2, 9), st.integers(0, 8)).map(lambda t: (t[0] * (t[1] + 1))[: len(t[0]) * t[1] + t[2] % len(t[0])])
document = st.lists(st.one_of(repetition, st.lists(st.integers(0, 9), max_size=12)), max_size=5).map(lambda parts: [b"%d" % w for p in parts for w in p])


@settings(max_examples=200, deadline=None)
@given(st.lists(document, min_size=1, max_size=4), st.sampled_from([(6, 4), (4, 2), (8, 3), (1, 2)]))
def test_runs_by_definition(docs, least):
    assert [list(map(tuple, r.tolist())) for r in pr.document_runs(docs, *least)] == [by_definition(d, *least) for d in docs]


def test_mask_holds_every_run_and_little_else():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 5000, 20_000)
    words[700:760] = np.tile(np.arange(6), 10)
    kept = pr.repeated_grams(words, np.zeros(len(words), np.int64), pr.gram_words())
    assert kept[700:760].all() and kept.sum() < 100
    assert pr.gram_words(6, 4) == 5 and pr.gram_words(4, 2) == 1


def test_thue_morse_has_no_long_run():
    words = [b"%d" % (bin(i).count("1") % 2) for i in range(1 << 13)]  # its prefix sums collide modulo 2^64
    assert [len(r) for r in pr.document_runs([words, [b"a"] * 5000])] == [0, 1]


@pytest.mark.parametrize("size", ["sf0.001"])
def test_query_by_definition(spark, size):
    folder = f"/root/testdata/{size}"
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = pr.op13_periodic_runs(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(source)
    assert sum(r.n_runs > 0 for r in rows) > 15
    for row in rows:
        words = source[row.doc_id].encode().split()
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = by_definition(words)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest()


def test_odd_rows(spark):
    """Nulls, empty texts, repeats, other white space, ties, a long text and clashing names."""
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "x y " * 8), (3, "x y " * 8), (4, "a\tb\n" * 50_000), (5, "p p p p p p q r r r r r r")]
    table = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, runs int, collapsed string")
    got = {}
    for r in pr.detect_runs(table).collect():
        got.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], bytes(r.collapsed).decode()))
    assert got == {1: [([], "")], 2: [([], "")], None: [([], "a b c")], 3: [([(0, 8, 1)], "x y")] * 2, 4: [([(0, 100_000, 2)], "a b")], 5: [([(0, 6, 1), (7, 6, 1)], "p q r")]}
    assert pr.best_run(np.array([(0, 6, 1), (7, 6, 1)])) == (0, 6, 1)
    assert pr.detect_runs(table.limit(0)).count() == 0
