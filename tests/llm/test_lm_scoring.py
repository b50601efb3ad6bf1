"""The trigram model against the same formulas over plain counters; the trie against sorted lists."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs
import pytest

from quire.llm import lm_scoring as lm
from quire.llm.ngram_trie import ABSENT, EliasFano, NGramTrie, Quantiser, select_in_words

#: The most that a code takes off a log probability here; each of a token's three may be coded.
STEP = 0.03

HELD = "pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2"


class Counts:
    def __init__(self, rows):
        self.one, self.two, self.three = Counter(), Counter(), Counter()
        for key, text in rows:
            if not held(key):
                words = lm.tokens(text) + [b""]
                self.one.update(words)
                self.two.update(zip(words, words[1:]))
                self.three.update(zip(words, words[1:], words[2:]))
        self.n, self.v = sum(self.one.values()), len(self.one)

    def scores(self, text):
        words, base, score = [*lm.tokens(text), b""], 0.0, 0.0
        for i, w in enumerate(words):
            base += math.log10((self.one[w] + 1) / (self.n + self.v + 1))
            p = (self.one[w] + lm.FLOOR) / (self.n + lm.FLOOR * (self.v + 1))
            if i:
                c = self.one[words[i - 1]]
                p = self.two[words[i - 1], w] / (c + lm.PAIR) + lm.PAIR / (c + lm.PAIR) * p
            if i > 1:
                c = self.two[words[i - 2], words[i - 1]]
                p = self.three[words[i - 2], words[i - 1], w] / (c + lm.TRIPLE) + lm.TRIPLE / (c + lm.TRIPLE) * p
            score += math.log10(p)
        return len(words), sum(self.one[w] > 0 for w in words), self.n, base, score


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def agree(rows, got):
    model = Counts(rows)
    assert len(got) == len(rows)
    known = {}
    for key, text in rows:
        known.setdefault(key, []).append(model.scores(text))
    for r in got:
        match = [x for x in known[r.doc_id] if x[:3] == (r.n_tokens, r.n_known, r.train_tokens) and math.isclose(x[3], r.base_score, abs_tol=1e-6) and x[4] - 2 * STEP * x[0] <= r.score <= x[4] + 1e-6]
        assert match and r.held_out == held(r.doc_id), r
        known[r.doc_id].remove(match[0])


@pytest.mark.parametrize("block, shard", [(lm.BLOCK_TOKENS, lm.SHARD_TOKENS), (20_000, 15_000)])
def test_scores_by_counters(spark, sf, block, shard):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = lm.score_documents(docs, HELD, block_tokens=block, shard_tokens=shard).collect()
    agree(rows, got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_hot_words_and_pairs(spark):
    """One word is a third of all, one pair precedes a third of all words; both are spread and counted exactly."""
    rows = [(i, " ".join(f"the big w{i}x{j}" for j in range(200)) + " the the the") for i in range(30)]
    rows += [(i, "rare words only here") for i in range(30, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    agree(rows, lm.score_documents(docs, HELD, block_tokens=3_000, shard_tokens=2_000).collect())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "A a É é"), (3, "a"), (4, "a b"), (5, "x " * 100_000), (5, "x " * 100_000), (16, "unseen Unseen \x0b a")]
    assert held(next(k for k in range(20) if held(k)))
    table = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, block string, held int")
    agree(rows, lm.score_documents(table, HELD).collect())
    assert lm.score_documents(table.limit(0), HELD).count() == 0
    nothing = lm.score_documents(table, "true").collect()
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in nothing} == {(0, 0, 0.0, 0.0)}


def test_tries_can_be_kept(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = lm.score_documents(docs, HELD, shard_tokens=20_000, tries=str(tmp_path)).count()
    files = sorted(tmp_path.iterdir())
    assert n == docs.count() and len(files) == 4
    trie = NGramTrie.open(pyarrow.fs.LocalFileSystem(), str(files[0]))
    assert trie.sequences[2].size == len(trie.chance2) > 1000 and trie.sequences[4].size == len(trie.chance3) > 1000


def test_elias_fano_gives_back_what_it_holds():
    rng = np.random.default_rng(1)
    for n, most in ((0, 1), (1, 0), (1, 1 << 45), (7, 3), (5000, 10), (5000, 1 << 40)):
        values = np.sort(rng.integers(0, most + 1, n)).astype(np.uint64)
        assert (EliasFano.of(values).get(np.arange(n)) == values).all()


def test_trie_finds_its_trigrams_in_a_mapped_file(tmp_path):
    rng = np.random.default_rng(2)
    grams = sorted(set(map(tuple, rng.integers(1, 40, (6000, 3)).tolist())))
    a = np.array(grams, np.uint32)
    pairs, which = np.unique(a[:, 0].astype(np.uint64) << lm.HIGH | a[:, 1], return_inverse=True)
    chance = np.linspace(1e-6, 1, len(pairs))
    fs = pyarrow.fs.LocalFileSystem()
    NGramTrie.build((pairs >> lm.HIGH).astype(np.uint32), (pairs & lm.LOW).astype(np.uint32), chance, chance, which, a[:, 2], np.linspace(0.01, 0.5, len(a))).write(fs, str(tmp_path / "t"))
    trie = NGramTrie.open(fs, str(tmp_path / "t"))
    asked = rng.integers(0, 45, (20_000, 3)).astype(np.uint32)
    asked = asked[np.argsort(asked[:, 0], kind="stable")]
    coded = Quantiser(trie.steps[0]).values[trie.chance2]
    assert (coded <= chance * (1 + 1e-9)).all() and (coded >= chance * 10 ** -(trie.steps[0] * 1.001)).all()
    place = {g: i for i, g in enumerate(grams)}
    assert trie.thirds(trie.pairs(asked[:, 0], asked[:, 1]), asked[:, 2]).tolist() == [place.get(tuple(g), -1) for g in asked.tolist()]


def test_packed_arrays_come_back():
    arrays = [np.arange(5, dtype=np.uint64), np.zeros(0, np.uint32), np.array([-3, 4], np.int64), np.array([1, 0], np.uint8)]
    for a, b in zip(arrays, lm.unpack(lm.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_select():
    rng = np.random.default_rng(3)
    words = np.append(rng.integers(0, 1 << 63, 500, dtype=np.uint64) << np.uint64(1) | np.uint64(1), np.array([1, 1 << 63, (1 << 64) - 1], np.uint64))
    for word in words.tolist():
        bits = [i for i in range(64) if word >> i & 1]
        got = select_in_words(np.full(len(bits), word, np.uint64), np.arange(len(bits)))
        assert got.tolist() == bits
    assert Quantiser(0.1).values[ABSENT] == 0
