"""Summaries by rank in a sentence graph: what many sentences resemble is said, and not twice.

Sentences of a text are nodes; an edge weighs the cosine of two sentences' tf-idf vectors, whose document
frequencies are those of the text's own sentences.  Power iteration gives each sentence the share of a walk that follows edges
with probability DAMPING and starts anew otherwise.  Sentences are then taken one by one by rank times what is new in them, 1 less
their greatest cosine to one taken already, up to a number of sentences and of words, and put in the text's order.

The graph of a long text is never written out: its product with a vector is two products with the sparse sentence-by-term matrix, so a
text takes memory and time by its words, not by the square of its sentences.  Ties go to the earlier sentence.  Sentences without a
word have rank by restart alone; texts of no more sentences than wanted are kept whole, up to the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

from quire.functions import text as T
from quire.functions.batches import slices
from quire.shipping import ship_here

DAMPING, ROUNDS, CLOSE = 0.85, 100, 1e-9
#: Up to so many sentences the cosines are a small matrix, which is quicker.
DENSE = 128


class SentenceGraph:
    """Unit tf-idf rows of sentences, and the walk over their cosines."""

    def __init__(self, sentences: list[list[str]]):
        number: dict[str, int] = {}
        places = np.array([number.setdefault(w, len(number)) for words in sentences for w in words], np.int64)
        self.n = len(sentences)
        rows = np.repeat(np.arange(self.n), [len(words) for words in sentences])
        pairs, counts = np.unique(rows * max(len(number), 1) + places, return_counts=True)
        self.row, self.term = np.divmod(pairs, max(len(number), 1))
        held = np.bincount(self.term, minlength=len(number))
        value = counts * np.log((1 + self.n) / (0.5 + held[self.term]))
        norm = np.sqrt(np.bincount(self.row, value**2, self.n))
        self.value, self.terms = value / np.where(norm > 0, norm, 1.0)[self.row], len(number)
        self.own = (norm > 0).astype(float)  # the cosine of a sentence with itself
        self.matrix = None
        if self.n <= DENSE:
            x = np.zeros((self.n, self.terms))
            x[self.row, self.term] = self.value
            self.matrix = x @ x.T
            np.fill_diagonal(self.matrix, 0.0)

    def similar(self, x: np.ndarray) -> np.ndarray:
        """The matrix of all cosines, without the diagonal, times x."""
        if self.matrix is not None:
            return self.matrix @ x
        by_term = np.bincount(self.term, self.value * x[self.row], self.terms)
        return np.bincount(self.row, self.value * by_term[self.term], self.n) - self.own * x

    def ranks(self) -> np.ndarray:
        """Shares of the walk; they add up to 1."""
        degree = np.maximum(self.similar(np.ones(self.n)), 0)
        linked = degree > 1e-12
        rank = np.full(self.n, 1 / self.n)
        for _ in range(ROUNDS):
            step = self.similar(np.where(linked, rank / np.where(linked, degree, 1.0), 0.0))
            new = (1 - DAMPING) / self.n + DAMPING * (np.maximum(step, 0) + rank[~linked].sum() / self.n)
            if np.abs(new - rank).sum() < CLOSE:
                return new
            rank = new
        return rank

    def cosines(self, i: int) -> np.ndarray:
        one = np.zeros(self.n)
        one[i] = 1.0
        return self.similar(one)


def picked(sentences: list[list[str]], lengths: list[int], n: int, most_words: int) -> list[int]:
    """The numbers of the sentences taken, in the text's order; the first is taken however long it is."""
    if not sentences:
        return []
    if len(sentences) <= n and sum(lengths) <= most_words:
        return list(range(len(sentences)))
    graph = SentenceGraph(sentences)
    rank = graph.ranks()
    rank = rank / rank.max()
    said, taken, words = np.zeros(len(sentences)), [], 0
    open_ = np.ones(len(sentences), bool)
    while len(taken) < n and open_.any():
        worth = np.where(open_, np.round(rank * (1 - said), 9), -np.inf)
        i = int(worth.argmax())
        open_[i] = False
        if taken and words + lengths[i] > most_words:
            continue
        taken.append(i)
        words += lengths[i]
        said = np.maximum(said, graph.cosines(i))
    return sorted(taken)


def graph_sentences(sentences: Column, n: int = 6, most_words: int = 150) -> Column:
    """The best of an array of sentences, as one text in their order."""
    ship_here()

    @F.arrow_udf(types.ArrayType(types.IntegerType()))
    def best(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for tokens, lengths in batches:
            yield pa.array((picked(words or [], size or [], n, most_words) for words, size in slices(tokens, lengths)), pa.list_(pa.int32()))

    chosen = best(F.transform(sentences, T.tokens), F.transform(sentences, T.word_count))
    return F.array_join(F.transform(chosen, lambda i: F.element_at(sentences, i + 1)), " ")
