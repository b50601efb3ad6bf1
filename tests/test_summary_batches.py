"""Sentence graphs of a batch are made a few rows at a time, small ones as matrices."""

import numpy as np
import pyarrow as pa

from quire.functions import batches
from quire.operators import graph_summary as g


def test_nested_rows_go_by_slices():
    column, lengths = pa.array([[["a", "b"]]] * 150 + [None]), pa.array([[2]] * 150 + [None])
    assert list(batches.slices(column, lengths)) == [([["a", "b"]], [2])] * 150 + [(None, None)]


def test_small_and_large_graphs_agree(monkeypatch):
    rng = np.random.default_rng(5)
    sentences = [[f"w{i}" for i in rng.integers(0, 30, 8)] for _ in range(40)]
    small = g.SentenceGraph(sentences)
    monkeypatch.setattr(g, "DENSE", 0)
    large = g.SentenceGraph(sentences)
    assert small.matrix is not None and large.matrix is None
    assert np.allclose(small.ranks(), large.ranks()) and np.allclose(small.cosines(7), large.cosines(7))
