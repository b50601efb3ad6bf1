"""A batch of many rows is never Python values at once."""

import pyarrow as pa

from quire.functions import rouge


class Watched:
    """A column that notes how many rows became Python values together."""

    def __init__(self, column, most):
        self.column, self.most = column, most

    def __len__(self):
        return len(self.column)

    def slice(self, i, n):
        return Watched(self.column.slice(i, n), self.most)

    def to_pylist(self):
        self.most.append(len(self.column))
        return self.column.to_pylist()


def test_scores_of_a_batch_go_by_slices():
    most = []
    texts = Watched(pa.array([["running", "to", f"w{i % 7}"] for i in range(1_000)] + [None]), most)
    n = Watched(pa.array([1] * 1_001), most)
    assert rouge.shared_grams.func(texts, texts, n).to_pylist() == [3] * 1_000 + [0]
    assert rouge.lcs_length.func(texts, texts).to_pylist() == [3] * 1_000 + [0]
    assert rouge.stems.func(texts).to_pylist()[-2:] == [["run", "to", "w5"], None]
    assert max(most) <= rouge.SLICE
