"""Rows of Arrow batches as Python values, few at a time: a batch may hold 10,000 long texts."""

from __future__ import annotations

#: Rows that are Python values at once.
SLICE = 64


def slices(*columns):
    """The columns' values, SLICE rows of them at a time."""
    for i in range(0, len(columns[0]), SLICE):
        yield from zip(*(c.slice(i, SLICE).to_pylist() for c in columns), strict=True)
