"""ROUGE: multiset overlap of n-grams and the longest common subsequence, counted in Arrow batches.

A batch may hold 10,000 long texts, so its rows become Python values SLICE at a time."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.batches import SLICE as SLICE
from quire.functions.batches import slices as _slices
from quire.functions.text import words
from quire.shipping import ship_here


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(tokens):
    """Tokens of over three letters as their stems."""
    import pyarrow as pa

    from quire.functions.stem import stem

    return pa.array((None if x is None else [stem(w) if len(w) > 3 else w for w in x] for (x,) in _slices(tokens)), pa.list_(pa.string()))


def rouge_tokens(text: Column, stemmed: bool = False) -> Column:
    """Lower-case runs of ASCII letters and digits, or their stems."""
    ship_here()
    found = words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return stems(found) if stemmed else found


def _f(overlap: Column, a: Column, b: Column) -> Column:
    return 2.0 * overlap / F.greatest(a + b, F.lit(1))


def _shared(a: list, b: list, n: int) -> int:
    grams = lambda tokens: Counter(zip(*(tokens[i:] for i in range(n)), strict=False) if n > 1 else tokens)
    few, many = grams(a), grams(b)
    if len(few) > len(many):
        few, many = many, few
    return sum(min(k, many.get(g, 0)) for g, k in few.items())


def _common(x: list, y: list) -> int:
    # one bit for each of x, cleared where the subsequence grows: a whole row at a time
    places: dict[str, int] = {}
    for i, u in enumerate(x):
        places[u] = places.get(u, 0) | 1 << i
    every = row = (1 << len(x)) - 1
    for v in y:
        met = row & places.get(v, 0)
        if met:
            row = (row + met | row - met) & every
    return len(x) - row.bit_count()


@F.arrow_udf(T.IntegerType())
def shared_grams(a, b, n):
    """Equal grams of n tokens, each counted as often as both have it."""
    import pyarrow as pa

    return pa.array((_shared(x or [], y or [], k) for x, y, k in _slices(a, b, n)), pa.int32())


def rouge_n(candidate: Column, reference: Column, n: int = 1, stemmed: bool = False) -> Column:
    """F measure of shared n-grams, each counted as often as both have it."""
    a, b = rouge_tokens(candidate, stemmed), rouge_tokens(reference, stemmed)
    count = lambda tokens: F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    return _f(shared_grams(a, b, F.lit(n)), count(a), count(b))


@F.arrow_udf(T.IntegerType())
def lcs_length(a, b):
    import pyarrow as pa

    return pa.array((_common(x or [], y or []) for x, y in _slices(a, b)), pa.int32())


def rouge_l(candidate: Column, reference: Column, stemmed: bool = False) -> Column:
    a, b = rouge_tokens(candidate, stemmed), rouge_tokens(reference, stemmed)
    return _f(lcs_length(a, b), F.size(a), F.size(b))
