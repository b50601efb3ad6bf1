"""The functions for SQL: nfkd as a vectorised UDF, the others as SQL functions over built-ins."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quire.functions import text as T
from quire.functions.rouge import lcs_length


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _without(x: str, *patterns: str) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{_sql(p)}', '')"
    return x


def _collapse(x: str) -> str:
    return f"regexp_replace({x}, '{_sql(r'(?U)\s+')}', ' ')"


def _clean(x: str) -> str:
    x = _without(_collapse(x), T.CITATIONS, T.NUMBERS, T.COPYRIGHT, T.DOI)
    for old, new in T.ENTITIES:
        x = f"replace({x}, '{old}', '{new}')"
    return f"trim({_collapse(x)})"


def _tokens(x: str) -> str:
    return f"filter(split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' '), ' '), w -> w <> '')"


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _grams(x: str, n: str) -> str:
    """The runs of n tokens, each with its number among equal ones."""
    runs = _let(_tokens(x), "t", f"if(size(t) < {n}, cast(array() as array<string>), transform(sequence(1, greatest(size(t) - {n} + 1, 1)), i -> array_join(slice(t, i, {n}), ' ')))")
    return _let(f"array_sort({runs})", "g", "transform(g, (w, i) -> concat(w, '#', i - array_position(g, w)))")


_NO_TEXTS = "cast(array() as array<string>)"
_CHUNKS = (
    f"aggregate(transform(split_sentences(x), s -> named_struct('s', s, 'n', size(filter(split(s, '{_sql(r'(?U)\s+')}'), w -> w <> '')))),"
    f" named_struct('done', {_NO_TEXTS}, 'now', {_NO_TEXTS}, 'n', 0, 'last', 0),"
    " (a, e) -> if(a.n + e.n > max_words and size(a.now) > 0,"
    " named_struct('done', concat(a.done, array(array_join(a.now, ' '))), 'now', array(element_at(a.now, -1), e.s), 'n', a.last + e.n, 'last', e.n),"
    " named_struct('done', a.done, 'now', concat(a.now, array(e.s)), 'n', a.n + e.n, 'last', e.n)),"
    " a -> if(size(a.now) > 0, concat(a.done, array(array_join(a.now, ' '))), a.done))"
)


def _rouge(n: str) -> str:
    count = lambda x: f"greatest(size({_tokens(x)}) - ({n} - 1), 0)"
    return f"coalesce(2D * size(array_intersect({_grams('candidate', n)}, {_grams('reference', n)})) / nullif({count('candidate')} + {count('reference')}, 0), 0D)"


FUNCTIONS = {
    "clean_text(x STRING) RETURNS STRING": _clean("nfkd(coalesce(x, ''))"),
    "word_count(x STRING) RETURNS INT": f"size(filter(split(coalesce(x, ''), '{_sql(r'(?U)\s+')}'), w -> w <> ''))",
    "split_sentences(x STRING) RETURNS ARRAY<STRING>": f"filter(transform(split({_collapse("coalesce(x, '')")}, '{_sql(T.SENTENCE_END)}'), s -> {_clean('s')}), s -> char_length(s) > 20)",
    "vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "chunk_text(x STRING, max_words INT) RETURNS ARRAY<STRING>": _CHUNKS,
    "rouge_n(candidate STRING, reference STRING, n INT) RETURNS DOUBLE": _rouge("n"),
    "rouge_1(candidate STRING, reference STRING) RETURNS DOUBLE": _rouge("1"),
}


def register(spark: SparkSession) -> None:
    """nfkd, lcs_length, clean_text, word_count, split_sentences, chunk_text, vec_dot, rouge_n, rouge_1 as temporary functions."""
    spark.udf.register("nfkd", T.nfkd)
    spark.udf.register("lcs_length", lcs_length)
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
