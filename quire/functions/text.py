"""Text functions as column expressions.  Only compatibility decomposition needs Python, in Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What cleaning deletes and replaces, in this order.
CITATIONS = r"(?U)\[[\d\s,-]+\]"
NUMBERS = r"(?U)\([\d\s,-]+\)"
COPYRIGHT = r"(?U)©.*?\d{4}"
DOI = r"(?U)doi:.*?\s"
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))

SENTENCE_END = r'(?<=[.!?])\s+(?=[A-Z0-9"(])'


@F.arrow_udf(T.StringType())
def nfkd(text):
    import pyarrow.compute as pc

    return pc.utf8_normalize(text, form="NFKD")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    """Runs of white space, also Unicode's, to one blank; a single blank is left as it is."""
    return F.regexp_replace(text, r"(?U)[\s&&[^ ]]\s*| \s+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


#: What any of these rules needs; a text without it has only its white space to clean.
MARKS = r"[\[(©&]|doi:"


def _clean_decomposed(text: Column, collapsed: bool = False) -> Column:
    plain = text if collapsed else collapse(text)
    return F.when(text.rlike(MARKS), _without_marks(plain)).otherwise(F.trim(plain))


def _without_marks(out: Column) -> Column:
    for pattern in (CITATIONS, NUMBERS, COPYRIGHT, DOI):
        out = F.regexp_replace(out, pattern, "")
    for old, new in ENTITIES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(collapse(out))


def clean_text(text: Column) -> Column:
    """Decomposed, without citations, bracketed numbers, copyright and DOI marks; entities unescaped in order; null is empty."""
    return _clean_decomposed(nfkd(F.coalesce(text, F.lit(""))))


def words(text: Column) -> Column:
    """White-space-separated words, none for an empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many ``words`` there are, without making them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def split_sentences(text: Column, min_chars: int = 20, parts: Column | None = None) -> Column:
    """Sentences longer than min_chars, each cleaned; text is decomposed already where clean_text gave it.  ``parts``: the text as another rule has split it."""
    parts = F.split(collapse(F.coalesce(text, F.lit(""))), SENTENCE_END) if parts is None else parts
    return F.filter(F.transform(parts, lambda s: _clean_decomposed(s, True)), lambda s: F.char_length(s) > min_chars)


def chunk_sentences(sentences: Column, max_words: int = 512) -> Column:
    """Sentences to chunks of at most max_words; a chunk starts with the last sentence of the one before.

    One fold over the array: finished chunks, the open chunk's sentences, and its length in words.
    """
    none = F.array().cast("array<string>")
    counted = F.transform(sentences, lambda s: F.struct(s.alias("s"), word_count(s).alias("n")))
    start = F.struct(none.alias("done"), none.alias("now"), F.lit(0).alias("n"), F.lit(0).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] + x["n"] > max_words) & (F.size(acc["now"]) > 0)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(F.element_at(acc["now"], -1), x["s"])).otherwise(F.concat(acc["now"], F.array(x["s"]))).alias("now"),
            (F.when(full, acc["last"]).otherwise(acc["n"]) + x["n"]).alias("n"),
            x["n"].alias("last"),
        )

    return F.aggregate(counted, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["done"]))


def text_content(title: Column, abstract: Column) -> Column:
    """Title and abstract as one text, without one final stop."""
    return F.regexp_replace(strip(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit("")))), r"\.$", "")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def lead_sentences(text: Column, n: int = 6) -> Column:
    """The first n parts between '. ', closed by a stop."""
    return F.concat(F.array_join(F.slice(F.split(text, r"\. "), 1, n), ". "), F.lit("."))


def post_process(summary: Column) -> Column:
    """Without an unfinished last sentence, ended by one stop."""

    def ended(x: Column) -> Column:
        closed = F.when(F.endswith(x, F.lit(".")), x).otherwise(F.concat(x, F.lit(".")))
        return strip(F.replace(F.replace(closed, F.lit(" .."), F.lit(".")), F.lit(".."), F.lit(".")))

    def whole(parts: Column) -> Column:
        open_end = (F.size(parts) > 1) & ~F.endswith(F.element_at(parts, -1), F.lit("."))
        return F.array_join(F.slice(parts, 1, F.size(parts) - open_end.cast("int")), ". ")

    return let(let(F.split(summary, r"\. "), whole), ended)


def ellipsis(text: Column, n: int, always: bool = False) -> Column:
    """The first n characters and dots; short texts get none unless always."""
    cut = F.concat(F.left(text, F.lit(n)), F.lit("..."))
    return cut if always else F.when(F.char_length(text) > n, cut).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case words of at least two letters or digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}_]{2,}"), F.lit(0))
