"""Repeated passages leave every document but the earliest, by hashing units of lines.

A unit is a stretch of a line that ends with a clause (up to a stop, comma or colon) of at least
``CLAUSE_WORDS`` words or with the line: shorter clauses go with what follows, but of two shorter ones in
a row the second ends the unit where a hash of the two says so, about one time in ``POOR``.  Where a unit ends depends
on its own clauses only, so a passage set into the middle of a line has the same units there as
anywhere else, from its second clause on.  (Whole lines as units would miss such passages.)

1. Units are normalised (lower case, single blanks) and hashed to 128 bits; only blank ones are left alone.
2. Digests are grouped globally; the occurrence of the smallest (doc_id, unit number) is the earliest.
   Tasks reduce equal digests first, so a passage of a third of all documents is no hot group.
3. Units that are not their digest's earliest go, where such units stand together with at least
   ``min_words`` words: next to each other, or with nothing but units under CLAUSE_WORDS between them, whose
   own words don't count then.  All documents keep what is left, and the spans of what went.

Offsets are code points of the original text.  Null and empty texts have no units and stay as they are
(null becomes empty).  Rows of one doc_id are one document: equal units at one place in them have one
rank.  A null id counts as the smallest long.  Extra columns are left alone.  An empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import pairs, written

CLAUSE_WORDS = 6
POOR = 3
MIN_WORDS = 25
#: Digests with over a HOT-th of all units, or over HOT_UNITS, are joined by broadcast: under HOT of them, or one for HOT_UNITS units.
HOT, HOT_UNITS = 1_000, 10_000_000
NO_ID = -(1 << 63)

_CLAUSE = re.compile(r"[^\n]*?[.!?,;:](?=[ \t])[ \t]+|[^\n]*\n+|[^\n]+")


def split_units(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of the units, which cover the text."""
    from xxhash import xxh3_64_intdigest

    units, start, words, last = [], 0, 0, None
    for m in _CLAUSE.finditer(text):
        clause = m[0]
        own = clause.split()
        n = len(own)
        words += n
        ends = n >= CLAUSE_WORDS or clause[-1] == "\n"
        if not ends and last:
            ends = xxh3_64_intdigest(" ".join(last + own).lower().encode("utf-8", "surrogatepass")) % POOR == 0
        last = None if n >= CLAUSE_WORDS or clause[-1] == "\n" else own
        if ends:
            units.append((start, m.end(), words))
            start, words = m.end(), 0
    if start < len(text):
        units.append((start, len(text), words))
    return units


def hashed_units(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units that are not blank; a unit's number is its place here."""
    from xxhash import xxh3_128_digest

    return [(a, b, n, xxh3_128_digest(" ".join(text[a:b].lower().split()).encode("utf-8", "surrogatepass"))) for a, b, n in split_units(text) if n]


UNITS = "hi long, lo long, doc_id long, number int"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digests, owners, numbers = [], [], []

    def flush() -> pa.RecordBatch:
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        out = pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(owners, pa.int64()), pa.array(numbers, pa.int32())], names=["hi", "lo", "doc_id", "number"])
        digests.clear(), owners.clear(), numbers.clear()
        return out

    for doc_id, text in pairs(batches):
        own = hashed_units(text or "")
        digests += [u[3] for u in own]
        owners += [doc_id] * len(own)
        numbers += range(len(own))
        if len(digests) >= 100_000:
            yield flush()
    yield flush()


def later_units(units: DataFrame) -> DataFrame:
    """Units that are not their digest's earliest occurrence: (doc_id, number, lo, kept_doc_id)."""
    groups = units.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "number")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = written(groups.select("hi", "lo", "n", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.number").alias("kept_number")), "groups")
    total = max(1, units.count())
    least = min(total / HOT, HOT_UNITS)
    hot, cold = groups.filter(F.col("n") > least).drop("n"), groups.filter(F.col("n") <= least).drop("n")
    met = units.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["hi", "lo"], "left")
    rare = met.filter("hot is null").select("hi", "lo", "doc_id", "number").join(cold, ["hi", "lo"])
    both = met.filter("hot").drop("hot").unionByName(rare)
    return both.filter("doc_id <> kept_doc_id or number <> kept_number").select("doc_id", "number", "lo", "kept_doc_id")


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, text (what stays), n_units, n_removed, removed (start, end in the original, kept_doc_id), carry (a struct of the columns named)."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    text = F.col(f"`{text_col}`").cast("string")
    units = written(docs.select(key.alias("doc_id"), text.alias("text")).mapInArrow(_units, UNITS), "units")
    later = later_units(units).groupBy("doc_id").agg(F.collect_list(F.struct("number", "lo", "kept_doc_id")).alias("later")).withColumnRenamed("doc_id", "key")
    whole = docs.select(
        key.alias("key"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        text.alias("text"),
        (F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.struct(F.lit(0).alias("none"))).alias("carry"),
    )
    joined = whole.join(later.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "later", "carry")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kept_doc_id", T.LongType())])
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span)), joined.schema["carry"]])
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kept_doc_id", pa.int64())]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts, counts, removed = [], [], []
                for text, later in zip(part.column("text").to_pylist(), part.column("later").to_pylist(), strict=True):
                    text = text or ""
                    own = hashed_units(text)
                    gone = removals(own, later or [], min_words)
                    texts.append(cut(text, gone))
                    counts.append(len(own))
                    removed.append(gone)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(map(len, removed), pa.int64()), pa.array([[dict(zip(("start", "end", "kept_doc_id"), s, strict=True)) for s in r] for r in removed], spans), part.column("carry")], names=out.names)

    return joined.mapInArrow(keep, out)


def removals(own: list[tuple[int, int, int, bytes]], later: list[dict], min_words: int) -> list[tuple[int, int, int]]:
    """(start, end, kept_doc_id) of later units that stand together with at least min_words words."""
    kept = {x["number"]: x["kept_doc_id"] for x in later if x["number"] < len(own) and int.from_bytes(own[x["number"]][3][8:], "little", signed=True) == x["lo"]}
    long = [k for k, u in enumerate(own) if u[2] >= CLAUSE_WORDS]
    gone: set[int] = set()
    for order in (range(len(own)), long):
        run, words = [], 0
        for k in [*order, -1]:
            if k in kept:
                run.append(k)
                words += own[k][2]
                continue
            if words >= min_words:
                gone.update(run)
            run, words = [], 0
    return [(own[k][0], own[k][1], kept[k]) for k in sorted(gone)]


def cut(text: str, gone: list[tuple[int, int, int]]) -> str:
    parts, at = [], 0
    for a, b, _ in gone:
        parts.append(text[at:a])
        at = b
    return "".join([*parts, text[at:]])


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every document, and the spans that went."""
    return dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_units", "n_removed", "removed")
