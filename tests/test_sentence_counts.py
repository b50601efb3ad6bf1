"""What the trained splitter counts: in batches, not by a row a word, and as Spark's own functions would."""

import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import sentences as sn

ODD = ["", "  ", "...", "!. x", 'He said "Fig. 3." (see cf.) "...', "a.\x1cb c. ,, ;: Next", "a\x85b.\xa0c d. 　E", "1,000.5 1.5. 2. 3", "Ünal ẞ. İstanbul ΣΑΣ. x", "et al. \n\n\t In 1990. The", "x.", "((\"a.\") b", "…… e.g.… f. ."]


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("aB1.,!…\"(); \n\x1d\x85 ") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    return [*ODD, *made, *ODD, None]


def plainly(rows):
    """The counts by Spark's functions, a row a word."""
    bare = lambda w: F.regexp_replace(w, r"""^["'“‘«(\[]+|["'”’»)\],;:]+$""", "")
    kind = lambda w: F.when(F.regexp_replace(w, r"[.,]", "").rlike(r"^\d+$"), F.lit("##")).otherwise(F.lower(w))
    words = rows.select(F.filter(F.transform(F.split(F.coalesce("text_content", F.lit("")), r"(?U)\s+"), bare), lambda w: w != "").alias("w")).filter(F.size("w") > 0)
    each = words.select(F.posexplode("w").alias("i", "word"), "w").select("word", F.get("w", F.col("i") + 1).alias("after"), F.col("word").rlike(r"[^.]\.$").alias("stop"))
    unstopped = lambda c: kind(F.regexp_replace(c, r"[.!?…]+$", ""))
    return each.select(unstopped("word").alias("type"), "stop", F.when(F.col("stop"), unstopped("after")).alias("after")).filter("type <> ''").groupBy("type", "stop", "after").agg(F.count("*").alias("n"))


def as_set(rows):
    found = [tuple(r) for r in rows.select("type", "stop", "after", "n").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.fixture
def counted(monkeypatch):
    kept, write = {}, sn.written
    monkeypatch.setattr(sn, "written", lambda df, purpose: kept.setdefault(purpose, df) and write(df, purpose))
    return kept


def test_counts_as_sparks_functions_do(spark, counted):
    rows = spark.createDataFrame([(t,) for t in texts()], "text_content string").repartition(3)
    sn.train(rows)
    assert as_set(counted["word-counts"]) == as_set(plainly(rows))


def test_no_row_a_word(spark, counted):
    sn.train(spark.createDataFrame([("One. Two three.",)], "text_content string"))
    assert "Generate" not in counted["word-counts"]._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_and_flushes_lose_nothing(monkeypatch):
    def sums(size=None):
        given = [t or "" for t in texts()] + ["Fig. 3 et al. The end. " * 50]
        batches = [pa.record_batch([pa.array(given[i : i + size] if size else given)], ["text"]) for i in range(0, len(given), size or len(given))]
        out, n = Counter(), 0
        for b in sn._counts(iter(batches)):
            n += 1
            for r in b.to_pylist():
                out[r["type"], r["stop"], r["after"]] += r["n"]
        return out, n

    whole, once = sums()
    monkeypatch.setattr(sn, "PIECE", 3)
    monkeypatch.setattr(sn, "HELD", 5)
    cut, often = sums(7)
    assert cut == whole and once == 1 < often
    monkeypatch.setattr(sn, "HELD", 1 << 18)
    monkeypatch.setattr(sn, "READ", 40)
    assert sums()[0] == whole


def test_long_runs_of_stops_take_linear_time():
    began = time.perf_counter()
    assert sn.Splitter().split("Contents" + "." * 50_000 + "9 pages. Next") == ["Contents" + "." * 50_000 + "9 pages.", "Next"]
    assert time.perf_counter() - began < 5
