"""A sentence splitter that learns abbreviations, collocations and sentence starters from a corpus.

What is learnt (all by the log-likelihood ratio of two counts, after Kiss and Strunk's unsupervised method):

* abbreviations: types that stand before a stop more often than chance tells, weighed by their shortness, their inner stops and
  against every occurrence without a stop;
* starters: types that follow a sentence's end more often than chance tells;
* collocations: pairs of an abbreviation or number and the type after its stop that is no starter, more frequent together than apart ("Fig. 3").

Words are counted in Arrow batches, and Spark groups these counts; all that is learnt is kept.  Up to MOST of a kind go to tasks
as a set; more go as a file that is searched where it lies.  A stop, or ! or ?, before white space ends a sentence, but for a stop

* after an initial (one letter) or an abbreviation before a word that is no starter, or before a word in small letters;
* after a number or abbreviation whose pair with the next word is a collocation;
* before a next word that starts small.

Quotes and brackets that close stay with their sentence.  Texts are split in Arrow batches; null and empty texts have no sentence.
"""

from __future__ import annotations

import math
import re
import sqlite3
import tempfile
import uuid
from collections import Counter
from collections.abc import Container, Iterator
from contextlib import closing
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from quire.functions.batches import slices
from quire.shipping import ship_here
from quire.storage import written

#: Held in memory of each kind, beyond which all of it is a file; the least scores.
MOST = 20_000
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Fewest times that a pair or a starter must be seen.
SEEN = 3
#: Characters of a text that are words at once; characters read, and different words and pairs held, before a task's counts go on to Spark's grouping.
PIECE, READ, HELD = 1 << 20, 1 << 25, 1 << 18

_CLOSERS = "\"'”’»)]"
#: A run of stops is tried from its start alone, or long runs would take quadratic time.
_BREAK = re.compile(rf"([.!?…](?<![.!?…]{{2}})[.!?…]*)([{re.escape(_CLOSERS)}]*)(\s+)(?=\S)")
_OPENERS = "\"'“‘«(["
_STOPS = ".!?…"
#: White space as Spark's (?U)\s knows it; Python's own has these separators too.
_SPACE, _SEPARATORS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), "\x1c\x1d\x1e\x1f"


def _type(word: str) -> str:
    """A word as the tables know it: small, without what opens and closes it, numbers as one."""
    word = word.strip(_OPENERS + _CLOSERS + ",;:").lower()
    return "##" if word.replace(",", "").replace(".", "").isdigit() else word


def log_likelihood(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Twice the log-likelihood ratio of "b after a at a rate of its own" against "as often as anywhere", nought where it comes less often."""
    within = lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    like = lambda k, m, p: k * F.ln(within(p)) + (m - k) * F.ln(1 - within(p))
    rest, other = F.greatest(n - a, F.lit(1.0)), F.greatest(b - both, F.lit(0.0))
    return F.when(both / a > b / n, 2 * (like(both, a, both / a) + like(other, rest, other / rest) - like(both, a, b / n) - like(other, rest, b / n))).otherwise(0.0)


def abbreviation_score(kind: Column, with_stop: Column, without: Column, stops: float, words: float) -> Column:
    """The likelihood that a type goes with its stop, times its shortness, its inner stops, and a penalty for each occurrence without."""
    p, sure = min(max(stops / max(words, 1.0), 1e-12), 1 - 1e-12), 0.99
    gain = with_stop * (math.log(sure) - math.log(p)) + without * (math.log(1 - sure) - math.log(1 - p))
    letters = F.char_length(F.replace(kind, F.lit("."), F.lit(""))).cast("double")
    return F.greatest(2 * gain, F.lit(0.0)) * F.exp(-letters) * (F.char_length(kind) - letters + 1) / F.pow(letters, without)


@lru_cache(16)
def _opened(name: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{SparkFiles.get(name)}?mode=ro&immutable=1", uri=True, check_same_thread=False)


@dataclass(frozen=True)
class Filed:
    """A set of types, or of pairs of them, of any size: a sorted file that Spark brings to the disk of every executor."""

    name: str

    @classmethod
    def of(cls, rows: DataFrame) -> Filed:
        """Of different rows of one or two columns, which come through the driver a partition at a time."""
        path = Path(tempfile.mkdtemp()) / f"learnt-{uuid.uuid4().hex}.sqlite"
        with closing(sqlite3.connect(path, isolation_level=None)) as db:
            db.execute("PRAGMA journal_mode = OFF")
            db.execute("CREATE TABLE held (word TEXT, after TEXT, PRIMARY KEY (word, after)) WITHOUT ROWID")
            db.execute("BEGIN")
            db.executemany("INSERT INTO held VALUES (?, ?)", ((r[0], r[1] if len(r) > 1 else "") for r in rows.orderBy(*rows.columns).toLocalIterator()))
            db.execute("COMMIT")
        rows.sparkSession.sparkContext.addFile(str(path))
        return cls(path.name)

    def __contains__(self, key: str | tuple[str, str]) -> bool:
        pair = key if isinstance(key, tuple) else (key, "")
        return _opened(self.name).execute("SELECT 1 FROM held WHERE word = ? AND after = ?", pair).fetchone() is not None


def _kept(rows: DataFrame) -> Container:
    """All rows as a set: of values, or of pairs where there are two columns."""
    if rows.count() > MOST:
        return Filed.of(rows)
    return frozenset(tuple(r) if len(r) > 1 else r[0] for r in rows.collect())  # MOST at most


@dataclass(frozen=True)
class Splitter:
    """What a corpus has taught; without one only initials and the next word's first letter decide."""

    abbreviations: Container[str] = frozenset()
    collocations: Container[tuple[str, str]] = frozenset()
    starters: Container[str] = frozenset()

    def split(self, text: str | None) -> list[str]:
        text = (text or "").strip()
        out, begin = [], 0
        for m in _BREAK.finditer(text):
            if self._ends(text, m):
                out.append(text[begin : m.end(2)])
                begin = m.end(3)
        return [s for s in (*out, text[begin:]) if s]

    def _ends(self, text: str, m: re.Match) -> bool:
        following = text[m.end() : m.end() + 200].split(None, 1)[0]
        bare = following.lstrip(_OPENERS)
        if bare[:1].islower() and (m[1] == "." or "…" in m[1] or ".." in m[1]):
            return False
        if m[1] != ".":
            return True
        start = max(text.rfind(" ", max(0, m.start() - 100), m.start()), text.rfind("\n", max(0, m.start() - 100), m.start())) + 1
        word = text[start : m.start()].lstrip(_OPENERS)
        known = _type(word)
        initial = len(known) == 1 and known.isalpha() and word[:1].isupper()
        short = initial or known in self.abbreviations
        if not short and known != "##":
            return True
        after = _type(following.rstrip(".!?"))
        if (known, after) in self.collocations:
            return False
        return not short or (bare[:1].isalpha() and after in self.starters)


def _bare(word: str) -> str:
    return word.lstrip(_OPENERS).rstrip(_CLOSERS + ",;:")


def _stopped(word: str) -> bool:
    return len(word) > 1 and word[-1] == "." and word[-2] != "."


def _kind(word: str) -> str:
    """A word's type, but for small letters, which Spark makes."""
    word = word.rstrip(_STOPS)
    digits = word.replace(".", "").replace(",", "")
    return "##" if digits.isdigit() and digits.isascii() else word


def _pieces(text: str) -> Iterator[str]:
    """A text cut before white space, in about PIECE characters each."""
    begin = 0
    while begin < len(text):
        cut = _SPACE.search(text, begin + PIECE)
        end = cut.start() if cut else len(text)
        yield text[begin:end]
        begin = end


def _tally(text: str, words: Counter, pairs: Counter) -> Iterator[int]:
    """Counts a text's words as they stand, and its stopped words with the next word (None after the last); gives each piece's length once it is counted."""
    waiting: list[str] = []  # a stopped word whose next one is in the next piece
    for piece in _pieces(text):
        found = _SPACE.split(piece) if any(c in piece for c in _SEPARATORS) else piece.split()
        words.update(found)
        found, waiting = waiting + found, []
        for i in [i for i, w in enumerate(found) if "." in w]:
            word = _bare(found[i])
            if _stopped(word):
                after = i + 1
                while after < len(found) and not _bare(found[after]):
                    after += 1
                if after < len(found):
                    pairs[word, _bare(found[after])] += 1
                else:
                    waiting = [word]
        yield len(piece)
    pairs.update((w, None) for w in waiting)


_COUNTS = pa.schema([("type", pa.string()), ("stop", pa.bool_()), ("after", pa.string()), ("n", pa.int64())])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of types, with the type after a stop; a type may come in several rows."""
    words, pairs, read = Counter(), Counter(), 0

    def rows() -> pa.RecordBatch:
        plain = [(w, n) for w, n in ((_bare(w), n) for w, n in words.items()) if w and not _stopped(w)]
        kinds = [_kind(w) for w, _ in plain] + [_kind(w) for w, _ in pairs]
        after = [None] * len(plain) + [a if a is None else _kind(a) for _, a in pairs]
        return pa.record_batch([kinds, [False] * len(plain) + [True] * len(pairs), after, [n for _, n in plain] + [*pairs.values()]], schema=_COUNTS)

    for batch in batches:
        for (text,) in slices(batch.column(0)):
            for length in _tally(text, words, pairs):
                read += length
                if read >= READ or len(words) + len(pairs) >= HELD:
                    yield rows()
                    words.clear()
                    pairs.clear()
                    read = 0
    yield rows()


def train(texts: DataFrame, text_col: str = "text_content") -> Splitter:
    """Learns from all texts of a table."""
    source = texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ship_here()
    each = source.mapInArrow(_counts, "type string, stop boolean, after string, n long").select(F.lower("type").alias("type"), "stop", F.lower("after").alias("after"), "n")
    counted = written(each.filter("type <> ''").groupBy("type", "stop", "after").agg(F.sum("n").alias("n")), "word-counts")
    total, stops = counted.agg(F.sum("n"), F.sum(F.when(F.col("stop"), F.col("n")))).first()
    total, stops = total or 0, stops or 0
    types = written(counted.groupBy("type").agg(F.coalesce(F.sum(F.when(F.col("stop"), F.col("n"))), F.lit(0)).alias("with_stop"), F.sum("n").alias("n")), "types")

    def best(rows: DataFrame, score: Column, least: float, purpose: str, *columns: str) -> DataFrame:
        return written(rows.withColumn("score", score).filter(F.col("score") >= least).select(*columns), purpose)

    lettered = types.filter(F.col("type").rlike(r"^\p{L}[\p{L}.]*$") & (F.col("with_stop") > 0))
    score = abbreviation_score(F.col("type"), F.col("with_stop"), F.col("n") - F.col("with_stop"), float(stops), float(total))
    abbreviations = best(lettered, score, ABBREVIATION, "abbreviations", "type", "with_stop")
    known = abbreviations.unionByName(types.filter("type = '##'").select("type", "with_stop")).withColumnRenamed("with_stop", "n_type")
    real_stop = counted.filter(F.col("stop") & F.col("after").isNotNull())
    follow = real_stop.groupBy("type", "after").agg(F.sum("n").cast("double").alias("both")).filter(F.col("both") >= SEEN)
    size = F.lit(float(total))
    sums = lambda name: types.select(F.col("type").alias(name), F.col("n").cast("double").alias(f"n_{name}"))
    ends = real_stop.join(abbreviations, "type", "left_anti").groupBy(F.col("after").alias("type")).agg(F.sum("n").cast("double").alias("both")).filter(F.col("both") >= SEEN)
    starting = ends.join(sums("type"), "type").filter(F.col("type").rlike(r"^\p{L}"))
    starters = best(starting, log_likelihood(F.col("both"), F.lit(float(stops)), F.col("n_type"), size), STARTER, "starters", "type")
    pair_rows = follow.join(known, "type").join(starters.select(F.col("type").alias("after")), "after", "left_anti").join(sums("after"), "after")
    collocations = best(pair_rows, log_likelihood(F.col("both"), F.col("n_type").cast("double"), F.col("n_after"), size), COLLOCATION, "collocations", "type", "after")
    return Splitter(_kept(abbreviations.select("type")), _kept(collocations), _kept(starters))


def split_trained(text: Column, splitter: Splitter) -> Column:
    """Sentences of a text, by a trained splitter."""
    ship_here()

    @F.arrow_udf(types.ArrayType(types.StringType()))
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((splitter.split(t) for (t,) in slices(texts)), pa.list_(pa.string()))

    return split(text)
