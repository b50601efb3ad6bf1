"""Topics as distributions: a text's shares of all topics, from latent Dirichlet allocation or from distances to centres."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.operators.prepare import with_text
from quire.operators.topics import terms, vocabulary_of
from quire.shipping import ship
from quire.storage import written

#: What is added to each count of a topic in a text and of a word in a topic (Dirichlet priors of 1.1, at their mode).
PRIOR = 0.1
#: Rounds of a text's shares within a pass, and entries that a task works on at once.
ROUNDS, ENTRIES = 30, 100_000
#: Entries of texts of like length that are multiplied at once (a core's cache holds them), how many times its shortest text the longest may be, and words counted at once.
ROOM, LONGER, WORDS = 1 << 14, 1.25, 1 << 20


@dataclass(frozen=True)
class TopicMixture:
    """Latent Dirichlet allocation over a bounded vocabulary of words.  ``perplexity`` is that of every second word of the texts held out, by the shares that their other words give (None without any).

    ``weights`` (words x topics; a topic's add up to 1) come from expectation maximisation over all texts: a pass settles each text's shares under
    the weights so far, in the task that reads it, and adds up words x topics numbers; texts have no state, and only the counts of their words are shuffled, once."""

    weights: np.ndarray
    words: list[str]
    topics: int
    perplexity: float | None

    @classmethod
    def fit(cls, papers: DataFrame, topics: int = 10, held_out: int = 10, passes: int = 20, config: EngineConfig = EngineConfig()) -> TopicMixture:
        """Learns from the papers with a text; every ``held_out``-th by the hash of its id only measures the model."""
        return cls.fit_shares(papers, topics, held_out, passes, config)[0]

    @classmethod
    def fit_shares(cls, papers: DataFrame, topics: int = 10, held_out: int = 10, passes: int = 20, config: EngineConfig = EngineConfig()) -> tuple[TopicMixture, DataFrame]:
        """What ``fit`` learns, with the ``shares`` of the same papers; the texts are read once for both."""
        rows = with_text(papers).select("pmid", "text_content")
        ship(rows.sparkSession)
        texts = written(rows.select("pmid", terms(F.col("text_content")).alias("words")), "terms")
        found = texts.select("pmid", F.col("words").alias("t"))
        words = [r["word"] for r in vocabulary_of(found, texts.select("pmid"), 2, config.vocabulary_size, _tallied).collect()] or [""]
        held = F.coalesce(F.pmod(F.xxhash64("pmid"), F.lit(held_out)) == 0, F.lit(False))
        counted = _placed(texts, words).withColumn("held", held)
        counted = written(counted.repartition(rows.sparkSession.sparkContext.defaultParallelism), "counted")  # alike for all cores, as each pass waits for the last task
        learnt = counted.filter(~F.col("held")).select("places", "counts")
        weights = _weights(np.random.default_rng(config.seed).gamma(100.0, 0.01, (len(words), topics)))
        for _ in range(passes):
            weights = _weights(_expected(learnt, weights))
        mixture = cls(weights, words, topics, None)
        mixture = cls(weights, words, topics, mixture._perplexity(_placed(texts.filter(held), words, True)))
        return mixture, mixture._shares(counted.select("pmid", "places", "counts"))

    def perplexity_of(self, rows: DataFrame) -> float | None:
        """Of (pmid, text_content): every second known word, under the topics' shares by the others."""
        return self._perplexity(_counted(rows, self.words, True))

    def _perplexity(self, counted: DataFrame) -> float | None:
        weights = self.weights

        def run(batches):
            for batch in batches:
                total, n = 0.0, 0
                for a, b, at, counts, offsets in _blocks(batch, "places", "counts"):
                    shares = _settled(weights, at, counts, offsets)[0]
                    asked, times, begin = _part(batch, "asked", "times", a, b)
                    chance = (shares[np.repeat(np.arange(b - a), np.diff(begin))] * weights[asked]).sum(axis=1)
                    total, n = total + float(times @ np.log(np.maximum(chance, 1e-300))), n + float(times.sum())
                yield pa.RecordBatch.from_pydict({"total": [total], "n": [n]})

        total, n = counted.mapInArrow(run, "total double, n double").agg(F.sum("total"), F.sum("n")).first()
        return math.exp(-total / n) if n else None

    def shares(self, papers: DataFrame) -> DataFrame:
        """(pmid, shares array<double>): of every paper with a text what each topic has of it, in all 1; without a known word all topics share alike."""
        return self._shares(_counted(with_text(papers).select("pmid", "text_content"), self.words))

    def _shares(self, counted: DataFrame) -> DataFrame:
        weights, topics = self.weights, self.topics

        def run(batches):
            for batch in batches:
                found = [_settled(weights, at, counts, offsets)[0] for _, _, at, counts, offsets in _blocks(batch, "places", "counts")]
                flat = np.concatenate(found).ravel() if found else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column("pmid"), pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * topics, flat)], ["pmid", "shares"])

        return counted.mapInArrow(run, f"pmid {counted.schema['pmid'].dataType.simpleString()}, shares array<double>")

    def topic_words(self, n: int = 10) -> DataFrame:
        """(topic_id, rank, word, weight): the words of greatest weight, a topic's weights in all 1."""
        from pyspark.sql import SparkSession

        rows = [(t, i + 1, self.words[w], float(self.weights[w, t])) for t in range(self.topics) for i, w in enumerate(np.argsort(-self.weights[:, t], kind="stable")[:n])]
        return SparkSession.active().createDataFrame(rows, "topic_id int, rank int, word string, weight double")


def _weights(counts: np.ndarray) -> np.ndarray:
    return (counts + PRIOR) / (counts + PRIOR).sum(axis=0)


def _lists(keys: np.ndarray, width: int, n: int) -> tuple[pa.Array, pa.Array]:
    """The places and counts of n rows from keys row * width + place."""
    own, counts = np.unique(keys, return_counts=True)
    offsets = pa.array(np.searchsorted(own // width, np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array((own % width).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.float64)))


def _counted(rows: DataFrame, words: list[str], halves: bool = False) -> DataFrame:
    """(pmid, places, counts) of the known words of (pmid, text_content); with halves of every second one, and (asked, times) of the others."""
    return _placed(rows.select("pmid", terms(F.col("text_content")).alias("words")), words, halves)


def _coded(lists: pa.Array):
    """(first row, last, each word's row, each word's place among the different ones, these) of rows of about WORDS words."""
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    a = 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + WORDS, "right")) - 1)
        coded = lists.slice(a, b - a).flatten().dictionary_encode()
        yield a, b, np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1])), coded.indices.to_numpy().astype(np.int64), coded.dictionary
        a = b


def _tallied(texts: DataFrame) -> DataFrame:
    """(word, n, df) of texts (t): how often and in how many of some of the texts; a word comes once for these."""

    def run(batches):
        for batch in batches:
            for _, _, row, code, each in _coded(batch.column(0)):
                texts_of = np.unique(row * len(each) + code) % max(len(each), 1)
                yield pa.RecordBatch.from_arrays([each, *(pa.array(np.bincount(x, minlength=len(each))) for x in (code, texts_of))], ["word", "n", "df"])

    return texts.select("t").mapInArrow(run, "word string, n long, df long")


def _placed(texts: DataFrame, words: list[str], halves: bool = False) -> DataFrame:
    """``_counted`` of texts that are terms already: (pmid, words)."""
    names = ["pmid", "places", "counts"] + ["asked", "times"] * halves

    def run(batches):
        for batch in batches:
            for a, b, row, code, each in _coded(batch.column(1)):
                place = pc.fill_null(pc.index_in(each, value_set=pa.array(words, each.type)), -1).to_numpy(zero_copy_only=False)[code]
                row, place = row[place >= 0], place[place >= 0]
                keys, turn = row * len(words) + place, np.arange(len(row)) - np.searchsorted(row, row)
                parts = [keys[turn % 2 == 0], keys[turn % 2 == 1]] if halves else [keys]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(x for k in parts for x in _lists(k, len(words), b - a))], names)

    schema = f"pmid {texts.schema['pmid'].dataType.simpleString()}, places array<int>, counts array<double>" + ", asked array<int>, times array<double>" * halves
    return texts.select("pmid", "words").mapInArrow(run, schema)


def _part(batch: pa.RecordBatch, places: str, counts: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, values = batch.column(places).slice(a, b - a), batch.column(counts).slice(a, b - a)
    offsets = at.offsets.to_numpy()
    return at.flatten().to_numpy(), values.flatten().to_numpy(), offsets - offsets[0]


def _blocks(batch: pa.RecordBatch, places: str, counts: str):
    """(first row, last, places, counts, offsets) of rows of about ENTRIES entries."""
    ends, a = batch.column(places).offsets.to_numpy(), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + ENTRIES, "right")) - 1)
        yield a, b, *_part(batch, places, counts, a, b)
        a = b


def _alike(sizes: np.ndarray):
    """(rows, size of the largest) of rows of like sizes, ROOM entries or one row; rows without any are left out."""
    order = np.argsort(sizes, kind="stable")
    order = order[np.searchsorted(sizes[order], 1) :]
    ordered, a = sizes[order], 0
    while a < len(order):
        b = int(np.searchsorted(ordered, ordered[a] * LONGER, "right"))
        b = min(b, a + max(1, ROOM // int(ordered[b - 1])))
        yield order[a:b], int(ordered[b - 1])
        a = b


def _settled(weights: np.ndarray, at: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each row's shares of the topics, each entry's counts by topic) after ROUNDS rounds, whatever other rows there are.

    Rows of like sizes are multiplied as one block, the shorter ones filled up with entries that count nought."""
    sizes, topics = np.diff(offsets), weights.shape[1]
    shares, parts = np.full((len(sizes), topics), 1 / topics), np.zeros((len(at), topics))
    for rows, size in _alike(sizes):
        live = np.arange(size) < sizes[rows, None]
        entries = np.where(live, offsets[rows, None] + np.arange(size), 0)
        held, times, new = weights[at[entries]], np.where(live, counts[entries], 0.0), shares[rows]
        for _ in range(ROUNDS):
            old = new
            each = times / np.matmul(held, old[:, :, None])[:, :, 0]
            new = PRIOR + old * np.matmul(each[:, None, :], held)[:, 0, :]
            new /= new.sum(axis=1, keepdims=True)
        shares[rows], parts[entries[live]] = new, (held * old[:, None, :] * each[:, :, None])[live]
    return shares, parts


def _expected(counted: DataFrame, weights: np.ndarray) -> np.ndarray:
    """The expected counts, words x topics, over all rows (places, counts)."""

    def run(batches):
        total = np.zeros_like(weights)
        for batch in batches:
            for _, _, at, counts, offsets in _blocks(batch, "places", "counts"):
                parts = _settled(weights, at, counts, offsets)[1]
                for t in range(weights.shape[1] if len(parts) else 0):
                    total[:, t] += np.bincount(at, parts[:, t], len(weights))
        own = np.flatnonzero(total.any(axis=1)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"place": own, "sums": pa.array(list(total[own]), pa.list_(pa.float64()))})

    out = np.zeros_like(weights)
    sums = counted.mapInArrow(run, "place int, sums array<double>").groupBy("place").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    for r in sums.collect():  # a row a word
        out[r["place"]] = r["sums"]
    return out


def soft_assignments(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(pmid, topic_id, probability) for every topic of centres (topic_id, centre; as many as topics): softmax of the negative squared distances."""
    each = centres.orderBy("topic_id").collect()
    if not each:
        return vectors.select("pmid", F.lit(None).cast("int").alias("topic_id"), F.lit(None).cast("double").alias("probability")).limit(0)
    points = F.lit([[float(x) for x in r["centre"]] for r in each])
    distance = F.transform(points, lambda c: F.aggregate(F.zip_with(F.col("embedding"), c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, d: s + d))
    rows = vectors.filter(F.col("embedding").isNotNull()).select("pmid", distance.alias("d")).withColumn("least", F.array_min("d"))
    weights = rows.select("pmid", F.transform("d", lambda x: F.exp(F.col("least") - x)).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    names = F.lit([r["topic_id"] for r in each])
    shares = F.transform("w", lambda x: x / F.col("total"))
    return weights.withColumn("total", total).select("pmid", F.explode(F.arrays_zip(names.alias("topic_id"), shares.alias("probability"))).alias("p")).select("pmid", "p.topic_id", "p.probability")
