"""Quality classifier: a generalised additive model with pairwise interactions.

Features describe a whole text (never its labels, language, source or id).  Each feature is cut into
bins; cyclic boosting takes the features in turn and adds a shallow tree, over the bins of that feature
alone, to the feature's lookup table.  The pairs of features with the largest gain on what is left then
get two-way tables, boosted by trees of one cut on either side.  A score is the sum of the table cells of
a text's bins, by vectorised lookups and additions, through the logistic function.

The model is trained on the driver, on features of at most ``TRAIN_ROWS`` labelled documents: those of
the smallest id hash.  Which rows may train is a filter of the caller.  With no labelled rows, or one
class only, every score is that class's share (0.5 if there are none).

Null and empty texts are scored like any other, as are repeated rows and null ids (which train nothing).  An id with
both labels trains nothing; of rows of one id the least features train.  Extra columns are left alone.  An empty
table gives no rows, and trains a model of no labels.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import hash_sample, pairs

TRAIN_ROWS = 20_000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 250, 60, 0.1, 3

FEATURES = (
    "log_chars", "log_words", "log_lines", "word_length", "word_length_spread", "upper", "digits", "punctuation", "symbols", "non_ascii",
    "blanks", "bars", "exclaims", "distinct_words", "top_word", "repeated_next", "distinct_lines", "words_per_line", "odd_words", "shouted_words",
    "short_words", "sentence_words", "longest_word", "distinct_pairs", "capital_words", "bare_lines",
)
_BYTES = {
    "upper": range(65, 91), "digits": range(48, 58), "punctuation": b".,;:?!'\"()-", "symbols": b"#$%&*+/<=>@[\\]^_`{|}~", "non_ascii": range(128, 256),
    "blanks": b" \t\n\r", "bars": b"|", "exclaims": b"!", "stops": b".!?", "lower": range(97, 123),
}
_COUNTERS = np.zeros((256, len(_BYTES)))
for _i, _set in enumerate(_BYTES.values()):
    _COUNTERS[list(_set), _i] = 1


def features(text: str | None) -> list[float]:
    """The numbers of FEATURES, in that order."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    count = dict(zip(_BYTES, (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _COUNTERS).tolist(), strict=True))
    size = max(1, len(data))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    frequency: dict[str, int] = {}
    for w in words:
        frequency[w] = frequency.get(w, 0) + 1
    repeated = sum(map(operator.eq, words, words[1:]))
    couples = len(set(zip(words, words[1:], strict=False)))
    filled = [line for line in lines if line]
    stripped = [w.strip(".,;:?!'\"()-") for w in frequency]
    plain = sum(k for w, k in zip(stripped, frequency.values(), strict=True) if w.isalpha())
    shouted = sum(k for w, k in zip(stripped, frequency.values(), strict=True) if len(w) > 1 and w.isupper())
    capital = sum(k for w, k in zip(stripped, frequency.values(), strict=True) if w[:1].isupper())
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), count["upper"] / size, count["digits"] / size, count["punctuation"] / size, count["symbols"] / size, count["non_ascii"] / size,
        count["blanks"] / size, count["bars"] / n, count["exclaims"] / n, len(frequency) / n, max(frequency.values(), default=0) / n, repeated / n, len(set(filled)) / max(1, len(filled)), len(words) / max(1, len(filled)), 1 - plain / n, shouted / n,
        float((lengths <= 3).mean()), len(words) / (1 + count["stops"]), float(min(lengths.max(), 1000)), couples / n, capital / n, sum(len(x) < 20 for x in filled) / max(1, len(filled)),
    ]


class AdditiveModel:
    """Bin edges, one table for each feature, two-way tables for some pairs."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.coarse: list[np.ndarray] = [np.zeros(len(e) + 1, np.int64) for e in edges]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[b[:, j]]
        for i, j, table in self.pairs:
            out += table[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _leaves(g: np.ndarray, h: np.ndarray, most: int) -> np.ndarray:
    """Steps of a tree of at most ``most`` leaves over consecutive bins: sum(g) / sum(h) of each leaf."""
    cuts = [(0, len(g))]
    gs, hs = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        k = np.arange(a + 1, b)
        left, right = (gs[k] - gs[a]) ** 2 / (hs[k] - hs[a] + 1), (gs[b] - gs[k]) ** 2 / (hs[b] - hs[k] + 1)
        gain = left + right - (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + 1)
        at = int(gain.argmax())
        return float(gain[at]), int(k[at])

    while len(cuts) < most:
        gain, k, i = max((*best(a, b), i) for i, (a, b) in enumerate(cuts))
        if gain <= 1e-9:
            break
        a, b = cuts.pop(i)
        cuts += [(a, k), (k, b)]
    out = np.empty(len(g))
    for a, b in cuts:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best single cut on either side of a grid: (gain, steps)."""
    gs, hs = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))

    def part(s: np.ndarray) -> list[np.ndarray]:
        a, top, left, total = s[1:-1, 1:-1], s[1:-1, -1:], s[-1:, 1:-1], s[-1, -1]
        return [a, top - a, left - a, total - top - left + a]

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gq, hq = part(gs), part(hs)
    value = sum(x * x / (y + 1) for x, y in zip(gq, hq, strict=True))
    i, j = np.unravel_index(int(value.argmax()), value.shape)
    out = np.empty_like(g)
    for (rows, cols), x, y in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), gq, hq, strict=True):
        out[rows, cols] = np.broadcast_to(x, value.shape)[i, j] / (np.broadcast_to(y, value.shape)[i, j] + 1)
    return float(value[i, j] - gs[-1, -1] ** 2 / (hs[-1, -1] + 1)), out


def train(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """x: rows by features; y: 0 or 1."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
    base = float(np.log(share / (1 - share)))
    columns = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if len(y) < 2 or y.min() == y.max():
        return AdditiveModel([np.empty(0)] * columns, base)
    model = AdditiveModel([np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(columns)], base)
    b = model.bins(x)
    margin = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(columns):
            g, h = slopes()
            n = len(model.tables[j])
            step = RATE * _leaves(np.bincount(b[:, j], g, n), np.bincount(b[:, j], h, n), LEAVES)
            model.tables[j] += step
            margin += step[b[:, j]]
    model.coarse = [np.arange(len(t)) * PAIR_BINS // max(PAIR_BINS, len(t)) for t in model.tables]
    c = np.stack([m[b[:, j]] for j, m in enumerate(model.coarse)], axis=1)
    sides = [int(m.max()) + 1 for m in model.coarse]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(c[:, i] * sides[j] + c[:, j], v, sides[i] * sides[j]).reshape(sides[i], sides[j])

    g, h = slopes()
    gains = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(columns) for j in range(i + 1, columns)), reverse=True)
    model.pairs = [(i, j, np.zeros((sides[i], sides[j]))) for gain, i, j in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            margin += step[c[:, i], c[:, j]]
    return model


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2_000):
                part = batch.slice(i, 2_000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([features(t) for _, t in pairs([part])], pa.list_(pa.float64()))], names=["doc_id", "features"])

    return _plain(docs, id_col, text_col).mapInArrow(run, "doc_id long, features array<double>")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, may_train: Column | None = None, label_col: str = "quality", rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """labels (doc_id, label_col); may_train: a condition on doc_id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    own = own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    chosen = hash_sample(own.filter(may_train) if may_train is not None else own, "doc_id", rows)
    texts = _plain(docs, id_col, text_col).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")  # at most ``rows`` ids
    label = {r["doc_id"]: r["label"] for r in chosen.collect()}
    found = sorted((r["doc_id"], r["features"]) for r in with_features(texts).groupBy("doc_id").agg(F.min("features").alias("features")).collect())  # at most ``rows``
    x = np.array([f for _, f in found], np.float64).reshape(-1, len(FEATURES))
    return train(x, np.array([label[i] for i, _ in found], np.float64))


def score_documents(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, score double, predicted int, carry (a struct of the columns named in ``carry``)."""
    own = (F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.struct(F.lit(0).alias("none"))).alias("carry")
    whole = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2_000):
                part = batch.slice(i, 2_000)
                if part.num_rows:
                    score = model.score(np.array([features(t) for _, t in pairs([part.select([0, 1])])]))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), part.column(2)], names=["doc_id", "score", "predicted", "carry"])

    kind = whole.schema["carry"].dataType.simpleString()
    return whole.mapInArrow(run, f"doc_id long, score double, predicted int, carry {kind}")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; rows with crc32 of the id's text mod 4 equal to 2 don't train."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id")))
    return score_documents(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
