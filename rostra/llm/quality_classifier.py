"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL, scored as sparse dot products."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import text_or_empty
from ._words import SMALL_SLICE, Words, as_bytes, give_back, mix64, slices, tidy

BITS, THRESHOLD = 18, 0.7
#: At most so many labelled documents are learned from: those whose hashed doc_id is smallest.
MAX_TRAIN = 8000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 2.0, 1.0, 1e-4, 1e-4

_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> bytes:
    """Letters become a or A, digits 0; runs become one: `Thnd***` gives `Aa*`."""
    return _RUN.sub(rb"\1", word.translate(_SHAPE))


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds): hashed n-grams of each text's words in four equal streams: words, pairs of words, shapes, pairs of
    shapes, where a word that repeats the one before it has the shape `=`. An occurrence counts 1 / words of the text."""
    w = Words(data, offsets, lower=False)
    word = w.hashes()[w.codes]
    shapes = {}
    h = xxhash.xxh3_64_intdigest
    of = np.fromiter((shapes.get(s) or shapes.setdefault(s, h(b"s" + s)) for s in map(shape, w.vocabulary)), np.uint64, len(w.words))[w.codes]
    first = np.zeros(len(word), bool)
    first[w.bounds[:-1][w.bounds[:-1] < len(word)]] = True
    before, before_shape = np.roll(word, 1), np.roll(of, 1)
    before[first] = before_shape[first] = 0
    of = np.where((word == before) & ~first, np.uint64(h(b"=")), of)
    mask, mul = np.uint64((1 << bits) - 1), np.uint64(0x9E3779B97F4A7C15)
    streams = [mix64(word), mix64(word + before * mul), mix64(of), mix64(of + before_shape * mul)]
    return np.stack([(s & mask).astype(np.int32) for s in streams]), w.bounds


def means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The mean of values[bounds[i]:bounds[i + 1]], 0 for none."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    n = np.diff(bounds)
    return np.where(n > 0, (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1), 0.0)


class Ftrl:
    """FTRL-proximal with L1 and L2 (per-coordinate rates), the bias at the last place."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def train_batches(bits: int, epochs: int):
    def run(batches):
        examples = []  # buckets, how often, words, label: counts as narrow as they go
        for batch in batches:
            data, offsets = as_bytes(batch.column(0))
            labels = batch.column(1).to_pylist()
            for first, part, cuts in slices(data, offsets, SMALL_SLICE):
                buckets, bounds = features(part, cuts, bits)
                for i in range(len(cuts) - 1):
                    at, times = np.unique(buckets[:, bounds[i] : bounds[i + 1]], return_counts=True)
                    times = times.astype(np.min_scalar_type(times.max(initial=0)))
                    examples.append((at, times, max(1, bounds[i + 1] - bounds[i]), float(labels[first + i])))
                del buckets
                give_back()
        model = Ftrl((1 << bits) + 1)
        for _ in range(epochs):
            for at, times, n, label in examples:
                model.learn(np.append(at, 1 << bits), np.append(times.astype(np.int64) / n, 1.0), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()])], names=["weights"])

    return run


def held_out(column, modulus: int = 4, remainder: int = 2):
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, bits: int = BITS, epochs: int = EPOCHS) -> bytes:
    """The weights (float32, bias last) learned in one task from at most max_train labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).filter("k is not null and y in (0, 1)").filter(~held_out(F.col("k")))
    known = known.groupBy("k").agg(F.min("y").alias("y")).withColumn("o", F.xxhash64("k")).orderBy("o", "k").limit(max_train)
    texts = docs.select(F.col(id_col).alias("k"), text_or_empty(text_col).alias("text"))
    rows = texts.join(F.broadcast(known), "k").select("text", "y", "o", "k").repartition(1).sortWithinPartitions("o", "k", "text")
    found = rows.select("text", "y").mapInArrow(tidy(train_batches(bits, epochs)), "weights binary").collect()
    return bytes(found[0][0]) if found else np.zeros((1 << bits) + 1, "<f4").tobytes()


def score_batches(weights: bytes, bits: int, place: int | None = None):
    """Arrow batches (text, body) to body and score. place: where in the body the text is, if there is no column for it."""

    def run(batches):
        w = np.frombuffer(weights, "<f4")
        for batch in batches:
            data, offsets = as_bytes(batch.column(0) if place is None else batch.column(0).field(place))
            out = []
            for _, part, cuts in slices(data, offsets, SMALL_SLICE):
                buckets, bounds = features(part, cuts, bits)
                dot = sum(means(w[b], bounds) for b in buckets) + w[-1]
                out.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))))
                del buckets
                give_back()
            scores = pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.columns[-1], scores], names=[batch.schema.names[-1], "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_train: int = MAX_TRAIN, bits: int = BITS) -> DataFrame:
    """Scores every whole text; only its words enter the score.

    Returns all columns of docs in their order under `body` (a struct), with held_out, score (0 to 1, higher: label 1
    likelier) and predicted (1 if score >= threshold). Null and empty texts have no words and get the bias. Of several
    labels for one doc_id the smallest counts; null labels do not. Without any label all scores are 0.5. Rows stay apart
    even if repeated. An empty table gives an empty result.
    """
    weights = train(docs, labels, id_col, text_col, max_train=max_train, bits=bits)
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # a text that is a string already goes to Python once, in the body
    place = next((i for i, c in enumerate(docs.dtypes) if c == (text_col, "string")), None)
    rows = docs.select(*([text_or_empty(text_col).alias("text")] if place is None else []), body.alias("body"))
    schema = rows.schema["body"]
    from pyspark.sql.types import DoubleType, StructField, StructType

    scored = rows.mapInArrow(tidy(score_batches(weights, bits, place)), StructType([schema, StructField("score", DoubleType())]))
    return scored.select("body", held_out(F.col(f"body.`{id_col}`")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
