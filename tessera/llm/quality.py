"""Quality classifier: supervised subword embeddings.

A document is the mean of the learnt vectors of its hashed words and byte
n-grams; a softmax over that mean gives the classes.  Training is stochastic
gradient descent in numpy on a bounded sample.  Because the mean and the
output layer are linear, each hashed feature folds into one logit, so scoring
a document is a gather and a mean over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashed_words import Window, mix, spaced
from tessera.llm.labelled import SAMPLE_ROWS, held_out, sample
from tessera.llm.shared import small_batches, text_windows

#: Hashed features, vector length, n-gram lengths in bytes.
BITS, WIDTH, NGRAMS = 16, 8, (3, 4)
#: The two extra features: a word equal to the one before it, and one unlike it.
_REPEATED, _FRESH = 1 << BITS, (1 << BITS) + 1
SIZE = (1 << BITS) + 2
#: Features without weight that every text has besides its own: very short texts stay near the bias.
PRIOR = 20
STEPS = 20_000
THRESHOLD = 0.3


def _features(window: Window) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(byte positions, feature ids) of words, of repeats and of each n-gram length."""
    words = window.words()
    yield window.starts, mix(words, BITS)
    if len(words):
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (window.doc[1:] == window.doc[:-1])
        yield window.starts, np.where(same, _REPEATED, _FRESH)
    for n in NGRAMS:
        h, valid = window.ngrams(n)
        at = np.flatnonzero(valid)
        yield at, mix(h[at], BITS)


@dataclass
class Model:
    """The folded model: a logit for each feature, and the bias."""

    logit: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of class 1; a text without words gets the bias alone."""
        window = Window(texts, spaced())
        total, count = np.zeros(len(window.bytes)), np.zeros(len(window.bytes))
        for at, ids in _features(window):
            total[at] += self.logit[ids]
            count[at] += 1
        mean = window.sums(total) / (window.sums(count) + PRIOR)
        return 1 / (1 + np.exp(-(mean + self.bias)))


def fit(rows: list[tuple[bytes, int]], steps: int = STEPS, rate: float = 0.5, seed: int = 7) -> Model:
    """Train on (text, 0 or 1) pairs; without both classes the score is the smoothed class share."""
    labels = np.array([y for _, y in rows], np.int64)
    ones = int(labels.sum())
    if not 0 < ones < len(rows):
        return Model(np.zeros(SIZE, np.float32), float(np.log((ones + 1) / (len(rows) - ones + 1))))
    bags = []
    for text, _ in rows:
        ids = np.concatenate([f for _, f in _features(Window([text], spaced()))])
        ids, n = np.unique(ids, return_counts=True)
        bags.append((ids, (n / (n.sum() + PRIOR)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (SIZE, WIDTH)).astype(np.float32)
    output, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    order = np.concatenate([rng.permutation(len(rows)) for _ in range(-(-steps // len(rows)))])[:steps]
    for t, i in enumerate(order):
        ids, share = bags[i]
        if not len(ids):
            continue
        now = rate * (1 - t / steps)
        own = vectors[ids]
        hidden = share @ own
        z = output @ hidden + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[labels[i]] -= 1
        back = p @ output
        output -= now * np.outer(p, hidden)
        bias -= now * 0.1 * p
        # the mean spreads the gradient; scaling by the number of features keeps steps of useful size
        vectors[ids] = own - now * np.outer(np.minimum(share * 50, 1), back)
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def _scored(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_windows(batches, 2 << 20):
            scores = model.scores(texts.cast(pa.binary()).to_pylist())
            yield pa.record_batch([ids, pa.array(scores, pa.float64())], schema=schema)

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    Null texts are empty; an empty text gets the bias alone.  Repeated rows
    get equal results; with no usable label every score is 0.5.  A score is a
    function of the text only.
    """
    small_batches(docs.sparkSession)
    model = fit(sample(docs, labels, "quality", rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scored(model), "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    small_batches(docs.sparkSession)
    model, at = fit(sample(docs, labels, "quality", rows)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = model.scores([t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()])
                yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
