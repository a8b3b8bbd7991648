"""Toxicity severity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - c_k): one sparse weight vector is shared by all
ordered thresholds.  x marks the distinct hashed words of a text and holds the
density of word beginnings, which stand for stems in inflecting languages.
Weights are fitted by proximal gradient steps in numpy on a bounded sample;
the L1 step leaves most of them at exactly zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashed_words import Window, letters, mix
from tessera.llm.labelled import SAMPLE_ROWS, held_out, sample
from tessera.llm.shared import small_batches, text_windows

BITS = 20
#: Bytes of the word beginnings that count.
STEMS = (4, 5, 6)
SIZE = (1 + len(STEMS)) << BITS
GRADES = 4
THRESHOLD = 0.35


def _features(texts: list[bytes], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature id, value) of the non-zero features, of those marked in ``known`` if given.

    A word counts once; a beginning by the logarithm of its density, so that
    chance hits in long texts stay small.
    """
    window = Window(texts, letters())
    words = window.words()
    per_text = np.bincount(window.doc, minlength=len(texts))
    docs, ids = [window.doc], [mix(words, BITS)]
    for k, n in enumerate(STEMS, 1):
        long = np.flatnonzero(window.ends - window.starts > n)
        docs.append(window.doc[long])
        ids.append((k << BITS) | mix(window.beginnings(long, n), BITS))
    doc, feature = np.concatenate(docs), np.concatenate(ids)
    if known is not None:
        hit = known[feature]
        doc, feature = doc[hit], feature[hit]
    both, n = np.unique(doc * SIZE + feature, return_counts=True)
    doc, feature = both // SIZE, both % SIZE
    value = np.where(feature >> BITS == 0, 1.0, np.log1p(100 * n / (per_text[doc] + 20)))
    return doc, feature, value


def _of_sample(rows: list[tuple[bytes, int]], at_once: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_features`` of all texts of a sample, a few at a time to bound the memory."""
    parts = []
    for k in range(0, len(rows), at_once):
        doc, feature, value = _features([t for t, _ in rows[k : k + at_once]])
        parts.append(((doc + k).astype(np.int32), feature.astype(np.int32), value.astype(np.float32)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    """Non-zero weights by sorted feature id, and the ordered thresholds."""

    ids: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        known = np.zeros(SIZE, bool)
        known[self.ids] = True
        doc, feature, value = _features(texts, known)
        score = np.bincount(doc, self.weights[np.searchsorted(self.ids, feature)] * value, len(texts)) if len(doc) else np.zeros(len(texts))
        return _sigmoid(score[:, None] - self.cuts)


def severity_grades(rows: list[tuple[bytes, int]], grades: int = GRADES) -> np.ndarray:
    """Ordered grades from two-valued labels: 0 for clean texts, 1 and up for toxic ones.

    A toxic text's grade is the quantile, among toxic texts, of its number of
    telling features: those at least 20 times likelier in toxic texts.
    """
    labels = np.array([y for _, y in rows], np.int64)
    out = np.zeros(len(rows), np.int64)
    toxic = np.flatnonzero(labels > 0)
    if not len(toxic):
        return out
    doc, feature, _ = _of_sample(rows)
    ids, code = np.unique(feature, return_inverse=True)
    bad = np.bincount(code, labels[doc] > 0, len(ids))
    good = np.bincount(code, labels[doc] == 0, len(ids))
    telling = ((bad + 0.1) / len(toxic) >= 20 * (good + 0.1) / max(1, len(rows) - len(toxic))) & (bad >= 3)
    hits = np.bincount(doc, telling[code], len(rows))[toxic]
    edges = np.quantile(hits, np.linspace(0, 1, grades)[1:-1])
    out[toxic] = 1 + np.searchsorted(edges, hits, "left")
    return out


def fit(rows: list[tuple[bytes, int]], grades: np.ndarray, top: int = GRADES, rounds: int = 250, penalty: float = 1e-4) -> Model:
    """Accelerated proximal gradient descent; rare and untelling features take no part.

    With a single grade in the sample no feature has weight.
    """
    levels, n, y = top - 1, max(1, len(rows)), np.asarray(grades)
    over = np.array([(y > k).sum() + 0.5 for k in range(levels)])
    cuts = np.log((n + 1 - over) / over)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), cuts)
    doc, feature, value = _of_sample(rows)
    ids, code, count = np.unique(feature, return_inverse=True, return_counts=True)
    # screening: a feature takes part if its mean in graded texts stands out from its mean in clean ones
    graded = y > 0
    n1, n0 = graded.sum(), n - graded.sum()
    sums = [np.bincount(code, np.where(graded[doc] == g, v, 0.0), len(ids)) for g in (True, False) for v in (value, value * value)]
    spread = (sums[1] + sums[3]) / n - ((sums[0] + sums[2]) / n) ** 2
    z = np.abs(sums[0] / n1 - sums[2] / n0) / np.sqrt(np.maximum(spread, 1e-12) * (1 / n1 + 1 / n0))
    keep = ((count >= 3) & (z >= 5))[code]
    doc, value, feature = doc[keep], value[keep], feature[keep]
    ids, code = np.unique(feature, return_inverse=True)
    # steps bounded by the curvature of a feature together with those it appears with
    beside = np.bincount(doc, value, n)
    step = 4 * n / np.maximum(np.bincount(code, value * beside[doc], len(ids)), 1e-9)
    w, fast = np.zeros(len(ids)), np.zeros(len(ids))
    for t in range(rounds):
        p = _sigmoid(np.bincount(doc, fast[code] * value, n)[:, None] - cuts)
        # a grade's likelihood is above(g-1) - above(g); the derivative of its logarithm is 1 - above(g-1) - above(g)
        up = np.concatenate([np.ones((n, 1)), p], 1)[np.arange(n), y]
        down = np.concatenate([p, np.zeros((n, 1))], 1)[np.arange(n), y]
        new = fast + step * np.bincount(code, (1 - up - down)[doc] * value, len(ids)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        fast, w = new + min(0.9, t / (t + 3)) * (new - w), new
        each = np.maximum(up - down, 1e-6)
        for k in range(levels):
            q = p[:, k] * (1 - p[:, k])
            pull = (np.where(y == k, q / each, 0) - np.where(y == k + 1, q / each, 0)).mean()
            cuts[k] += np.clip(pull / (q.mean() + 0.02) * 0.3, -0.3, 0.3)
        cuts = np.maximum.accumulate(cuts + np.arange(levels) * 1e-6)
    kept = np.abs(w) > 1e-6
    return Model(ids[kept], w[kept], cuts)


def _scored(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("expected_severity", pa.float64()), ("toxic_probability", pa.float64()), ("grade", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_windows(batches, 2 << 20):
            above = model.above(texts.cast(pa.binary()).to_pylist())
            each = np.concatenate([np.ones((len(above), 1)), above], 1) - np.concatenate([above, np.zeros((len(above), 1))], 1)
            yield pa.record_batch([ids, pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(each.argmax(1).astype(np.int32))], schema=schema)

    return run


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, expected_severity, toxic_probability, grade, toxic.

    ``labels.toxic`` has two values, so grades are derived (severity_grades).
    Null and empty texts have no features and get the rates of the thresholds.  Repeated rows
    get equal results; with no usable label no feature has weight.
    """
    small_batches(docs.sparkSession)
    known = sample(docs, labels, "toxic", rows)
    model = fit(known, severity_grades(known))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_scored(model), "doc_id long, expected_severity double, toxic_probability double, grade int")
    return scored.select("doc_id", held_out().alias("held_out"), "expected_severity", "toxic_probability", "grade", (F.col("toxic_probability") >= threshold).cast("int").alias("toxic"))
