import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hashed_words, quality, toxicity
from tessera.llm.labelled import held_out, sample

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_rows(larger):
    docs, labels = larger
    got = quality.quality_scores(docs, labels).cache()
    assert got.count() == docs.count() and got.where("score < 0 OR score > 1 OR predicted <> cast(score >= 0.3 AS int)").count() == 0
    both = got.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in both]) >= 0.95
    assert np.mean([r["predicted"] for r in both if r["quality"] == 1]) >= 0.97


def test_held_out_rule_and_leak(larger):
    docs, labels = larger
    got = {r["doc_id"]: r["h"] for r in docs.select("doc_id", held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.items())
    known = sample(docs, labels, "quality", 10_000)
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert known == sample(docs, flipped, "quality", 10_000)
    assert len(sample(docs, labels, "quality", 50)) == 50


def test_toxicity_on_held_out_rows(larger):
    docs, labels = larger
    got = toxicity.toxicity(docs, labels).cache()
    both = got.where("held_out").join(labels, "doc_id", "inner").select(got["toxic"].alias("found"), labels["toxic"].alias("label")).collect()
    assert np.mean([r["found"] == r["label"] for r in both]) >= 0.93
    assert np.mean([r["found"] for r in both if r["label"] == 0]) <= 0.03
    assert got.where("expected_severity < 0 OR expected_severity > 3 OR grade NOT BETWEEN 0 AND 3").count() == 0


def test_toxicity_recall(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels)
    both = found.where("held_out").join(labels, "doc_id").select(found["toxic"].alias("found"), labels["toxic"].alias("label")).collect()
    assert np.mean([r["found"] for r in both if r["label"] == 1]) >= 0.9
    assert np.mean([r["found"] for r in both if r["label"] == 0]) <= 0.01


def test_sample_is_bounded_in_bytes_by_fewer_rows(larger):
    docs, labels = larger
    whole = sample(docs, labels, "quality", 100)
    fewer = sample(docs, labels, "quality", 100, sum(len(t) for t, _ in whole[:30]))
    assert fewer == whole[:30]


MASK, BASE, SPREAD = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def slow_bucket(h, bits):
    return ((h ^ h >> 29) * SPREAD & MASK) >> 64 - bits


def slow_hash(word):
    return sum(b * pow(BASE, i, 1 << 64) for i, b in enumerate(word)) & MASK


def test_quality_scores_against_a_plain_loop():
    model = quality.fit([(b"good plain words", 1), (b"b@d### w%%rds$$$", 0)] * 10, steps=300)
    texts = [b"good plain words words here", b"", b"b@d### w%%rds$$$\nx", "stra\u00dfe caf\u00e9 a a a".encode()]
    for text, score in zip(texts, model.scores(texts)):
        total, n, before = 0.0, 0, None
        for w in re.findall(rb"[^ \t\n\x0b\f\r]+", text):
            total += model.logit[slow_bucket(slow_hash(w) + 1 & MASK, quality.BITS)] + model.logit[quality._REPEATED if w == before else quality._FRESH]
            n, before = n + 2, w
        padded = b" " + bytes(32 if b in (9, 10, 11, 12, 13) else b for b in text) + b" "
        for size in quality.NGRAMS:
            for k in range(len(padded) - size + 1):
                gram, h = padded[k : k + size], 0
                if b" " in gram[1:-1]:
                    continue
                for b in gram:
                    h = h * BASE + b + 1 & MASK
                total += model.logit[slow_bucket(h + size & MASK, quality.BITS)]
                n += 1
        assert abs(1 / (1 + np.exp(-(total / (n + quality.PRIOR) + model.bias))) - score) < 1e-6


def test_toxicity_scores_against_a_plain_loop():
    rows = [(b"fine words here %d" % i, 0) for i in range(60)] + [(b"awful " * (1 + i % 4) + b"vile" * (i % 2) + b" words %d" % i, 1) for i in range(40)]
    model = toxicity.fit(rows, toxicity.severity_grades(rows))
    weight = dict(zip(model.ids.tolist(), model.weights))
    texts = [t for t, _ in rows[::7]] + [b"", b"Awful awfully VILE"]
    for text, above in zip(texts, model.above(texts)):
        words = re.findall(rb"[a-z\x80-\xff]+", text.lower())
        score = sum(weight.get(f, 0.0) for f in {slow_bucket(slow_hash(w) + 1 & MASK, toxicity.BITS) for w in words})
        for k, n in enumerate(toxicity.STEMS, 1):
            hits = {}
            for w in words:
                if len(w) > n:
                    f = k << toxicity.BITS | slow_bucket(slow_hash(w[:n]) + 2 + n & MASK, toxicity.BITS)
                    hits[f] = hits.get(f, 0) + 1
            score += sum(weight.get(f, 0.0) * np.log1p(100 * c / (len(words) + 20)) for f, c in hits.items())
        assert np.allclose(above, 1 / (1 + np.exp(-(score - model.cuts))))


def test_thresholds_stay_ordered():
    rows = [(b"fine words here %d" % i, 0) for i in range(60)] + [(b"awful " * (1 + i % 4) + b"vile" * (i % 2) + b" words %d" % i, 1) for i in range(40)]
    model = toxicity.fit(rows, toxicity.severity_grades(rows))
    assert (np.diff(model.cuts) > 0).all()
    above = model.above([t for t, _ in rows])
    assert (np.diff(above, axis=1) <= 1e-12).all() and above[60:, 0].min() > above[:60, 0].max()


def test_models_without_usable_labels(spark, edges, labels):
    none = labels.limit(0)
    assert {round(r["score"], 6) for r in quality.quality_scores(edges, none).collect()} == {0.5}
    assert toxicity.toxicity(edges, none).count() == edges.count()


def test_model_edges(spark, edges, labels):
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (4, None, None), (5, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int"))
    for found in (quality.quality_scores(edges, odd), toxicity.toxicity(edges, odd)):
        assert found.count() == edges.count()
    scores = quality.quality_scores(edges, odd).where("doc_id IN (1, 2, 3)").select("score").distinct()
    assert scores.count() == 1
    assert quality.quality_scores(edges.limit(0), odd).count() == 0 and toxicity.toxicity(edges.limit(0), odd).count() == 0
    kept = quality.keep_good(edges, odd)
    assert kept.columns == edges.columns and kept.count() == quality.quality_scores(edges, odd).where("predicted = 1").count()


def test_word_hashes_depend_on_the_word_alone():
    window = hashed_words.Window([b"ab cd ab", b"", b"cd"], hashed_words.spaced())
    h = window.words()
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1] and window.doc.tolist() == [0, 0, 0, 2]
    grams, valid = window.ngrams(3)
    assert valid.sum() == sum(b" " not in bytes(window.bytes[i + 1 : i + 2]) for i in range(len(grams)))


def test_text_scores_do_not_depend_on_neighbours():
    model = quality.fit([(b"good plain words", 1), (b"b@d### w%%rds$$$", 0)] * 10, steps=200)
    together = model.scores([b"good words", b"", b"w%%rds$$$"])
    assert np.allclose(together, [model.scores([t])[0] for t in (b"good words", b"", b"w%%rds$$$")])
    assert together[0] > together[2]
