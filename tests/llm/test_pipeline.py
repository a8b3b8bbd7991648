import importlib

import numpy as np
import public_tokenizers
from helpers import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import pii, quality, queries, simhash
from test_dedup import slow_classes, slow_fingerprint, slow_lines
from test_texts import check_packed, slow_base, whole_ids


def collected(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_against_brute_force(spark, docs, texts, labels):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "simhash", "pii", "packing"]
    scores = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, labels).collect()}
    now = stages["quality"](spark, docs, SMALL).cache()
    assert now.columns == docs.columns
    first = collected(now)
    assert first == {i: t for i, t in texts.items() if scores[i]}
    now = stages["line_dedup"](spark, now, SMALL).cache()
    assert now.columns == docs.columns and now.where("n_chars <> length(text)").count() == 0
    second = collected(now)
    assert second == slow_lines(first, 3, 10)
    now = stages["simhash"](spark, now, SMALL).cache()
    assert now.columns == docs.columns
    third, classes = collected(now), slow_classes({i: slow_fingerprint(t, 3) for i, t in second.items()}, 2)
    assert third == {i: second[i] for i in set(classes.values())}
    now = stages["pii"](spark, now, SMALL).cache()
    assert now.columns == docs.columns and now.where("n_chars <> length(text)").count() == 0
    fourth = collected(now)
    assert fourth.keys() == third.keys()
    for i, t in fourth.items():
        assert t.count("[EMAIL]") >= sum(b[1] == 0 for b in slow_base(third[i])) and (t == third[i] or "[" in t)
    got = stages["packing"](spark, now, SMALL).collect()
    assert check_packed(got, {i: [*whole_ids(t), 2] for i, t in fourth.items()}, 4096) == 0


def test_run_is_registered():
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")) == list(range(1, 11))


def test_stages_on_edges(spark, edges):
    now = edges
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL)
    assert now.count() > 0
    now = edges.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL)
    assert now.count() == 0
