import random

import numpy as np
import pytest
from helpers import SMALL

import corpus_pipeline
from tessera.llm import near_copies


def slow_kept(texts):
    """Identifiers that name a class, by the likeness of all pairs."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in texts if find(i) == i}


@pytest.mark.parametrize("seed", [0, 1])
def test_stage_against_all_pairs(spark, seed):
    rng, texts = random.Random(seed), {}
    word = lambda: f"w{rng.randrange(3000)}"
    for i in range(240):
        if i % 8 == 0:  # a new text, the next ones are edits of it or of edits
            words = [word() for _ in range(rng.choice([3, 8, 40, 150]))]
        else:
            words = (texts[i - rng.randint(1, i % 8)]).split()
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = word()
        texts[i] = " ".join(words)
    texts |= {1000: "", 1001: " \n "}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash"](spark, df, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_kept(texts)


def test_stage_with_repeated_and_missing_identifiers(spark):
    long = " ".join(f"a{i}" for i in range(100))
    rows = [(5, long), (5, long), (5, "quite another text that nobody else has"), (6, long + " more"), (None, long), (None, None)]
    got = dict(corpus_pipeline.STAGES)["simhash"](spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(5, long), rows[2], (None, long), (None, None)], key=repr)


def test_bitmaps_differ_in_no_more_bits_than_sets(spark):
    rng, rows, slow = np.random.default_rng(0), [], []
    for n, m in [(1, 1), (5, 4), (64, 64), (64, 65), (130, 110), (1000, 1030), (3, 200), (2000, 100)]:
        x = np.unique(rng.integers(0, 2**64, n, "u8"))
        y = np.unique(np.concatenate([x[: m * 9 // 10], rng.integers(0, 2**64, m - m * 9 // 10, "u8")]))
        a, b = near_copies._parity(x), near_copies._parity(y)
        size = 64 * min(len(a), len(b))
        odd = set()
        for h in [*x.tolist(), *y.tolist()]:
            odd ^= {h % size}
        rows.append((a.tolist(), b.tolist(), size // 64))
        slow.append((len(odd), len(np.setxor1d(x, y))))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, words int").coalesce(1)
    got = [r["d"] for r in df.select(near_copies._differ().alias("d")).collect()]
    assert got == [d for d, _ in slow] and all(d <= most for d, most in slow)


def test_links_of_sets_at_the_limit(spark):
    """Likeness of exactly 0.8, equal and unequal sizes; one shingle less is no link."""
    long = [f"w{i}" for i in range(94)]  # 90 shingles
    texts = {1: " ".join(long), 2: " ".join(long[:76]), 3: " ".join(["q"] * 3 + long[20:]), 4: " ".join([f"z{i}" for i in range(10)] + long[10:])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"] for r in near_copies.keep_one(df).collect()}
    assert got == slow_kept(texts) == {1, 3}


def test_small_tables_are_few_files(spark, monkeypatch):
    """What is left of many shingle rows is written by its own size, not as a file for each task that looked for it."""
    rng, files, real = random.Random(2), {}, near_copies.written
    texts = [[f"w{rng.randrange(100000)}" for _ in range(60)] for _ in range(1200)]
    texts += [[*t[:-1], "edited"] for t in texts[:40]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)

    def counted(*args, **how):
        table = real(*args, **how)
        files.setdefault(args[1], []).append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(near_copies, "written", counted)
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    was = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        got = {r["doc_id"] for r in near_copies.keep_one(df).collect()}
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)
    assert got == set(range(1200))
    assert max(files["company"] + files["members"] + files["candidates"] + files["confirmed"]) == 1, files
