import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from helpers import SMALL, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import components, exact_dedup, line_dedup, queries, simhash


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SMALL)) == rows(duck.sql(queries.ORACLE_SQL[name]))


# --- exact -----------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=9).map(str.encode), max_size=60), st.integers(300, 3000))
def test_trie_counts_keys_when_subtrees_spill(keys, limit):
    trie = exact_dedup.PatriciaTrie(lambda a, b: (a[0] + b[0], a[1]), limit)
    for k in keys:
        trie.insert(k, (1, k))
    assert Counter({k: n for n, k in trie.values()}) == Counter(keys)


def test_trie_spills_long_common_prefixes():
    trie = exact_dedup.PatriciaTrie(lambda a, b: a + b, 20_000)
    keys = [b"p" * 5000 + str(i).encode() * 50 for i in range(300)] + [b"p" * k for k in range(0, 5000, 500)]
    for k in keys * 2:
        trie.insert(k, 1)
    assert sorted(trie.values()) == [2] * len(keys)


def test_exact_edges(edges):
    got = exact_dedup.exact_dedup(edges, keep="largest", trie_bytes=1000).collect()
    assert len(got) == edges.count()
    groups = defaultdict(list)
    for r in got:
        groups[r["text_sha256"]].append(r)
    empty = groups[hashlib.sha256(b"").hexdigest()]
    assert {r["keep_id"] for r in empty} == {3} and len(empty) == 4
    same = groups[hashlib.sha256(b"same text here\nand there").hexdigest()]
    assert len(same) == 4 and {(r["keep_id"], r["group_size"]) for r in same} == {(5, 4)}
    assert all(sum(r["kept"] for r in g) == 1 and len(g) == g[0]["group_size"] for g in groups.values())


def test_exact_smallest_and_empty(edges):
    got = exact_dedup.exact_dedup(edges, keep="smallest").where("group_size = 4 AND kept")
    assert {r["keep_id"] for r in got.collect()} == {1, 4}
    assert exact_dedup.exact_dedup(edges.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(edges, keep="any")


def test_hot_text_over_many_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text")).repartition(20)
    got = exact_dedup.exact_dedup(df, keep="largest")
    assert got.where("text_sha256 = sha2('hot', 256)").agg(F.min("keep_id"), F.max("group_size"), F.count("*")).first()[:] == (2997, 1000, 1000)


# --- SimHash ---------------------------------------------------------------------------------------------------------


def slow_fingerprint(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints, radius):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_op4_against_all_pairs(spark, texts):
    got = {r["doc_id"]: r for r in queries.op4_simhash(spark, SMALL).collect()}
    prints = {i: slow_fingerprint(t, 3) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: format(p, "016x") for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == slow_classes(prints, 2)


@pytest.mark.parametrize("radius", [2, 4])
def test_masks_cover_every_pair(radius):
    masks, rng = simhash.covering_masks(radius), random.Random(3)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius)))
        assert any(not flips & m for m in masks)


@pytest.mark.parametrize("radius", [2, 4])
def test_links_against_all_pairs(spark, radius):
    rng = random.Random(radius)
    prints = {}
    for i in range(60):
        base = rng.getrandbits(64) if i % 6 == 0 else prints[i - 1]
        for b in rng.sample(range(64), rng.randint(0, 3)):
            base ^= 1 << b
        prints[i] = base
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "node long, fp long").dropDuplicates(["fp"])
    kept = {r["node"]: prints[r["node"]] for r in df.collect()}
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(df, radius)).collect()}
    assert {i: roots.get(i, i) for i in kept} == slow_classes(kept, radius)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_edges(edges):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == edges.count()
    zero = [r for r in got if r["fp"] == 0]
    assert {r["doc_id"] for r in zero} >= {1, 2, 3, 9, None} and {r["component_id"] for r in zero} == {1}
    same = {r["component_id"] for r in got if r["doc_id"] in (4, 5)}
    assert same == {4}
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 2 and ids.count(1) == 1 and 2 not in ids and ids.count(4) == 1 and 5 not in ids
    assert simhash.near_duplicates(edges.limit(0)).count() == 0


def test_no_text_is_lost_under_a_repeated_identifier(spark):
    rows = [(5, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (5, "quite another text of more words"), (6, "ALPHA beta gamma delta"), (None, "alpha beta gamma delta")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[0], rows[2], rows[4]], key=repr)


# --- lines -----------------------------------------------------------------------------------------------------------


def slow_lines(docs, min_lines, min_words):
    """Texts without later copies of maximal repeated runs, by looking at all runs."""
    lines = {i: (t or "").split("\n") for i, t in docs.items()}
    places = [(i, k) for i in sorted(lines) for k in range(len(lines[i]))]
    first, gone = {}, defaultdict(set)
    for i, k in places:
        for n in range(1, len(lines[i]) - k + 1):
            run = tuple(lines[i][k : k + n])
            if run not in first:
                first[run] = (i, k)
            elif n >= min_lines or n == 1 and len(run[0].split()) >= min_words:
                gone[i] |= set(range(k, k + n))
    return {i: "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i]) for i in lines}


@pytest.mark.parametrize("min_lines, seed", [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)])
def test_lines_against_all_runs(spark, min_lines, seed):
    rng = random.Random(seed)
    docs = {i: "\n".join(rng.choice(["a", "b", "", "one two three four", "c d"]) for _ in range(rng.randint(1, 14))) for i in range(12)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df, min_lines, 4).collect()}
    assert got == slow_lines(docs, min_lines, 4)


def test_line_edges(edges):
    got = line_dedup.line_dedup(edges)
    assert got.columns == edges.columns and got.count() == edges.count()
    out = [(r["doc_id"], r["text"]) for r in got.select("doc_id", "text").collect()]
    assert (1, None) in out and (2, "") in out and (None, None) in out
    assert dict(out)[12].count("\n") == 1  # the first line and the empty last one stay
    assert [t for i, t in out if i == 5] == ["same text HERE\nand there"] * 2
    assert line_dedup.deduplicated(edges.limit(0)).count() == 0


def test_a_long_run_is_one_interval(spark):
    run = [f"line {i}" for i in range(50)]
    docs = {1: ["a"] + run + ["b"], 2: ["c"] + run[:20] + ["d"], 3: run + ["e", "f", "a"], 4: ["g"] + run[30:] + ["h"]}
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string")
    got = sorted(r[:] for r in line_dedup.repeated_runs(df).collect())
    assert got == [(2, 1, 20, 1, 1), (3, 0, 50, 1, 1), (4, 1, 20, 1, 31)]


def test_ranks_are_in_order_of_the_suffixes(spark):
    rng = random.Random(5)
    docs = {i: [rng.choice("abc") for _ in range(rng.randint(1, 20))] for i in range(8)}
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string")
    letters = {r["line"]: (r["h1"], r["h2"]) for r in spark.createDataFrame([(c,) for c in "abc"], "line string").select("line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).collect()}
    single = line_dedup._ranked(line_dedup._lines(df, 0).drop("long"), ["h1", "h2"], "ranks_1")
    depths = []
    for depth, ranks in line_dedup.suffix_ranks(single, 2):
        depths.append(depth)
        run = lambda p: [letters[c] for c in docs[p["doc_id"]][p["line_no"] : p["line_no"] + depth]]
        found = sorted((r["rank"], run(r["pos"])) for r in ranks.collect())
        repeated = Counter(tuple(docs[i][k : k + depth]) for i in docs for k in range(len(docs[i]) - depth + 1))
        assert len(found) == sum(n for n in repeated.values() if n > 1)
        assert all((a[0] < b[0]) == (a[1] < b[1]) and (a[0] == b[0]) == (a[1] == b[1]) for a, b in zip(found, found[1:]))
    assert depths[:2] == [2, 4]


def test_repeated_rows_stay_one_text(spark):
    text = "\n".join(f"line number {i}" for i in range(20))
    df = spark.createDataFrame([(1, text)] + [(2, text)] * 200, "doc_id long, text string").repartition(5)
    single = line_dedup._ranked(line_dedup._lines(df, 10), ["h1", "h2"], "ranks_1")
    assert single.count() == 40
    got = line_dedup.line_dedup(df).collect()
    assert len(got) == 201 and [r["text"] for r in got if r["doc_id"] == 2] == [""] * 200 and [r["text"] for r in got if r["doc_id"] == 1] == [text]
