import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from helpers import SMALL
from pyspark.sql import functions as F

from tessera.llm import packing, pieces, pii, queries, sharding, syncmers
from tessera.llm.word_bpe import Encoder

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "İstanbul ΣΑΣ a\x1cb é é <|endoftext|>x it's I'LL ½ x² ª ß ÀÉ 漢字 y", "it's 'tis a'sun,'s don't 12 3abc--- \n\n ß ÀÉÿ x\ty", "  lead trail  ", "\x00a\x7f", "▁x ▁", "a" * 3000, "=-" * 900, " " * 100, "x" + " " * 37 + "y", "😀é\x00b", "aaaaaaaab " * 30]


# --- packing ---------------------------------------------------------------------------------------------------------


def whole_ids(text):
    from tokenizers import Tokenizer

    whole_ids.tok = getattr(whole_ids, "tok", None) or Tokenizer.from_file(WORDS)
    return whole_ids.tok.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(texts):
    all_texts = [*texts.values(), *ODD]
    got = Encoder(WORDS).encode(pa.array(all_texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole_ids(t) for t in all_texts]


def check_packed(rows, want, size):
    """Every id in exactly one piece, sequences gapless; the share of padding."""
    sequences, docs = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    for i, parts in docs.items():
        joined = []
        for start, ids, total in sorted(parts):
            assert start == len(joined)
            joined += ids
        assert joined == want[i] and {p[2] for p in parts} == {len(joined)}
    assert set(docs) == set(want)
    return padding


@pytest.mark.parametrize("size, windows", [(4096, 32), (64, 3)])
def test_packing_is_whole(docs, texts, size, windows):
    got = packing.pack(docs.repartition(5), WORDS, 2, size, windows).collect()
    assert check_packed(got, {i: [*whole_ids(t), 2] for i, t in texts.items()}, size) == 0


def test_packing_edges(edges):
    got = packing.pack(edges, WORDS, 2).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 5) == 2 * (len(whole_ids("same text HERE\nand there")) + 1)
    assert [r["doc_tokens"] for r in got if r["doc_id"] in (1, 2)] == [1, 1]
    assert packing.pack(edges.limit(0), WORDS, 2).count() == 0


# --- SentencePiece ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def segmenter():
    return pieces.Segmenter(PIECES)


def test_segments_equal_the_library(segmenter, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    all_texts = [*texts.values(), *ODD]
    for text, got in zip(all_texts, segmenter.encode(pa.array(all_texts))):
        want = model.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert segmenter.decode(got) == model.decode(want)
        if "▁" not in text:
            assert segmenter.decode(got) == text
        if 0 < len(text) < 5000:
            assert list(segmenter.segment("▁" + text.replace(" ", "▁"))) == want


def test_window_is_bounded(segmenter):
    """Ids leave long before the end of a string that has no forced boundary."""
    seen = 0
    for seen, _ in enumerate(segmenter.segment("a" * 10_000)):
        if seen == 3:
            break
    assert seen == 3


def test_sentencepiece_edges(spark, edges):
    got = pieces.with_decoded(pieces.encode(edges, PIECES), PIECES).collect()
    assert len(got) == edges.count()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted((r["doc_id"] or 0, r["text"] or "") for r in edges.select("doc_id", "text").collect())
    assert pieces.encode(edges.limit(0), PIECES).count() == 0
    assert pieces.with_decoded(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), PIECES).first()["text"] == ""


def test_op9_round_trip(spark, texts):
    got = {r["doc_id"]: r for r in queries.op9_sentencepiece(spark, SMALL).collect()}
    assert {i: r["decoded_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


# --- syncmers --------------------------------------------------------------------------------------------------------


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
    return signed(seed)


def slow_units(text):
    out = []
    for word in re.split(r"[ \t\n\x0b\f\r]+", text):
        cut = max(0, len(word) - syncmers.LONGEST)
        out += [*word[:cut], word[cut:]]
    return [u for u in out if u]


def slow_anchors(text):
    h, k = [signed(xxhash.xxh64_intdigest(u.encode(), seed=42)) for u in slow_units(text)], syncmers.K
    if not h:
        return []
    if len(h) < k:
        out = 0
        for x in h:
            out = chained([out, x])
        return [(0, out)]
    return [(i, chained(h[i : i + k])) for i in range(len(h) - k + 1) if min(h[i : i + k]) in (h[i], h[i + k - 1])]


def slow_print(text):
    first = {}
    for pos, h in slow_anchors(text):
        first.setdefault(h, pos)
    sketch = sorted(first)[: syncmers.SKETCH]
    return sketch, [first[h] for h in sketch]


def slow_likeness(a, b):
    union = sorted({*a[0], *b[0]})[: syncmers.SKETCH]
    return len([h for h in union if h in a[0] and h in b[0]]) / len(union) if union else 1.0


def slow_alignment(a, b):
    away = [b[1][b[0].index(h)] - p for h, p in zip(*a) if h in b[0]]
    return max(map(away.count, away)) / len(away) if away else 0.0


def check_op2(got, texts):
    ids = sorted(texts)
    assert sorted(got) == ids
    text_of = lambda fp: "".join(format(h % (1 << 64), "016x") for h in fp[0]) + ":" + "".join(format(p, "08x") for p in fp[1])
    for k, i in enumerate(ids):
        text, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, beside = slow_print(text), slow_print(edited), slow_print(following)
        assert got[i]["fingerprint"] == text_of(own) and got[i]["edited_fingerprint"] == text_of(other)
        assert got[i]["near_edited"] == slow_likeness(own, other) and got[i]["near_next"] == slow_likeness(own, beside)
        assert got[i]["aligned_edited"] == slow_alignment(own, other) and got[i]["aligned_next"] == slow_alignment(own, beside)


def test_op2_against_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 20)
    monkeypatch.setattr(syncmers, "LEAVES", 3)
    got = {r["doc_id"]: r for r in queries.op2_syncmers(spark, SMALL).collect()}
    check_op2(got, texts)
    assert np.median([r["near_edited"] for r in got.values()]) > 0.5 > 0.1 > np.median([r["near_next"] for r in got.values()])


def test_any_two_texts_can_be_compared(spark, tmp_path):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(140))
    unspaced, ideograms = "".join(rng.choices("abcdefghijklmnop/+", k=3000)), "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(5000))
    texts = {1: prose, 2: " ".join([prose] * 3), 3: unspaced, 4: "x " + unspaced + " y", 5: ideograms, 6: "", 7: "one two", 8: ideograms[100:], 9: "a" * 25 + " " + "b" * 24}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op2_syncmers(spark, str(tmp_path)).collect()}
    check_op2(got, texts)
    assert got[1]["near_next"] > 0.9 and got[3]["near_next"] > 0.9 and got[3]["near_edited"] > 0.4 and got[5]["near_edited"] > 0.4
    assert got[1]["aligned_next"] == 1 and got[3]["aligned_next"] == 1


def test_anchor_positions(spark):
    text = " ".join(random.Random(1).choice(["ab", "c", "def", "g" * 30]) for _ in range(60))
    got = spark.createDataFrame([(text,)], "t string").select(syncmers.anchors(F.col("t")).alias("a")).first()["a"]
    assert [tuple(x) for x in got] == slow_anchors(text)


def test_syncmer_edges(spark, edges):
    got = syncmers.edited_fingerprints(edges)
    assert got.count() == edges.count()
    scores = got.select("doc_id", "text", syncmers.as_string(F.col("fp")).alias("f"), syncmers.likeness(F.col("fp"), F.col("edited_fp")).alias("e"), syncmers.likeness(F.col("fp"), F.col("next_fp")).alias("n")).collect()
    assert all(0 <= r["e"] <= 1 and 0 <= r["n"] <= 1 for r in scores)
    by_text = {}
    for r in scores:
        assert by_text.setdefault(r["text"], r["f"]) == r["f"]
    one = syncmers.edited_fingerprints(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited"] == "abcdefab"
    assert syncmers.edited_fingerprints(edges.limit(0)).count() == 0


# --- personal data ---------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            twice = [int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(digits[::-1])]
            bad = {"ip": lambda: any(int(p) > 255 for p in m.group().split(".")), "card": lambda: not 14 <= len(digits) <= 19 or sum(twice) % 10, "phone": lambda: not 10 <= len(digits) <= 15}
            if not bad.get(kind, lambda: False)():
                out.append((m.start(), rank, m.end()))
    return sorted(out)


NASTY = [
    "a@b.com_foo@bar.com x@y 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 4111 1111 1111 1111 +1 (743) 555-3824, +12 +49 30 1234567890 é😀 me@x.co.uk. a@b..c a@b.c-",
    "4111-1111-1111-1111 " * 300, "1 " * 9000, "1" * 30_000 + " " + "a" * 30_000 + "@", "1." * 5000, "a@b.c " * 700, "+1" * 3000, "..@..@a.b@c.d", "5500005555555559 4111111111111111x",
]


def test_base_spans_against_brute_force(spark, docs, texts):
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(NASTY)], "doc_id long, text string")
    got = pii.spans(docs.select("doc_id", "text").unionByName(more)).collect()
    every = texts | {10**6 + i: t for i, t in enumerate(NASTY)}
    assert len(got) == len(every)
    for r in got:
        assert [(s["start"], s["rank"], s["stop"]) for s in r["spans"] if s["base"]] == slow_base(every[r["doc_id"]])


def test_op8_digests(spark, texts):
    got = {r["doc_id"]: r for r in queries.op8_pii(spark, SMALL).collect()}
    kinds = list(PATTERNS)
    for i, t in texts.items():
        base = slow_base(t)
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(b[1] == n for b in base) for n in range(4)]
        written = [f"{kinds[b[1]]}:{b[0]}:{b[2]}" for b in base]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(got[i]["spans"].split(","))


def test_classifier_adds_secrets_and_drops_noise(spark):
    rows = [(i, f'x token = "{hashlib.md5(str(i).encode()).hexdigest()}" y call 743-555-38{i:02d} z') for i in range(40)] + [(100 + i, "password=aaaaaaaaaaaaz-") for i in range(5)]
    got = {r["doc_id"]: [pii.KINDS[s["rank"]] for s in r["spans"]] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == ["secret", "tel"] for i in range(40))
    assert all(got[100 + i] == [] for i in range(5))


def test_finds_need_nothing_outside_themselves(spark):
    bare = ["password=hunterabcdefgh1 and more", "write to jane dot x at mail dot org now", "ring 743-555-3824 now", "jane (at) mail (dot) org", "jane[at]mail[dot]org"]
    import itertools

    pattern = "|".join(f"(?:{p})" for p in pii.EXTRA.values())
    df = spark.createDataFrame([(i, a + tail) for i, (a, tail) in enumerate(itertools.product(bare + ["password=hunterabcdefgh and more"], ["", " 7", " [x] (y)"]))], "doc_id long, t string")
    got = df.select("doc_id", F.expr("t rlike r'" + pattern.replace("'", "\\x27") + "'").alias("any"), F.col("t").rlike(pii.EXTRA_NEEDS).alias("asked")).collect()
    assert all(r["any"] <= r["asked"] for r in got) and sum(r["any"] for r in got) >= 15
    found = pii.candidates(df.withColumnRenamed("t", "text")).select("doc_id", F.size("_candidates").alias("n")).collect()
    assert len({(r["doc_id"] // 3, r["n"]) for r in found}) == 6


def test_overlapping_spans_go_together(spark):
    rows = [(1, "4111 1111 1111 111 1.2.3.4"), (2, "3456 7890 1234 567.john@x.com end"), (3, "a@b.co,1.2.3.4"), (4, "+1 743 555 3824 a@b.co +1 743 555 3824")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        kept = slow_base(text)
        want, at = "", 0
        while kept:
            start, rank, stop = kept.pop(0)
            while kept and kept[0][0] < stop:
                stop = max(stop, kept.pop(0)[2])
            want, at = want + text[at:start] + f"[{pii.KINDS[rank].upper()}]", stop
        assert got[i] == want + text[at:]
    assert got[1] == "[CARD]"


def test_pii_edges(edges):
    got = pii.redact(edges)
    assert got.columns == edges.columns
    out = {r["doc_id"]: r["text"] for r in got.select("doc_id", "text").collect()}
    assert out[14] == "call [PHONE] or [EMAIL], [IP], [CARD]" and out[1] is None and out[2] == "" and out[11] == "x" * 70_000
    assert pii.spans(edges).count() == edges.count()
    assert pii.spans(edges.limit(0)).count() == 0 and pii.redact(edges.limit(0)).count() == 0


# --- shards ----------------------------------------------------------------------------------------------------------


def slow_table(shards, slots):
    orders = []
    for s in shards:
        offset, step = (int.from_bytes(hashlib.md5(f"{salt}:{s}".encode()).digest()[:8], "big") for salt in ("offset", "step"))
        orders.append(iter([(offset % slots + k * (step % (slots - 1) + 1)) % slots for k in range(slots)]))
    table, turn = {}, 0
    while len(table) < slots:
        slot = next(x for x in orders[turn % len(shards)] if x not in table)
        table[slot] = turn % len(shards)
        turn += 1
    return [table[k] for k in range(slots)]


def test_table_against_brute_force():
    names = [f"s{i}" for i in range(7)]
    assert sharding.lookup_table(names, 101).tolist() == slow_table(names, 101)
    shares = np.bincount(sharding.lookup_table(names))
    assert shares.max() - shares.min() <= 1


def test_little_moves_when_a_shard_leaves():
    names = [f"s{i}" for i in range(20)]
    before, after = sharding.lookup_table(names), sharding.lookup_table(names[:-1])
    assert np.mean((before != after) & (before != 19)) < 0.05


def test_bad_tables():
    for names, slots in (([], 101), (["a", "a"], 101), (["a"], 100), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, slots)


def test_op7_places_every_row(spark, texts):
    names = [f"shard-{i:03d}" for i in range(256)]
    table = sharding.lookup_table(names)
    got = queries.op7_sharding(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"], r["n_bytes"]) == (slot, names[table[slot]], len(texts[r["doc_id"]].encode()))


def test_shard_edges_and_files(spark, edges, tmp_path):
    placed = sharding.place(edges, ["a", "b"])
    assert placed.count() == edges.count() and placed.where("row.doc_id IS NULL AND slot <> 0").count() == 0
    assert sharding.place(edges.limit(0), ["a"]).count() == 0
    sharding.write_shards(edges.select("doc_id", "text"), ["a", "b"], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == edges.count()
