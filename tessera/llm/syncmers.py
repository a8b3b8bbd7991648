"""Document fingerprints from closed syncmers, in DataFrame functions only.

Every text is a sequence of units: its words, and where a word is longer than
``LONGEST`` characters (scripts without spaces, encoded data), its single
characters.  A k-mer of K units is a closed syncmer if the least hash among
its inner s-mers (single units here) lies at its first or last place; that
depends on the k-mer alone, so equal passages give equal anchors wherever they
stand, and any two texts can be compared.  A fingerprint keeps the smallest
anchor hashes (a bottom sketch) with their positions: likeness is the share of
common hashes in the sketch of the union, and the positions tell how far the
common anchors lie on one diagonal.

In expressions, ``_bind`` names a value that several lambdas use, so that it
is computed once for a text and not once for an element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import text_or_empty

#: Units in a k-mer, and characters of the longest word that is one unit.
K, LONGEST = 3, 24
_SPACE = r" \t\n\x0B\f\r"
#: A word (or the end of a longer one), or a single character of a longer word.
UNIT = rf"[^{_SPACE}]{{1,{LONGEST}}}+(?![^{_SPACE}])|[^{_SPACE}]"
#: Hashes in a sketch.
SKETCH = 64
#: Rows of a neighbour bucket, and buckets, at most (larger buckets spill).
BUCKET_ROWS, BUCKETS, LEAVES = 4096, 65_536, 256


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), f)[0]


def _beside(a: Column, away: int, f: Callable[[Column, Column], Column]) -> Column:
    """``f(a[i], a[i + away])`` for every i that has both."""
    n = F.greatest(F.lit(0), F.size(a) - away)
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(away + 1), n), f)


def anchors(text: Column) -> Column:
    """array<struct<pos, hash>>: the closed syncmers of a text by position (in units).

    Fewer units than a k-mer make one anchor of them all; no units make none.
    """
    units = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))

    def at(h: Column) -> Column:
        """Places of the k-mers whose least unit hash is the first or the last one."""
        inner = _beside(h, 1, lambda a, b: F.least(a, b))
        least = _beside(inner, K - 2, lambda a, b: F.least(a, b))
        return F.array_compact(F.transform(least, lambda x, i: F.when((x == h[i]) | (x == h[i + (K - 1)]), i)))

    def of(h: Column) -> Column:
        all_of_it = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))
        short = F.array(F.struct(F.lit(0).alias("pos"), all_of_it.alias("hash")))
        none = F.expr("cast(array() as array<struct<pos:int,hash:bigint>>)")
        whole = lambda i: F.struct(i.alias("pos"), F.xxhash64(*[h[i + j] for j in range(K)]).alias("hash"))
        return F.when(F.size(h) == 0, none).when(F.size(h) < K, short).otherwise(F.transform(at(h), whole))

    return _bind(F.transform(units, lambda u: F.xxhash64(u)), of)


def fingerprint(text: Column) -> Column:
    """struct<hash, pos>: up to ``SKETCH`` least distinct anchor hashes, sorted, and the first position of each."""

    def sketch(found: Column) -> Column:
        least = F.slice(F.sort_array(F.array_distinct(F.transform(found, lambda a: a["hash"]))), 1, SKETCH)
        hashes = F.transform(found, lambda a: a["hash"])
        return _bind(hashes, lambda all_of_them: _bind(least, lambda h: F.struct(h.alias("hash"), F.transform(h, lambda x: found[(F.array_position(all_of_them, x) - 1).cast("int")]["pos"]).alias("pos"))))

    return _bind(anchors(text), sketch)


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes in the union's sketch.

    Two texts without units are alike (1); one without and one with are not (0).
    """
    x, y = a["hash"], b["hash"]
    union = F.slice(F.sort_array(F.array_union(x, y)), 1, SKETCH)
    return _bind(union, lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(u, x), y)) / F.size(u)))


def alignment(a: Column, b: Column) -> Column:
    """Share of the common anchors that lie on the commonest diagonal (equal distance of positions); 0 without common ones."""
    place = lambda fp, h: fp["pos"][(F.array_position(fp["hash"], h) - 1).cast("int")]
    away = F.transform(F.array_intersect(a["hash"], b["hash"]), lambda h: place(b, h) - place(a, h))

    def most(d: Column) -> Column:
        count = F.aggregate(F.array_distinct(d), F.lit(0), lambda top, x: F.greatest(top, F.size(F.filter(d, lambda y: y == x))))
        return F.when(F.size(d) == 0, 0.0).otherwise(count / F.size(d))

    return _bind(away, most)


def as_string(fp: Column) -> Column:
    """A fingerprint in hexadecimal: its hashes (16 digits each), and after a colon their positions (8 each)."""
    hexes = lambda x, n: F.array_join(F.transform(x, lambda h: F.lpad(F.lower(F.hex(h)), n, "0")), "")
    return F.concat(hexes(fp["hash"], 16), F.lit(":"), hexes(fp["pos"], 8))


def _leaf(bounds: list[int]) -> Column:
    """The number of the quantile that doc_id lies in, by a balanced search; null identifiers are in the first."""
    key = F.col("doc_id")

    def search(lo: int, hi: int) -> Column:
        if hi - lo <= 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < bounds[mid], search(lo, mid)).otherwise(search(mid, hi))

    return F.coalesce(search(0, len(bounds) - 1), F.lit(0)) if len(bounds) > 1 else F.lit(0)


def _dealt(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``_bucket``, a number that does not fall with doc_id: quantiles, and quantiles within each of them."""
    n = docs.count()
    leaves = max(1, min(LEAVES, -(-n // BUCKET_ROWS)))
    parts = max(1, min(BUCKETS, -(-n // BUCKET_ROWS)) // leaves)
    steps = lambda k: [i / k for i in range(k + 1)]
    found = docs.agg(F.percentile_approx("doc_id", steps(leaves), 10_000).alias("q")).first()
    bounds = sorted(set(found["q"] or []))
    by_leaf = docs.withColumn("_leaf", _leaf(bounds))
    if parts == 1:
        return by_leaf.withColumnRenamed("_leaf", "_bucket")
    inner = by_leaf.groupBy("_leaf").agg(F.percentile_approx("doc_id", steps(parts)[1:-1], 10_000).alias("_inner"))  # a row for each leaf
    within = F.greatest(F.lit(0), F.coalesce(F.size(F.filter("_inner", lambda x: x <= F.col("doc_id"))), F.lit(0)))
    return by_leaf.join(F.broadcast(inner), "_leaf").withColumn("_bucket", F.col("_leaf") * parts + within).drop("_leaf", "_inner")


def with_next(docs: DataFrame, columns: list[str], derived: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``derived(docs)`` plus ``next_<c>``: the columns of the next row by doc_id, after the last those of the first.

    Rows are dealt to buckets of consecutive identifiers; the first row of a
    bucket also stands at the end of the bucket before it.  ``derived`` adds
    columns once those few are chosen, before rows are dealt.  Null identifiers
    come first, and equal ones in order of a hash of their columns.
    """
    dealt = _dealt(docs).withColumn("_again", F.lit(False))
    heads = dealt.select("doc_id", "_bucket").groupBy("_bucket").agg(F.min("doc_id").alias("_head")).where("_head IS NOT NULL")
    by_bucket = Window.orderBy("_bucket")  # a row for each bucket
    ahead = heads.select("_head", F.coalesce(F.lag("_bucket").over(by_bucket), F.max("_bucket").over(Window.partitionBy())).alias("_before"))
    again = dealt.join(F.broadcast(ahead), F.col("doc_id") == F.col("_head")).withColumn("_bucket", F.col("_before")).withColumn("_again", F.lit(True)).select(*dealt.columns)
    order = Window.partitionBy("_bucket").orderBy("_again", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    both = derived(dealt.unionByName(again))
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(~F.col("_again")).drop("_bucket", "_again")


def _printed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fp", fingerprint(F.col("text")))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, fp) per input row; a null text is empty.  Other columns are ignored."""
    return _printed(_texts(docs, id_col, text_col))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, fp, edited, edited_fp, next_fp): each text, and with its last quarter replaced.

    The last floor(n/4) code points give way to the first as many (or all) of
    the next document.  Empty texts stay empty; a lone document follows
    itself; an empty table gives an empty result.
    """
    beside = with_next(_texts(docs, id_col, text_col), ["text", "fp"], _printed)
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))
    return beside.withColumn("edited", edited).withColumn("edited_fp", fingerprint(F.col("edited"))).drop("next_text")
