"""Pair features of the three generations.

Attributes are computed once a record and joined late onto the top pairs.
Measures that Spark lacks run in one Arrow pass for each string pair; all
else is native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.distance import with_all_measures
from tessera.functions.phonetic import metaphone

#: The 34 features in order.
PRODUCTION = [
    "n_set", "n_sort", "n_part", "n_ratio", "first_match", "n_jacc", "n_jw", "n_dl", "n_lcs", "n_sorted_ratio", "last_match", "initials_match", "first_phonetic", "phonetic_jacc",
    "a_set", "a_part", "a_jacc", "a_jw", "a_ratio", "a_dl", "a_lcs", "addr_missing_s1", "addr_missing_cand", "addr_both_present",
    "street_num_match", "street_num_mismatch", "postal_match", "postal_mismatch", "locality_jacc", "num_overlap", "has_num_overlap", "num_mismatch", "blk_score", "is_us",
]
CASCADE = ["n_set", "n_sort", "n_ratio", "n_jw", "n_lev", "n_jacc", "first_match", "meta_jacc", "a_set", "a_jw", "has_num_overlap", "num_overlap_count", "has_num_mismatch", "loc_jacc", "retrieval_score"]
EXPERIMENT = ["n_set", "n_sort", "n_part", "n_ratio", "first_match", "n_jacc", "a_set", "a_part", "a_jacc", "num_overlap", "has_num_overlap", "num_mismatch", "blk_score"]


def paired(pairs: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (s1, cand) plus ``s_<c>`` and ``c_<c>`` of both records."""
    left = records.where("source = 1").select(F.col("entity_id").alias("s1"), *[F.col(c).alias(f"s_{c}") for c in columns])
    right = records.where("source <> 1").select(F.col("entity_id").alias("cand"), *[F.col(c).alias(f"c_{c}") for c in columns])
    return pairs.join(left, "s1").join(right, "cand")


def number(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common distinct tokens; 0 without tokens."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def same(a: Column, b: Column) -> Column:
    return number((a != "") & (a == b))


def differ(a: Column, b: Column) -> Column:
    return number((a != "") & (b != "") & (a != b))


def _words(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def initials_match(a_norm: Column, b_norm: Column) -> Column:
    """1 if a word equals the other side's initials (two or more), 0.5 if the initials agree."""
    initials = lambda w: F.array_join(F.transform(w, lambda t: F.substring(t, 1, 1)), "")
    a, b = _words(a_norm), _words(b_norm)
    ia, ib = initials(a), initials(b)
    hit = (F.array_contains(b, ia) & (F.length(ia) >= 2)) | (F.array_contains(a, ib) & (F.length(ib) >= 2))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(hit, 1.0).when((ia == ib) & (F.length(ia) >= 2), 0.5).otherwise(0.0)


def first_of(nums: Column, low: int, high: int) -> Column:
    """The first number, in order of appearance, of that many digits."""
    return F.coalesce(F.get(F.filter(nums, lambda n: F.length(n).between(low, high)), F.lit(0)), F.lit(""))


def last_of(tokens: Column) -> Column:
    return F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))


def overlap(pairs: DataFrame) -> DataFrame:
    """Native token and number features of pairs with s_/c_ n_norm, a_norm, n_toks, a_toks, first_tok and nums."""
    c = F.col
    # the reference side compares pruned tokens, the candidate side the words of the unpruned text
    n_jacc, a_jacc = jaccard(c("s_n_toks"), _words(c("c_n_norm"))), jaccard(c("s_a_toks"), _words(c("c_a_norm")))
    shared = F.size(F.array_intersect("s_nums", "c_nums")).cast("double")
    s_street, c_street = first_of(c("s_nums"), 1, 4), first_of(c("c_nums"), 1, 4)
    s_post, c_post = first_of(c("s_nums"), 5, 6), first_of(c("c_nums"), 5, 6)
    return pairs.withColumns({
        "first_match": same(c("s_first_tok"), c("c_first_tok")), "n_jacc": n_jacc, "last_match": same(last_of(c("s_n_toks")), last_of(c("c_n_toks"))),
        "initials_match": initials_match(c("s_n_norm"), c("c_n_norm")),
        "a_jacc": a_jacc, "addr_missing_s1": number(c("s_a_norm") == ""), "addr_missing_cand": number(c("c_a_norm") == ""), "addr_both_present": number((c("s_a_norm") != "") & (c("c_a_norm") != "")),
        "street_num_match": same(s_street, c_street), "street_num_mismatch": differ(s_street, c_street), "postal_match": same(s_post, c_post), "postal_mismatch": differ(s_post, c_post), "locality_jacc": a_jacc,
        "num_overlap": shared, "has_num_overlap": number(shared > 0), "num_mismatch": number((F.size("s_nums") > 0) & (F.size("c_nums") > 0) & (shared == 0)),
    })


NORM_COLUMNS = ["n_norm", "a_norm", "n_toks", "a_toks", "first_tok", "nums"]


def production(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """(s1, cand, country) and the 34 features of top pairs with blk; ``norm`` as from ``text.normalised``."""
    # one call for a record: a code for each pruned word, then for each word of the whole name
    pruned = F.size("n_toks")
    with_sound = norm.withColumn("_sounds", F.split(metaphone(F.concat_ws(" ", "n_toks", "n_norm")), " "))
    with_sound = with_sound.withColumns({"sound": F.array_join(F.slice("_sounds", F.lit(1), pruned), " "), "all_sound": F.array_join(F.slice("_sounds", pruned + 1, F.size("_sounds")), " ")})
    with_sound = with_sound.withColumns({"first_sound": F.substring_index("sound", " ", 1), "ordered": F.array_join(F.sort_array(F.array_distinct("n_toks")), " "), "all_ordered": F.array_join(F.sort_array(F.array_distinct(_words(F.col("n_norm")))), " ")})
    df = overlap(paired(pairs, with_sound, [*NORM_COLUMNS, "sound", "first_sound", "all_sound", "ordered", "all_ordered"]))
    names = ("s_n_norm", "c_n_norm", "n_", ["set", "sort", "part", "ratio", "jw", "dl", "lcs"])
    addresses = ("s_a_norm", "c_a_norm", "a_", ["set", "part", "jw", "ratio", "dl", "lcs"])
    df = with_all_measures(df, [names, addresses, ("s_ordered", "c_all_ordered", "o_", ["ratio"])])
    both = F.col("addr_both_present") == 1
    df = df.withColumns({f"a_{m}": F.when(both, F.col(f"a_{m}")).otherwise(0.0) for m in ("set", "part", "jw", "ratio", "dl", "lcs")})
    return df.withColumns({
        "n_sorted_ratio": F.when((F.col("s_ordered") != "") & (F.col("c_all_ordered") != ""), F.col("o_ratio")).otherwise(0.0),
        "first_phonetic": same(F.col("s_first_sound"), F.col("c_first_sound")),
        "phonetic_jacc": jaccard(_words(F.col("s_sound")), _words(F.col("c_all_sound"))),
        "blk_score": F.col("blk").cast("double"), "is_us": number(F.col("country") == "US"),
    }).select("s1", "cand", "country", *PRODUCTION)


def cascade(pairs: DataFrame, canon: DataFrame) -> DataFrame:
    """(s1, cand) and the 15 features, 0 to 1, of pairs with blk; ``canon`` as from ``text.canonical``."""
    sounds = canon.withColumn("sound", metaphone(F.array_join(F.transform(F.filter("core_toks", lambda t: F.length(t) >= 3), lambda t: F.replace(t, F.lit(" "), F.lit(""))), " ")))
    df = paired(pairs, sounds, ["canon_name", "canon_addr", "core_toks", "core_first", "addr_nums", "locality", "sound"])
    df = with_all_measures(df, [("s_canon_name", "c_canon_name", "m_", ["set", "sort", "ratio", "jw", "dl"]), ("s_canon_addr", "c_canon_addr", "b_", ["set", "jw"])])
    names, addrs = (F.col("s_canon_name") != "") & (F.col("c_canon_name") != ""), (F.col("s_canon_addr") != "") & (F.col("c_canon_addr") != "")
    share = lambda m, ok: F.when(ok, F.col(m) / 100).otherwise(0.0)
    shared = F.size(F.array_intersect("s_addr_nums", "c_addr_nums"))
    return df.withColumns({
        "n_set": share("m_set", names), "n_sort": share("m_sort", names), "n_ratio": share("m_ratio", names), "n_jw": share("m_jw", names), "n_lev": share("m_dl", names),
        "n_jacc": jaccard(F.col("s_core_toks"), F.col("c_core_toks")), "first_match": same(F.col("s_core_first"), F.col("c_core_first")), "meta_jacc": jaccard(_words(F.col("s_sound")), _words(F.col("c_sound"))),
        "a_set": share("b_set", addrs), "a_jw": share("b_jw", addrs), "has_num_overlap": number(shared > 0), "num_overlap_count": shared.cast("double"),
        "has_num_mismatch": number((F.size("s_addr_nums") > 0) & (F.size("c_addr_nums") > 0) & (shared == 0)), "loc_jacc": jaccard(F.col("s_locality"), F.col("c_locality")), "retrieval_score": F.col("blk").cast("double"),
    }).select("s1", "cand", *CASCADE)


def experiment(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """(s1, cand) and the 13 features of the first experiments; a missing address counts 50."""
    df = overlap(paired(pairs, norm, NORM_COLUMNS))
    df = with_all_measures(df, [("s_n_norm", "c_n_norm", "n_", ["set", "sort", "part", "ratio"]), ("s_a_norm", "c_a_norm", "a_", ["set", "part"])])
    both = F.col("addr_both_present") == 1
    df = df.withColumns({f"a_{m}": F.when(both, F.col(f"a_{m}")).otherwise(50.0) for m in ("set", "part")})
    return df.withColumn("blk_score", F.col("blk").cast("double")).select("s1", "cand", *EXPERIMENT)
