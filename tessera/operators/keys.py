"""Blocking keys: an array of (kord, key, w) for each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.phonetic import metaphone

_NONE = "cast(array() as array<struct<kord:int,key:string,w:double>>)"


def _key(kord: int, prefix: str, value: Column, w: float, when: Column) -> Column:
    made = F.struct(F.lit(kord).alias("kord"), F.concat(F.lit(prefix), value).alias("key"), F.lit(float(w)).alias("w"))
    return F.when(when, made)


def production_keys(norm: DataFrame, phonetic: bool = True) -> DataFrame:
    """``norm`` (see ``text.normalised``) plus ``keys``: first token, its sound, bigram, sorted tokens, number and word, code."""
    t0, t1 = F.coalesce(F.get("n_toks", F.lit(0)), F.lit("")), F.coalesce(F.get("n_toks", F.lit(1)), F.lit(""))
    two = F.size("n_toks") >= 2
    signature = text.sorted_signature(F.slice("n_toks", 1, 3))
    num0, addr0 = F.coalesce(F.get("nums", F.lit(0)), F.lit("")), F.coalesce(F.get("a_toks", F.lit(0)), F.lit(""))
    code = F.coalesce(F.get(F.filter("nums", lambda n: F.length(n).between(5, 6)), F.lit(0)), F.lit(""))
    keys = [
        _key(1, "n1:", t0, 5, F.length(t0) >= 2),
        _key(3, "nb:", F.concat(t0, F.lit("_"), t1), 5, two & (F.length(t1) >= 2)),
        _key(4, "nsort:", signature, 4, two & (F.length(signature) >= 4)),
        _key(5, "na:", F.concat(num0, F.lit("_"), addr0), 2, (num0 != "") & (F.length(addr0) >= 3) & (addr0 != num0)),
        _key(6, "pin:", code, 3, code != ""),
    ]
    if phonetic:
        norm = norm.withColumn("_m", metaphone(F.coalesce(F.get("n_toks", F.lit(0)), F.lit(""))))
        keys.insert(1, _key(2, "m1:", F.col("_m"), 5, (F.length(t0) >= 2) & (F.length("_m") >= 2)))
    return norm.withColumn("keys", F.filter(F.array(*keys), lambda k: k.isNotNull())).drop("_m")


def _each(values: Column, prefix: str, w: Column, kord: int) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kord).alias("kord"), F.concat(F.lit(prefix), v).alias("key"), w.alias("w")))


def cascade_keys(canon: DataFrame, phonetic: bool = True) -> DataFrame:
    """``canon`` (see ``text.canonical``) plus ``keys`` of the cascade; a key may repeat within a record."""
    first = F.col("core_first")
    tokens = F.filter(F.slice("core_toks", 1, 6), lambda t: F.length(t) >= 3)
    weighted = F.transform(tokens, lambda t: F.struct(F.lit(2).alias("kord"), F.concat(F.lit("tok:"), t).alias("key"), F.when(t == first, 4.0).otherwise(2.5).alias("w")))
    parts = [
        F.when(F.col("canon_name") != "", F.array(F.struct(F.lit(1).alias("kord"), F.concat(F.lit("nsig:"), "canon_name").alias("key"), F.lit(10.0).alias("w")))).otherwise(F.expr(_NONE)),
        weighted,
        _each(F.filter("addr_nums", lambda n: F.length(n) >= 3), "num:", F.lit(3.0), 4),
        _each(F.slice("trigrams", 1, 4), "tri:", F.lit(0.5), 5),
    ]
    if phonetic:
        sounds = F.slice(F.filter("core_toks", lambda t: F.length(t) >= 3), 1, 3)
        canon = canon.withColumn("_words", F.array_join(F.transform(sounds, lambda t: F.replace(t, F.lit(" "), F.lit(""))), " ")).withColumn("_m", F.filter(F.split(metaphone(F.col("_words")), " "), lambda m: m != ""))
        parts.append(_each(F.col("_m"), "m:", F.lit(2.0), 3))
    return canon.withColumn("keys", F.concat(*parts)).drop("_words", "_m")


def experiment_keys(records: DataFrame) -> DataFrame:
    """``records`` plus ``keys`` of the first experiments: prefix, second and third word, numbers with words, codes."""
    df = records.withColumns({"_n": text.legacy_words(F.col("name")), "_a": text.legacy_words(F.col("addr")), "_d": text.numbers(F.coalesce("addr", F.lit("")))})
    at = lambda i: F.coalesce(F.get("_n", F.lit(i)), F.lit(""))
    single = [
        _key(1, "n1:", at(0), 5, F.length(at(0)) >= 2),
        _key(2, "npref:", F.substring(at(0), 1, 4), 3, F.length(at(0)) >= 4),
        _key(3, "n2:", at(1), 3, F.length(at(1)) >= 2),
        _key(4, "nb:", F.concat(at(0), F.lit("_"), at(1)), 5, F.length(at(1)) >= 2),
        _key(5, "n3:", at(2), 3, F.length(at(2)) >= 3),
    ]
    some, numbers = F.filter(F.slice("_a", 1, 4), lambda a: F.length(a) >= 3), F.slice(F.array_distinct("_d"), 1, 3)
    beside = F.flatten(F.transform(numbers, lambda n: F.transform(F.filter(some, lambda a: a != n), lambda a: F.struct(F.lit(6).alias("kord"), F.concat(F.lit("na:"), n, F.lit("_"), a).alias("key"), F.lit(2.0).alias("w")))))
    codes = _each(F.filter(F.array_distinct("_d"), lambda n: F.length(n).between(5, 6)), "pin:", F.lit(1.0), 7)
    every = F.concat(F.filter(F.array(*single), lambda k: k.isNotNull()), F.array_distinct(beside), codes)
    return df.withColumn("keys", every).drop("_n", "_a", "_d")


def idf_keys(records: DataFrame) -> DataFrame:
    """``records`` plus distinct ``keys`` weighted by kind: name words 3, numbers 1.5, address words 1."""
    df = records.withColumns({"_n": text.words(text._cleaned(F.col("name"), [])), "_l": text._cleaned(F.col("addr"), [])})
    stop = text.lexicon.LEGACY_STOPWORDS
    n0, n1 = F.coalesce(F.get("_n", F.lit(0)), F.lit("")), F.coalesce(F.get("_n", F.lit(1)), F.lit(""))
    pair = F.when((n1 != "") & ~n0.isin(stop) & ~n1.isin(stop), F.array(F.struct(F.lit(2).alias("kord"), F.concat(F.lit("nb_"), n0, F.lit("_"), n1).alias("key"), F.lit(3.0).alias("w")))).otherwise(F.expr(_NONE))
    names = _each(F.filter("_n", lambda t: (F.length(t) >= 3) & ~t.isin(stop)), "n_", F.lit(3.0), 1)
    spaced = F.regexp_replace("_l", "[^a-z0-9]+", " ")
    nums = _each(F.regexp_extract_all(spaced, F.lit(r"\b\d{2,6}\b"), F.lit(0)), "num_", F.lit(1.5), 3)
    addr = _each(F.filter(F.split(spaced, " "), lambda t: (F.length(t) >= 4) & ~t.isin(stop)), "a_", F.lit(1.0), 4)
    return df.withColumn("keys", F.array_distinct(F.concat(names, pair, nums, addr))).drop("_n", "_l")
