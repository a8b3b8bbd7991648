"""Normalisation of names and addresses as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import lexicon

ID_SUFFIX = r"(?i)\s*\(ID:\s*\d+\)\s*$"
DOMAIN = r"(?i)(\.com|\.net|\.org|\.in|\.co|\.fr|\.io|\.biz|\.edu|\.info|www\.|https?://|@)"
ID_ANYWHERE = r"(?i)\(id:\s*\d+\)"
DOMAIN_WORD = r"(?i)\b(www\.)|\.(com|in|org|net|co|io|biz|info|fr|gov|edu|mil)\b"


def plain_latin(x: Column) -> Column:
    """Accented Latin letters made plain; other scripts are left (see ``to_ascii``)."""
    for letter, pair in lexicon.DOUBLE.items():
        x = F.replace(x, F.lit(letter), F.lit(pair))
    return F.translate(x, *lexicon.latin())


def _romanised(ch: str) -> str:
    """A letter by its Unicode name: the last word of "... LETTER KA" with its inherent vowel, in lower case."""
    if ch.isascii():
        return ch
    if ch.isdigit():
        return str(unicodedata.digit(ch))
    base = unicodedata.normalize("NFKD", ch)[0]
    if base.isascii():
        return base
    words = unicodedata.name(ch, "").split()
    if "LETTER" in words and words[-1].isalpha():
        return words[-1].lower()
    if "SIGN" in words and "VOWEL" in words:
        return words[-1].lower()
    return ""


@F.pandas_udf(StringType())
def to_ascii(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Any script to ASCII, letter by letter; for texts that ``plain_latin`` leaves with other letters."""
    known: dict[str, str] = {}
    for texts in batches:
        yield texts.map(lambda t: None if t is None else "".join(known.setdefault(c, _romanised(c)) if c not in known else known[c] for c in t))


def romanised(df, columns: tuple[str, ...] = ("name", "addr")):
    """``df`` with letters of other scripts in some columns made ASCII; rows of Latin letters do not reach Python."""
    for c in columns:
        latin = plain_latin(F.col(c))
        other = F.when(latin.rlike(r"[^\x00-\x7F]"), F.col(c))
        df = df.withColumn("_other", to_ascii(other)).withColumn(c, F.coalesce("_other", F.col(c))).drop("_other")
    return df


def _cleaned(x: Column, patterns: list[tuple[str, str]]) -> Column:
    x = F.coalesce(x, F.lit(""))
    for pattern, to in patterns:
        x = F.regexp_replace(x, pattern, to)
    return F.lower(plain_latin(x))


def words(x: Column) -> Column:
    """ASCII words of a lower-case text."""
    return F.filter(F.split(x, "[^a-z0-9]+"), lambda t: t != "")


def expanded(tokens: Column, table: dict[str, str]) -> Column:
    """Tokens with known spellings replaced; a set test spares most tokens the look-up."""
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    known = [k for k, v in table.items() if k != v]
    return F.transform(tokens, lambda t: F.when(t.isin(known), F.try_element_at(pairs, t)).otherwise(t))


def without(tokens: Column, stop: list[str]) -> Column:
    """Tokens outside a list, order and duplicates kept."""
    return F.filter(tokens, lambda t: ~t.isin(stop))


def stripped_zeros(n: Column) -> Column:
    return F.regexp_replace(n, "^0+", "")


def numbers(lowered: Column) -> Column:
    """Whole numbers of one to six digits without leading zeros, in order."""
    found = F.transform(F.regexp_extract_all(lowered, F.lit(r"\b\d+\b"), F.lit(0)), stripped_zeros)
    return F.filter(found, lambda n: F.length(n).between(1, 6))


def raw_numbers(addr: Column) -> Column:
    """Distinct numbers of a raw address, digits of any script, as written."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(addr, F.lit("")), F.lit(r"(?U)\b\d+\b"), F.lit(0)))


def cleaned_name(name: Column) -> Column:
    return _cleaned(name, [(ID_SUFFIX, ""), (DOMAIN, " ")])


def cleaned_address(addr: Column) -> Column:
    return _cleaned(addr, [(DOMAIN, " ")])


def normalised(df, name: str = "name", addr: str = "addr"):
    """``df`` plus n_norm, a_norm, n_toks, a_toks, first_tok and nums."""
    df = df.withColumn("_n", expanded(words(cleaned_name(F.col(name))), lexicon.ABBREVIATIONS))
    df = df.withColumn("_l", cleaned_address(F.col(addr))).withColumn("_a", expanded(words(F.col("_l")), lexicon.ABBREVIATIONS))
    df = df.withColumns({"n_norm": F.array_join("_n", " "), "a_norm": F.array_join("_a", " "), "n_toks": without(F.col("_n"), lexicon.STOPWORDS), "a_toks": without(F.col("_a"), lexicon.STOPWORDS), "nums": numbers(F.col("_l"))})
    return df.withColumn("first_tok", F.coalesce(F.get("n_toks", F.lit(0)), F.lit(""))).drop("_n", "_l", "_a")


def sorted_signature(tokens: Column) -> Column:
    return F.array_join(F.sort_array(tokens), " ")


def street_number(a_norm: Column) -> Column:
    """The digits of the first of three words that holds one to five of them."""
    digits = F.transform(F.slice(F.split(a_norm, " "), 1, 3), lambda w: F.regexp_replace(w, "[^0-9]", ""))
    return F.coalesce(F.get(F.filter(digits, lambda d: F.length(d).between(1, 5)), F.lit(0)), F.lit(""))


def postal_code(a_norm: Column) -> Column:
    """The last number of five or six digits."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(a_norm, F.lit(r"\b(\d{5}(?:-\d{4})?|\d{6})\b"), F.lit(1)), F.lit(-1)), F.lit(""))


def basic(x: Column) -> Column:
    """Words of the canonical generation."""
    return words(_cleaned(x, [(ID_ANYWHERE, " "), (DOMAIN_WORD, " ")]))


def canonical(df, name: str = "name", addr: str = "addr"):
    """``df`` plus canon_name, core_toks, core_first, canon_addr, addr_nums, locality and trigrams."""
    df = df.withColumns({"_n": expanded(basic(F.col(name)), lexicon.EXPANSIONS), "_a": expanded(basic(F.col(addr)), lexicon.EXPANSIONS)})
    core = F.filter("_n", lambda t: ~t.isin(lexicon.SUFFIXES) & (F.length(t) > 1))
    df = df.withColumn("_c", core).withColumn("core_toks", F.when(F.size("_c") > 0, F.col("_c")).otherwise(F.filter("_n", lambda t: F.length(t) > 1)))
    nums = F.filter(F.transform(F.filter("_a", lambda t: t.rlike("^[0-9]+$")), stripped_zeros), lambda n: F.length(n).between(1, 6))
    local = F.filter("_a", lambda t: ~t.rlike("^[0-9]+$") & (F.length(t) > 1) & ~t.isin(lexicon.SUFFIXES))
    df = df.withColumns({"canon_name": sorted_signature(F.col("core_toks")), "core_first": F.coalesce(F.get("core_toks", F.lit(0)), F.lit("")), "addr_nums": F.sort_array(F.array_distinct(nums)), "locality": F.sort_array(F.array_distinct(local)), "_s": F.array_join("core_toks", "")})
    grams = F.when(F.length("_s") >= 3, F.transform(F.sequence(F.lit(1), F.length("_s") - 2), lambda i: F.substring(F.col("_s"), i, F.lit(3)))).otherwise(F.expr("cast(array() as array<string>)"))
    joined = F.concat(F.array_join("addr_nums", " "), F.lit(" | "), F.array_join("locality", " "))
    return df.withColumns({"canon_addr": F.when(F.size("_a") > 0, joined).otherwise(""), "trigrams": grams}).drop("_n", "_a", "_c", "_s")


def legacy_words(x: Column) -> Column:
    """Words of the first experiments: no expansion, shorter stoplist."""
    return without(words(_cleaned(x, [(DOMAIN, " ")])), lexicon.LEGACY_STOPWORDS)
