"""Registered queries of the record-linkage operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.distance import with_measures
from tessera.functions.phonetic import metaphone
from tessera.operators import audit, blocking, decide, evaluate, features, keys, model, splits
from tessera.plans import linkage, oracle
from tessera.plans.oracle import CANON, CASCADE_KEYS, EXPERIMENT_KEYS, F_HALF, IDF_KEYS, KEYS, NORM, RECORDS, TOTALS, TRUTH, with_
from tessera.sources import lists, tables
from tessera.sources.adapters import ADAPTERS, table, true_pairs

#: Key frequency cap; ``key_df_cap`` and ``capped_candidates`` use a smaller one, which binds on the small example tables.
CAP, SMALL_CAP = blocking.KEY_CAP, 30
#: Largest blocking score, to turn scores into 0 to 1.
FULL = 24.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _joined(*names: str):
    return [F.array_join(n, " ").alias(n) for n in names]


def _records(spark, sf_dir, adapter="parts"):
    return tables.spread(ADAPTERS[adapter](spark, sf_dir))


def _norm(spark, sf_dir, adapter="parts"):
    return text.normalised(_records(spark, sf_dir, adapter))


def _canon(spark, sf_dir, adapter="parts"):
    return text.canonical(_records(spark, sf_dir, adapter))


# --- text -----------------------------------------------------------------------------------------------------------

_NORM_SELECT = "SELECT entity_id, n_norm, md5(a_norm) AS a_norm_md5, array_to_string(n_toks, ' ') AS n_toks, CAST(len(a_toks) AS BIGINT) AS n_a_toks, first_tok, array_to_string(nums, ' ') AS nums FROM norm"


def _norm_rows(norm: DataFrame) -> DataFrame:
    return norm.select("entity_id", "n_norm", F.md5(F.col("a_norm").cast("binary")).alias("a_norm_md5"), *_joined("n_toks"), F.size("a_toks").cast("long").alias("n_a_toks"), "first_tok", *_joined("nums"))


@query(with_(RECORDS["parts"], NORM, select=_NORM_SELECT))
def norm_records(spark, sf_dir):
    return _norm_rows(_norm(spark, sf_dir))


@query(with_(RECORDS["docs"], NORM, select=_NORM_SELECT))
def norm_documents(spark, sf_dir):
    return _norm_rows(_norm(spark, sf_dir, "docs"))


@query(with_(RECORDS["parties"], NORM, select=_NORM_SELECT))
def norm_parties(spark, sf_dir):
    return _norm_rows(_norm(spark, sf_dir, "parties"))


@query(with_(RECORDS["parts"], NORM, select="SELECT entity_id, array_to_string(list_sort(n_toks), ' ') AS signature FROM norm"))
def sorted_signature(spark, sf_dir):
    return _norm(spark, sf_dir).select("entity_id", text.sorted_signature(F.col("n_toks")).alias("signature"))


@query(
    with_(
        RECORDS["parts"], NORM,
        select="""SELECT entity_id,
  coalesce(list_filter(list_transform(string_split(a_norm, ' ')[1:3], lambda w: regexp_replace(w, '[^0-9]', '', 'g')), lambda d: length(d) BETWEEN 1 AND 5)[1], '') AS street_number,
  coalesce(regexp_extract_all(a_norm, '\\b(\\d{5}(?:-\\d{4})?|\\d{6})\\b', 1)[-1], '') AS postal_code,
  array_to_string(list_filter(a_toks, lambda t: NOT regexp_matches(t, '[0-9]')), ' ') AS locality FROM norm""",
    )
)
def address_components(spark, sf_dir):
    local = F.filter("a_toks", lambda t: ~t.rlike("[0-9]"))
    return _norm(spark, sf_dir).select("entity_id", text.street_number(F.col("a_norm")).alias("street_number"), text.postal_code(F.col("a_norm")).alias("postal_code"), F.array_join(local, " ").alias("locality"))


_CANON_SELECT = "SELECT entity_id, canon_name, md5(canon_addr) AS canon_addr_md5, core_first, array_to_string(addr_nums, ' ') AS addr_nums, CAST(len(locality) AS BIGINT) AS n_locality, array_to_string(trigrams, ' ') AS trigrams FROM canon"


def _canon_rows(canon: DataFrame) -> DataFrame:
    return canon.select("entity_id", "canon_name", F.md5(F.col("canon_addr").cast("binary")).alias("canon_addr_md5"), "core_first", *_joined("addr_nums"), F.size("locality").cast("long").alias("n_locality"), *_joined("trigrams"))


@query(with_(RECORDS["parts"], CANON, select=_CANON_SELECT))
def canonical_records(spark, sf_dir):
    return _canon_rows(_canon(spark, sf_dir))


@query(with_(RECORDS["docs"], CANON, select=_CANON_SELECT))
def canonical_documents(spark, sf_dir):
    return _canon_rows(_canon(spark, sf_dir, "docs"))


@query()
def metaphone_codes(spark, sf_dir):
    norm = _norm(spark, sf_dir)
    return norm.select("entity_id", "n_norm", metaphone(F.col("n_norm")).alias("codes"))


# --- keys and blocking ----------------------------------------------------------------------------------------------

_KEY_SELECT = "SELECT entity_id, kord, key, w FROM keyed"


def _keyed(spark, sf_dir, adapter="parts"):
    return keys.production_keys(_norm(spark, sf_dir, adapter), phonetic=False)


def _cascade_keyed(spark, sf_dir, adapter="parts"):
    return keys.cascade_keys(_canon(spark, sf_dir, adapter), phonetic=False)


def _key_rows(keyed: DataFrame) -> DataFrame:
    return blocking.exploded(keyed).select("entity_id", "kord", "key", "w")


@query(with_(RECORDS["parts"], NORM, KEYS, select=_KEY_SELECT))
def block_keys_production(spark, sf_dir):
    return _key_rows(_keyed(spark, sf_dir))


@query(with_(RECORDS["docs"], NORM, KEYS, select=_KEY_SELECT))
def block_keys_documents(spark, sf_dir):
    return _key_rows(_keyed(spark, sf_dir, "docs"))


@query(with_(RECORDS["parts"], CANON, CASCADE_KEYS, select=_KEY_SELECT))
def block_keys_cascade(spark, sf_dir):
    return _key_rows(_cascade_keyed(spark, sf_dir))


@query(with_(RECORDS["parts"], EXPERIMENT_KEYS, select=_KEY_SELECT))
def block_keys_experiment(spark, sf_dir):
    return _key_rows(keys.experiment_keys(_records(spark, sf_dir)))


@query()
def block_keys_phonetic(spark, sf_dir):
    return _key_rows(keys.production_keys(_norm(spark, sf_dir)))


@query(with_(RECORDS["docs"], NORM, KEYS, select=f"SELECT country, key, count(*) AS df, count(*) <= {SMALL_CAP} AS kept FROM keyed WHERE source <> 1 GROUP BY ALL"))
def key_df_cap(spark, sf_dir):
    pool = blocking.exploded(_keyed(spark, sf_dir, "docs").where("source <> 1"))
    return blocking.key_frequency(pool).withColumn("kept", F.col("df") <= SMALL_CAP)


_PAIR_SELECT = "SELECT s1, cand, blk, min_kord FROM pairs"
_CAND_SELECT = "SELECT s1, cand, blk, rnk FROM cands"
_PRODUCTION = (RECORDS["parts"], NORM, KEYS, oracle.scored(CAP), oracle.top(30))
_CASCADE = (RECORDS["parts"], CANON, CASCADE_KEYS, oracle.scored(CAP, "nsig:"), oracle.top(50))


def _cands(spark, sf_dir, cap=CAP):
    return blocking.candidates(_keyed(spark, sf_dir), cap, 30)


def _cascade_cands(spark, sf_dir, cap=CAP):
    return blocking.candidates(_cascade_keyed(spark, sf_dir), cap, 50, never="nsig:")


def _judged(spark, sf_dir, judge):
    """``judge(candidates, canonical records)`` of the cascade, asked once for equal records of source 1."""
    some, equals = blocking.one_of_equals(_records(spark, sf_dir))
    canon = text.canonical(some)
    cands = blocking.candidates(keys.cascade_keys(canon, phonetic=False), CAP, 50, never="nsig:")
    return blocking.for_equals(judge(cands, canon), equals)


@query(with_(*_PRODUCTION, select=_PAIR_SELECT))
def block_score_production(spark, sf_dir):
    return blocking.all_pairs(_keyed(spark, sf_dir), CAP).select("s1", "cand", "blk", "min_kord")


@query(with_(*_PRODUCTION, select=_CAND_SELECT))
def topk_candidates_production(spark, sf_dir):
    return _cands(spark, sf_dir).select("s1", "cand", "blk", F.col("rnk").cast("long").alias("rnk"))


@query(with_(RECORDS["docs"], NORM, KEYS, oracle.scored(500), oracle.top(30), select=_CAND_SELECT))
def topk_candidates_documents(spark, sf_dir):
    return blocking.candidates(_keyed(spark, sf_dir, "docs")).select("s1", "cand", "blk", F.col("rnk").cast("long").alias("rnk"))


@query(with_(*_CASCADE, select=_PAIR_SELECT))
def block_score_cascade(spark, sf_dir):
    return blocking.all_pairs(_cascade_keyed(spark, sf_dir), CAP, "nsig:").select("s1", "cand", "blk", "min_kord")


@query(with_(*_CASCADE, select=_CAND_SELECT))
def topk_candidates_cascade(spark, sf_dir):
    return _cascade_cands(spark, sf_dir).select("s1", "cand", "blk", F.col("rnk").cast("long").alias("rnk"))


@query(with_(RECORDS["parts"], EXPERIMENT_KEYS, oracle.scored(400), oracle.top(25), select=_CAND_SELECT))
def topk_candidates_experiment(spark, sf_dir):
    return blocking.candidates(keys.experiment_keys(_records(spark, sf_dir)), 400, 25).select("s1", "cand", "blk", F.col("rnk").cast("long").alias("rnk"))


@query(with_(RECORDS["docs"], NORM, KEYS, oracle.scored(SMALL_CAP), oracle.top(30), select=_CAND_SELECT))
def capped_candidates(spark, sf_dir):
    """As ``topk_candidates_documents``, with a cap that cuts common keys of the small example tables too."""
    return blocking.candidates(_keyed(spark, sf_dir, "docs"), SMALL_CAP, 30).select("s1", "cand", "blk", F.col("rnk").cast("long").alias("rnk"))


_IDF_SELECT = "SELECT s1, cand, CAST(blk AS DOUBLE) AS blk, rnk FROM cands"


def _idf(spark, sf_dir, cap, k, plus):
    found = blocking.idf_candidates(keys.idf_keys(_records(spark, sf_dir)), cap, k, plus)
    return found.select("s1", "cand", F.col("blk").cast("double").alias("blk"), F.col("rnk").cast("long").alias("rnk"))


@query(with_(RECORDS["parts"], IDF_KEYS, oracle.idf_scored(500, 0.0), oracle.top(25), select=_IDF_SELECT))
def idf_retrieval(spark, sf_dir):
    return _idf(spark, sf_dir, 500, 25, 0.0)


@query(with_(RECORDS["parts"], IDF_KEYS.replace("3.0", "2.5"), oracle.idf_scored(10_000, 1.0), oracle.top(30), select=_IDF_SELECT))
def idf_retrieval_plus(spark, sf_dir):
    lighter = keys.idf_keys(_records(spark, sf_dir))
    lighter = lighter.withColumn("keys", F.transform("keys", lambda k: k.withField("w", F.when(k["w"] == 3.0, 2.5).otherwise(k["w"]))))
    found = blocking.idf_candidates(lighter, 10_000, 30, 1.0)
    return found.select("s1", "cand", F.col("blk").cast("double").alias("blk"), F.col("rnk").cast("long").alias("rnk"))


@query(
    with_(
        *_PRODUCTION, TRUTH["parts"],
        "want AS (SELECT DISTINCT s1, cand FROM truth), ks AS (SELECT unnest([1, 10, 20, 30]) AS k)",
        select="SELECT CAST(k AS INT) AS k, count(*) AS total_true, count(*) FILTER (rnk <= k) AS hits, count(*) FILTER (rnk <= k) / count(*) AS recall FROM want LEFT JOIN cands USING (s1, cand) CROSS JOIN ks GROUP BY k",
    )
)
def recall_at_k(spark, sf_dir):
    records = _records(spark, sf_dir)
    return evaluate.recall_at(true_pairs(records, "parts"), records.where("source <> 1"), _cands(spark, sf_dir), [1, 10, 20, 30])


@query(
    with_(
        *_PRODUCTION,
        "n AS (SELECT entity_id, (SELECT count(*) FROM cands WHERE s1 = entity_id) AS n FROM rec WHERE source = 1)",
        select="SELECT avg(n) AS mean_candidates, quantile_cont(n, 0.5) AS median_candidates, quantile_cont(n, 0.9) AS p90_candidates, 1 - avg(n) / (SELECT count(*) FROM rec WHERE source <> 1) AS reduction FROM n",
    )
)
def blocking_volume(spark, sf_dir):
    records = _records(spark, sf_dir)
    size = records.where("source <> 1").agg(F.count("*").alias("n"))
    return blocking.volume(_cands(spark, sf_dir), records.where("source = 1"), size)


# --- features -------------------------------------------------------------------------------------------------------

_BOTH = """f AS (SELECT c.s1, c.cand, c.blk, c.rnk, s.n_norm AS sn, s.a_norm AS sa, s.n_toks AS st, s.a_toks AS sat, s.first_tok AS sf, s.nums AS su,
  p.n_norm AS cn, p.a_norm AS ca, p.n_toks AS ct, p.first_tok AS cf, p.nums AS cu,
  list_filter(string_split(p.n_norm, ' '), lambda t: t <> '') AS cnw, list_filter(string_split(p.a_norm, ' '), lambda t: t <> '') AS caw,
  list_filter(string_split(s.n_norm, ' '), lambda t: t <> '') AS snw
  FROM cands c JOIN norm s ON c.s1 = s.entity_id JOIN norm p ON c.cand = p.entity_id)"""
_FEATURES = (*_PRODUCTION, _BOTH)


def _jacc(a: str, b: str) -> str:
    return f"CAST(len(list_intersect({a}, {b})) AS DOUBLE) / greatest(1, len(list_distinct(list_concat({a}, {b}))))"


def _flag(x: str) -> str:
    return f"CAST(coalesce({x}, FALSE) AS INT)::DOUBLE"


def _pairs(spark, sf_dir):
    norm = _norm(spark, sf_dir)
    return features.paired(_cands(spark, sf_dir), norm, features.NORM_COLUMNS)


@query(
    with_(
        *_FEATURES,
        select=f"""SELECT s1, cand, {_flag("sf <> '' AND sf = cf")} AS first_match, round({_jacc("st", "cnw")}, 9) AS n_jacc, round({_jacc("sat", "caw")}, 9) AS a_jacc,
  CAST(len(list_intersect(su, cu)) AS DOUBLE) AS num_overlap, {_flag("len(list_intersect(su, cu)) > 0")} AS has_num_overlap,
  {_flag("len(su) > 0 AND len(cu) > 0 AND len(list_intersect(su, cu)) = 0")} AS num_mismatch FROM f""",
    )
)
def feat_set_overlap(spark, sf_dir):
    return features.overlap(_pairs(spark, sf_dir)).select("s1", "cand", "first_match", F.round("n_jacc", 9).alias("n_jacc"), F.round("a_jacc", 9).alias("a_jacc"), "num_overlap", "has_num_overlap", "num_mismatch")


def _first(nums: str, low: int, high: int) -> str:
    return f"coalesce(list_filter({nums}, lambda n: length(n) BETWEEN {low} AND {high})[1], '')"


@query(
    with_(
        *_FEATURES,
        f"g AS (SELECT *, {_first('su', 1, 4)} AS s4, {_first('cu', 1, 4)} AS c4, {_first('su', 5, 6)} AS s6, {_first('cu', 5, 6)} AS c6 FROM f)",
        select=f"""SELECT s1, cand, {_flag("sa = ''")} AS addr_missing_s1, {_flag("ca = ''")} AS addr_missing_cand, {_flag("sa <> '' AND ca <> ''")} AS addr_both_present,
  {_flag("s4 <> '' AND s4 = c4")} AS street_num_match, {_flag("s4 <> '' AND c4 <> '' AND s4 <> c4")} AS street_num_mismatch,
  {_flag("s6 <> '' AND s6 = c6")} AS postal_match, {_flag("s6 <> '' AND c6 <> '' AND s6 <> c6")} AS postal_mismatch,
  {_flag("len(st) > 0 AND st[-1] = ct[-1]")} AS last_match FROM g""",
    )
)
def feat_components(spark, sf_dir):
    names = ["addr_missing_s1", "addr_missing_cand", "addr_both_present", "street_num_match", "street_num_mismatch", "postal_match", "postal_mismatch", "last_match"]
    return features.overlap(_pairs(spark, sf_dir)).select("s1", "cand", *names)


@query(
    with_(
        *_FEATURES,
        "g AS (SELECT *, array_to_string(list_transform(snw, lambda t: t[1]), '') AS si, array_to_string(list_transform(cnw, lambda t: t[1]), '') AS ci FROM f)",
        select="""SELECT s1, cand, CASE WHEN len(snw) = 0 OR len(cnw) = 0 THEN 0.0::DOUBLE
  WHEN (list_contains(cnw, si) AND length(si) >= 2) OR (list_contains(snw, ci) AND length(ci) >= 2) THEN 1.0::DOUBLE
  WHEN si = ci AND length(si) >= 2 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS initials_match FROM g""",
    )
)
def feat_initials(spark, sf_dir):
    return features.overlap(_pairs(spark, sf_dir)).select("s1", "cand", "initials_match")


_JW = "round(CASE WHEN {a} <> '' AND {b} <> '' THEN 100 * jaro_winkler_similarity({a}, {b}) ELSE 0.0 END, 6)"
_DL = "round(CASE WHEN {a} <> '' AND {b} <> '' THEN 100 * (1 - damerau_levenshtein({a}, {b}) / greatest(length({a}), length({b}))) ELSE 0.0 END, 6)"


def _measured(spark, sf_dir, names):
    df = with_measures(_pairs(spark, sf_dir), "s_n_norm", "c_n_norm", "n_", names)
    df = with_measures(df, "s_a_norm", "c_a_norm", "a_", names)
    return df.select("s1", "cand", *[F.round(f"{side}_{n}", 6).alias(f"{side}_{n}") for side in "na" for n in names])


@query(with_(*_FEATURES, select=f"SELECT s1, cand, {_JW.format(a='sn', b='cn')} AS n_jw, {_JW.format(a='sa', b='ca')} AS a_jw FROM f"))
def feat_jaro_winkler(spark, sf_dir):
    return _measured(spark, sf_dir, ["jw"])


@query(with_(*_FEATURES, select=f"SELECT s1, cand, {_DL.format(a='sn', b='cn')} AS n_dl, {_DL.format(a='sa', b='ca')} AS a_dl FROM f"))
def feat_damerau(spark, sf_dir):
    return _measured(spark, sf_dir, ["dl"])


@query()
def feat_fuzzy_ratios(spark, sf_dir):
    return _measured(spark, sf_dir, ["set", "sort", "part", "ratio", "lcs"])


@query()
def feature_vector_34(spark, sf_dir):
    norm, cands = linkage.production_candidates(_records(spark, sf_dir))
    return features.production(cands, norm)


@query()
def feature_vector_15(spark, sf_dir):
    return _judged(spark, sf_dir, features.cascade)


@query()
def feature_vector_13(spark, sf_dir):
    return features.experiment(_cands(spark, sf_dir, blocking.KEY_CAP), _norm(spark, sf_dir))


# --- decisions ------------------------------------------------------------------------------------------------------

_LINEAR = f"""lin AS (SELECT s1, cand, round(0.5 * {_JW.format(a="sn", b="cn")}
  + 0.35 * CASE WHEN sa <> '' AND ca <> '' THEN {_JW.format(a="sa", b="ca")} ELSE 50.0 END
  + 0.15 * CASE WHEN len(su) = 0 OR len(cu) = 0 THEN 50.0 WHEN len(list_intersect(su, cu)) > 0 THEN 100.0 ELSE 20.0 END, 9) AS score FROM f)"""


def _linear(spark, sf_dir):
    df = with_measures(_pairs(spark, sf_dir), "s_n_norm", "c_n_norm", "n_", ["jw"])
    df = with_measures(df, "s_a_norm", "c_a_norm", "a_", ["jw"])
    addr = F.when((F.col("s_a_norm") != "") & (F.col("c_a_norm") != ""), F.round("a_jw", 6))
    return df.select("s1", "cand", F.round(decide.linear_score(F.round("n_jw", 6), addr, F.col("s_nums"), F.col("c_nums")), 9).alias("score"))


@query(with_(*_FEATURES, _LINEAR, select="SELECT s1, cand, score FROM lin"))
def linear_score(spark, sf_dir):
    return _linear(spark, sf_dir)


@query(
    with_(
        *_FEATURES, _LINEAR,
        "t AS (SELECT unnest([65.0, 70.0, 75.0, 80.0, 85.0])::DOUBLE AS threshold)",
        "own AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY score DESC, s1) AS r FROM lin)",
        select="SELECT threshold, count(*) FILTER (score >= threshold) AS independent, count(*) FILTER (score >= threshold AND r = 1) AS exclusive FROM own CROSS JOIN t GROUP BY threshold",
    )
)
def independent_vs_exclusive(spark, sf_dir):
    scored = _linear(spark, sf_dir).withColumnRenamed("score", "p")
    owned = decide.exclusive(scored, 0.0).select("s1", "cand", F.lit(True).alias("own"))
    each = F.explode(F.array(*[F.lit(t) for t in (65.0, 70.0, 75.0, 80.0, 85.0)])).alias("threshold")
    both = scored.join(owned, ["s1", "cand"], "left").select("p", "own", each)
    ok = F.col("p") >= F.col("threshold")
    return both.groupBy("threshold").agg(F.count(F.when(ok, 1)).alias("independent"), F.count(F.when(ok & F.col("own"), 1)).alias("exclusive"))


_CANON_PAIRS = """cf AS (SELECT c.s1, c.cand, c.blk, s.canon_name AS sn, p.canon_name AS cn, s.canon_addr AS sa, p.canon_addr AS ca, s.core_toks AS st,
  s.addr_nums AS su, p.addr_nums AS cu, len(list_intersect(s.locality, p.locality)) AS loc, len(list_intersect(s.addr_nums, p.addr_nums)) AS shared
  FROM cands c JOIN canon s ON c.s1 = s.entity_id JOIN canon p ON c.cand = p.entity_id)"""
_TIERS = """tiers AS (SELECT s1, cand, blk, sn <> '' AND sn = cn AND CASE WHEN len(su) > 0 AND len(cu) > 0 THEN shared > 0 AND loc >= 1
    WHEN sa <> '' AND ca <> '' THEN loc >= 2 ELSE len(st) >= 2 AND length(sn) >= 10 END AS one FROM cf)"""


@query(with_(*_CASCADE, _CANON_PAIRS, _TIERS, select="SELECT s1, cand, blk FROM tiers WHERE one"))
def tier1(spark, sf_dir):
    """The first tier with address likeness counted as 0."""
    return _judged(spark, sf_dir, lambda cands, canon: decide.tiers(cands, canon, exact_address=False).where("tier = 1").select("s1", "cand", "blk"))


@query()
def cascade_tiers(spark, sf_dir):
    return _judged(spark, sf_dir, decide.tiers)


@query()
def cascade_matches(spark, sf_dir):
    """Tiers 1 and 2; ``cascade_with_model`` has the third."""
    matches, _ = linkage.infer_cascade(_records(spark, sf_dir))
    return matches.select("s1", "cand", "p")


@query()
def cascade_with_model(spark, sf_dir):
    """All three tiers: pairs that the rules leave open go to the trees."""
    records = _records(spark, sf_dir)
    fitted = linkage.train(records, true_pairs(records, "parts"), FEWER_ROUNDS)
    matches, _ = linkage.infer_cascade(records, fitted)
    return matches.select("s1", "cand", "p")


_P = f"scored AS (SELECT s1, cand, blk / {FULL} AS p FROM cands)"
_OWN = "own AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS r, lead(p) OVER (PARTITION BY cand ORDER BY p DESC, s1) AS second FROM scored WHERE p >= 0.3)"


def _with_p(spark, sf_dir):
    return _cands(spark, sf_dir).select("s1", "cand", (F.col("blk") / FULL).alias("p"))


@query(with_(*_PRODUCTION, _P, _OWN, select="SELECT s1, cand, p FROM own WHERE r = 1"))
def exclusive_assignment(spark, sf_dir):
    return decide.exclusive(_with_p(spark, sf_dir), 0.3)


@query(with_(*_PRODUCTION, _P, _OWN, select="SELECT s1, cand, p FROM own WHERE r = 1 AND (second IS NULL OR second <= 0 OR p - second >= 0.05)"))
def margin_guard(spark, sf_dir):
    return decide.exclusive(_with_p(spark, sf_dir), 0.3, 0.05)


_LISTS = """spine AS (SELECT entity_id AS s1, country FROM rec WHERE source = 1),
mlist AS (SELECT s.s1, coalesce(array_to_string(list_sort(list(o.cand) FILTER (o.cand IS NOT NULL)), ','), '') AS matches
  FROM spine s LEFT JOIN (SELECT * FROM own WHERE r = 1) o ON s.s1 = o.s1 GROUP BY s.s1),
clist AS (SELECT s.s1, coalesce(array_to_string(list_sort(list(c.cand) FILTER (c.cand IS NOT NULL)), ','), '') AS candidates
  FROM spine s LEFT JOIN cands c ON s.s1 = c.s1 GROUP BY s.s1)"""


def _lists(spark, sf_dir):
    spine = linkage.spine(_records(spark, sf_dir))
    cands = _cands(spark, sf_dir)
    matches = decide.exclusive(cands.select("s1", "cand", (F.col("blk") / FULL).alias("p")), 0.3)
    return spine, decide.lists(spine, matches, "matches"), decide.lists(spine, cands, "candidates")


@query(with_(*_PRODUCTION, _P, _OWN, _LISTS, select="SELECT s1, matches FROM mlist"))
def match_lists(spark, sf_dir):
    return _lists(spark, sf_dir)[1]


@query(
    with_(
        *_PRODUCTION, _P, _OWN, _LISTS,
        "sp AS (SELECT s1, list_filter(string_split(candidates, ','), lambda x: x <> '') AS c, list_filter(string_split(matches, ','), lambda x: x <> '') AS m FROM clist JOIN mlist USING (s1))",
        select="SELECT s1, array_to_string(list_concat(c, list_filter(m, lambda x: NOT list_contains(c, x))), ',') AS candidates FROM sp",
    )
)
def candidates_with_matches(spark, sf_dir):
    _, matches, cands = _lists(spark, sf_dir)
    return decide.with_matches(cands, matches)


@query(
    with_(
        *_PRODUCTION, _P, _OWN, _LISTS,
        "sp AS (SELECT s1, list_filter(string_split(candidates, ','), lambda x: x <> '') AS c, list_filter(string_split(matches, ','), lambda x: x <> '') AS m FROM clist JOIN mlist USING (s1))",
        select="SELECT * FROM (SELECT s1, array_to_string(list_sort(list_filter(m, lambda x: NOT list_contains(c, x))), ',') AS extra FROM sp) WHERE extra <> ''",
    )
)
def matches_not_candidates(spark, sf_dir):
    _, matches, cands = _lists(spark, sf_dir)
    return lists.not_subset(matches.withColumnRenamed("matches", "ids"), cands.withColumnRenamed("candidates", "ids"))


#: A list file with every kind of fault, made from the records themselves.
_FAULTY = """lines AS (
  SELECT entity_id AS s1, CASE p_no % 7 WHEN 0 THEN '' WHEN 1 THEN 'S2-1,S2-1' WHEN 2 THEN 'S2-4, S3-5' WHEN 3 THEN 'S1-3' WHEN 4 THEN 'S2-1,' WHEN 5 THEN 'S3-999999999' ELSE 'S2-1,S3-2' END AS ids, p_no % 50 <> 3 AS tabbed
  FROM numbered WHERE p_no % 11 <> 5
  UNION ALL SELECT entity_id, '', TRUE FROM numbered WHERE p_no % 101 = 7
  UNION ALL SELECT 'S1-unknown', '', TRUE)"""


@query(
    with_(
        RECORDS["parts"],
        "numbered AS (SELECT entity_id, CAST(substring(entity_id, 4) AS BIGINT) AS p_no FROM rec WHERE source = 1)", _FAULTY,
        """good AS (SELECT * FROM lines WHERE tabbed), ids AS (SELECT s1, unnest(string_split(ids, ',')) AS id FROM good WHERE ids <> ''),
found AS (SELECT 'no tab' AS rule, s1 AS offender FROM lines WHERE NOT tabbed
  UNION ALL SELECT 'duplicate row', s1 FROM good GROUP BY s1 HAVING count(*) > 1
  UNION ALL SELECT 'repeated id', s1 || ':' || id FROM ids GROUP BY s1, id HAVING count(*) > 1
  UNION ALL SELECT 'source 1 id', id FROM ids WHERE starts_with(id, 'S1-')
  UNION ALL SELECT 'wrong prefix', id FROM ids WHERE NOT (starts_with(id, 'S1-') OR starts_with(id, 'S2-') OR starts_with(id, 'S3-'))
  UNION ALL SELECT 'missing s1', entity_id FROM rec WHERE source = 1 AND entity_id NOT IN (SELECT s1 FROM good)
  UNION ALL SELECT 'unknown s1', s1 FROM good WHERE s1 NOT IN (SELECT entity_id FROM rec WHERE source = 1)
  UNION ALL SELECT 'unknown id', id FROM ids WHERE (starts_with(id, 'S2-') OR starts_with(id, 'S3-')) AND id NOT IN (SELECT entity_id FROM rec WHERE source <> 1)),
offenders AS (SELECT DISTINCT rule, offender FROM found)""",
        select="SELECT rule, count(*) AS n_offenders, array_to_string(list_sort(list(offender))[1:5], ',') AS examples FROM offenders GROUP BY rule",
    )
)
def validate_lists(spark, sf_dir):
    records = _records(spark, sf_dir)
    numbered = records.where("source = 1").withColumn("n", F.substring("entity_id", 4, 20).cast("long"))
    kinds = F.array(*[F.lit(x) for x in ("", "S2-1,S2-1", "S2-4, S3-5", "S1-3", "S2-1,", "S3-999999999", "S2-1,S3-2")])
    lines = numbered.where("n % 11 <> 5").select(F.col("entity_id").alias("s1"), F.get(kinds, (F.col("n") % 7).cast("int")).alias("ids"), (F.col("n") % 50 != 3).alias("tabbed"))
    again = numbered.where("n % 101 = 7").select(F.col("entity_id").alias("s1"), F.lit("").alias("ids"), F.lit(True).alias("tabbed"))
    stray = spark.range(1).select(F.lit("S1-unknown").alias("s1"), F.lit("").alias("ids"), F.lit(True).alias("tabbed"))
    return lists.violations(lines.unionByName(again).unionByName(stray), linkage.spine(records), records.where("source <> 1"))


# --- evaluation -----------------------------------------------------------------------------------------------------

_RESULT = f"""spine AS (SELECT entity_id AS s1, country FROM rec WHERE source = 1), won AS (SELECT * FROM own WHERE r = 1),
counted AS (SELECT s.s1, (SELECT count(DISTINCT cand) FROM truth t WHERE t.s1 = s.s1) AS n_true, (SELECT count(*) FROM won w WHERE w.s1 = s.s1) AS n_pred,
  (SELECT count(*) FROM won w WHERE w.s1 = s.s1 AND EXISTS (SELECT 1 FROM truth t WHERE t.s1 = w.s1 AND t.cand = w.cand)) AS tp FROM spine s),
res AS (SELECT *, {F_HALF} AS f FROM counted)"""
_EVAL = (*_PRODUCTION, _P, _OWN, TRUTH["parts"], _RESULT)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _outcomes(spark, sf_dir):
    records = _records(spark, sf_dir)
    matches = decide.exclusive(_with_p(spark, sf_dir), 0.3)
    return evaluate.outcomes(linkage.spine(records).select("s1"), true_pairs(records, "parts"), matches)


_ROUND_TOTALS = "SELECT round(macro_f05, 9) AS macro_f05, round(\"precision\", 9) AS \"precision\", round(recall, 9) AS recall, tp, fp, fn, round(singleton_accuracy, 9) AS singleton_accuracy, well_matched"


@query(with_(*_EVAL, f"tot AS (SELECT {TOTALS} FROM res)", select=_ROUND_TOTALS + " FROM tot"))
def macro_f05(spark, sf_dir):
    return _rounded(evaluate.scored(_outcomes(spark, sf_dir)).agg(*evaluate.totals()))


@query(
    with_(*_EVAL, select="SELECT CASE WHEN n_true = 0 THEN '0' WHEN n_true = 1 THEN '1' WHEN n_true <= 3 THEN '2-3' ELSE '4+' END AS bucket, count(*) AS n, round(avg(f), 9) AS macro_f05 FROM res GROUP BY 1")
)
def f05_by_bucket(spark, sf_dir):
    return _rounded(evaluate.by_truth_size(_outcomes(spark, sf_dir)))


_STEPS = [0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.84, 0.90, 0.95]
_SWEEP = f"""spine AS (SELECT entity_id AS s1 FROM rec WHERE source = 1), th AS (SELECT unnest({_STEPS})::DOUBLE AS threshold),
best AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS r FROM scored),
won AS (SELECT threshold, s1, cand, EXISTS (SELECT 1 FROM truth t WHERE t.s1 = best.s1 AND t.cand = best.cand) AS hit FROM best CROSS JOIN th WHERE r = 1 AND p >= threshold),
pc AS (SELECT threshold, s1, count(*) AS n_pred, count(*) FILTER (hit) AS tp FROM won GROUP BY ALL), tc AS (SELECT s1, count(DISTINCT cand) AS n_true FROM truth GROUP BY s1),
counted AS (SELECT threshold, s1, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM spine CROSS JOIN th LEFT JOIN pc USING (threshold, s1) LEFT JOIN tc USING (s1)),
res AS (SELECT *, {F_HALF} AS f FROM counted), tot AS (SELECT threshold, {TOTALS} FROM res GROUP BY threshold)"""


def _sweep(spark, sf_dir):
    records = _records(spark, sf_dir)
    return evaluate.threshold_sweep(linkage.spine(records), true_pairs(records, "parts"), _with_p(spark, sf_dir), _STEPS)


@query(with_(*_PRODUCTION, _P, TRUTH["parts"], _SWEEP, select=_ROUND_TOTALS + ", threshold FROM tot"))
def threshold_sweep(spark, sf_dir):
    return _rounded(_sweep(spark, sf_dir))


@query(with_(*_PRODUCTION, _P, TRUTH["parts"], _SWEEP, select="SELECT threshold, round(macro_f05, 9) AS macro_f05 FROM tot ORDER BY round(macro_f05, 9) DESC, threshold LIMIT 1"))
def best_threshold(spark, sf_dir):
    return evaluate.best_threshold(_sweep(spark, sf_dir)).select("threshold", F.round("macro_f05", 9).alias("macro_f05"))


# --- training sets and samples --------------------------------------------------------------------------------------

_TRAIN = (*_PRODUCTION, TRUTH["parts"], "want AS (SELECT DISTINCT s1, cand FROM truth)")


def _training(spark, sf_dir):
    records = _records(spark, sf_dir)
    return _cands(spark, sf_dir), true_pairs(records, "parts"), records.where("source <> 1")


@query(with_(*_TRAIN, select="SELECT c.s1, c.cand, CAST(w.s1 IS NOT NULL AS INT) AS label FROM cands c LEFT JOIN want w USING (s1, cand)"))
def pair_labels(spark, sf_dir):
    cands, truth, _ = _training(spark, sf_dir)
    return splits.labelled(cands, truth).select("s1", "cand", "label")


_FORCED = """forced AS (SELECT c.s1, c.cand, c.blk, CAST(w.s1 IS NOT NULL AS INT) AS label FROM cands c LEFT JOIN want w USING (s1, cand)
  UNION ALL SELECT s1, cand, 0.0, 1 FROM want WHERE (s1, cand) NOT IN (SELECT (s1, cand) FROM cands))"""


@query(with_(*_TRAIN, _FORCED, select="SELECT s1, cand, blk, label FROM forced"))
def teacher_forcing(spark, sf_dir):
    return splits.teacher_forced(*_training(spark, sf_dir))


@query(with_(*_TRAIN, _FORCED, select="SELECT CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg, round(least(20.0, sum(1 - label) / greatest(1, sum(label))), 9) AS weight FROM forced"))
def class_balance(spark, sf_dir):
    found = splits.class_weight(splits.teacher_forced(*_training(spark, sf_dir)))
    return found.select("pos", "neg", F.round("weight", 9).alias("weight"))


def _bucket(key: str, seed: int) -> str:
    return f"(('0x' || substring(md5('{seed}:' || {key}), 1, 8))::UBIGINT % 10000)"


@query(with_(RECORDS["docs"], select=f"SELECT entity_id, CASE WHEN {_bucket('entity_id', 42)} < 1500 THEN 'val' ELSE 'train' END AS split FROM rec WHERE source = 1"))
def holdout_split(spark, sf_dir):
    return splits.holdout(_records(spark, sf_dir, "docs").where("source = 1"), "entity_id").select("entity_id", "split")


@query(with_(RECORDS["docs"], select="SELECT entity_id FROM rec ORDER BY md5('7:' || entity_id), entity_id LIMIT 100"))
def exact_sample(spark, sf_dir):
    """A sampling operator: 100 rows by hash."""
    return splits.exact_sample(_records(spark, sf_dir, "docs"), "entity_id", 100, 7).select("entity_id")


@query(with_(RECORDS["parts"], select="SELECT entity_id, country FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY entity_id) AS r FROM rec) WHERE r <= 20"))
def stratified_head(spark, sf_dir):
    """A top-k operator: 20 records of every country."""
    return splits.stratified_head(_records(spark, sf_dir), "country", "entity_id", 20).select("entity_id", "country")


# --- relational -----------------------------------------------------------------------------------------------------


@query(with_(RECORDS["parts"], TRUTH["parts"], select="SELECT entity_id, name FROM rec WHERE source <> 1 AND entity_id IN (SELECT cand FROM truth)"))
def semi_targets(spark, sf_dir):
    records = _records(spark, sf_dir)
    targets = true_pairs(records, "parts").select(F.col("cand").alias("entity_id"))
    return records.where("source <> 1").join(targets, "entity_id", "left_semi").select("entity_id", "name")


@query(
    with_(
        RECORDS["parts"], TRUTH["parts"],
        select="SELECT t.s1, t.cand, coalesce(b.name, c.name) AS name, coalesce(b.addr, c.addr) AS addr FROM truth t LEFT JOIN (SELECT * FROM rec WHERE source = 2) b ON t.cand = b.entity_id LEFT JOIN (SELECT * FROM rec WHERE source = 3) c ON t.cand = c.entity_id WHERE b.entity_id IS NOT NULL OR c.entity_id IS NOT NULL",
    )
)
def lookup_two_sources(spark, sf_dir):
    """A candidate lies in one of two sources: one join with their union gives what two left joins would."""
    records = _records(spark, sf_dir)
    pool = records.where("source = 2").unionByName(records.where("source = 3")).select(F.col("entity_id").alias("cand"), "name", "addr")
    return true_pairs(records, "parts").join(pool, "cand").select("s1", "cand", "name", "addr")


@query(
    with_(
        RECORDS["parts"], RECORDS["parties"].replace("rec AS", "oth AS"),
        select="SELECT entity_id, arg_min(name, (ord, name)) AS name FROM (SELECT entity_id, name, 1 AS ord FROM rec UNION ALL SELECT entity_id, name, 2 FROM oth) GROUP BY entity_id",
    )
)
def union_dedup(spark, sf_dir):
    """Two sets of records together; of a repeated identifier the first set's row stays."""
    both = _records(spark, sf_dir).select("entity_id", "name", F.lit(1).alias("ord")).unionByName(_records(spark, sf_dir, "parties").select("entity_id", "name", F.lit(2).alias("ord")))
    return both.groupBy("entity_id").agg(F.min_by("name", F.struct("ord", "name")).alias("name"))


@query(with_(RECORDS["docs"], select="SELECT country, source, count(*) AS n, count(DISTINCT lower(name)) AS names FROM rec GROUP BY ALL"))
def partition_counts(spark, sf_dir):
    return _records(spark, sf_dir, "docs").groupBy("country", "source").agg(F.count("*").alias("n"), F.count_distinct(F.lower("name")).alias("names"))


_SIZES = "sized AS (SELECT s.s1, s.country, CAST(CASE WHEN matches = '' THEN 0 ELSE length(matches) - length(replace(matches, ',', '')) + 1 END AS BIGINT) AS n FROM spine s JOIN mlist USING (s1))"
_RESULTS = (*_PRODUCTION, _P, _OWN, _LISTS, _SIZES)


def _sizes(spark, sf_dir):
    spine, matches, _ = _lists(spark, sf_dir)
    return spine.join(matches, "s1").withColumn("n", audit.list_size(F.col("matches")))


@query(
    with_(*_RESULTS, select="SELECT country, count(*) AS records, CAST(sum(n) AS BIGINT) AS matches, count(*) FILTER (n = 0) AS empty, round(100.0 * count(*) FILTER (n = 0) / count(*), 2) AS empty_pct, round(avg(n) FILTER (n > 0), 4) AS mean_matched FROM sized GROUP BY country")
)
def country_summary(spark, sf_dir):
    return audit.country_summary(_sizes(spark, sf_dir))


@query(with_(*_RESULTS, select="SELECT n, count(*) AS records, round(100.0 * count(*) / (SELECT count(*) FROM sized), 4) AS pct FROM sized GROUP BY n"))
def match_count_histogram(spark, sf_dir):
    return audit.match_histogram(_sizes(spark, sf_dir))


@query(
    with_(
        *_RESULTS, "binned AS (SELECT sized.*, CASE WHEN length(name) < 15 THEN 'short' WHEN length(name) < 30 THEN 'medium' ELSE 'long' END AS grp FROM sized JOIN rec ON s1 = entity_id)",
        select="SELECT grp, count(*) AS records, round(avg(n), 6) AS mean, median(n) AS median, round(avg(CAST(n = 0 AS DOUBLE)), 6) AS share_zero FROM binned GROUP BY grp",
    )
)
def length_bin_stats(spark, sf_dir):
    names = _records(spark, sf_dir).where("source = 1").select(F.col("entity_id").alias("s1"), audit.length_bin(F.col("name"), 15, 30).alias("grp"))
    return audit.match_statistics(_sizes(spark, sf_dir).join(names, "s1"), "grp")


@query(
    with_(
        RECORDS["parts"], TRUTH["parts"],
        "n AS (SELECT TRY_CAST(regexp_replace(s1, '^S[0-9]-', '') AS BIGINT) AS a, TRY_CAST(regexp_replace(cand, '^S[0-9]-', '') AS BIGINT) AS b FROM truth), d AS (SELECT *, abs(a - b) AS d FROM n)",
        select="SELECT count(*) AS pairs, CASE WHEN isnan(corr(a, b)) THEN NULL ELSE round(corr(a, b), 6) END AS correlation, round(avg(d), 6) AS mean_distance, round(avg(d / greatest(a, 1)), 6) AS mean_ratio, round(stddev_samp(d), 6) AS sd_distance, "
        + ", ".join(f"round(quantile_cont(d, {s}), 6) AS q{int(s * 100):02d}" for s in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) + " FROM d",
    )
)
def id_correlation(spark, sf_dir):
    return audit.id_leakage(true_pairs(_records(spark, sf_dir), "parts"))


@query(
    with_(
        RECORDS["parts"], NORM, TRUTH["parts"],
        "m AS (SELECT s.name AS s_name, p.name AS c_name, s.addr AS s_addr, p.addr AS c_addr, s.n_norm AS sn, p.n_norm AS cn, s.a_norm AS sa, p.a_norm AS ca, s.nums AS su, p.nums AS cu FROM truth t JOIN norm s ON t.s1 = s.entity_id JOIN norm p ON t.cand = p.entity_id)",
        select="""SELECT count(*) AS pairs, round(avg(CAST(s_name = c_name AND s_name <> '' AS DOUBLE)), 6) AS raw_name, round(avg(CAST(s_addr = c_addr AND s_addr <> '' AS DOUBLE)), 6) AS raw_addr,
  round(avg(CAST(sn = cn AND sn <> '' AS DOUBLE)), 6) AS clean_name, round(avg(CAST(sa = ca AND sa <> '' AS DOUBLE)), 6) AS clean_addr,
  round(avg(CAST(list_sort(string_split(sn, ' ')) = list_sort(string_split(cn, ' ')) AND sn <> '' AS DOUBLE)), 6) AS sorted_name,
  round(avg(CAST(list_sort(string_split(sa, ' ')) = list_sort(string_split(ca, ' ')) AND sa <> '' AS DOUBLE)), 6) AS sorted_addr,
  round(avg(CAST(sn = cn AND sn <> '' AND sa = ca AND sa <> '' AS DOUBLE)), 6) AS clean_both, round(avg(CAST(len(list_intersect(su, cu)) > 0 AS DOUBLE)), 6) AS number_overlap FROM m""",
    )
)
def exact_match_rates(spark, sf_dir):
    pairs = features.paired(true_pairs(_records(spark, sf_dir), "parts"), _norm(spark, sf_dir), ["name", "addr", "n_norm", "a_norm", "nums"])
    return audit.exact_match_rates(pairs)


@query("SELECT count(*) AS rows, count(*) FILTER (text IS NOT NULL AND length(trim(text)) > 0) AS with_text, count(DISTINCT lang) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents")
def source_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.agg(F.count("*").alias("rows"), F.count_if(F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)).alias("with_text"), F.count_distinct("lang").alias("langs"), F.sum("n_chars").alias("chars"))


@query(with_(RECORDS["parts"], CANON, TRUTH["parts"], "m AS (SELECT s.canon_name AS sn, p.canon_name AS cn, s.canon_addr AS sa, p.canon_addr AS ca FROM truth t JOIN canon s ON t.s1 = s.entity_id JOIN canon p ON t.cand = p.entity_id)",
  select="SELECT count(*) AS pairs, round(avg(CAST(sn = cn AND sn <> '' AS DOUBLE)), 6) AS name, round(avg(CAST(sa = ca AND sa <> '' AS DOUBLE)), 6) AS addr, round(avg(CAST(sn = cn AND sn <> '' AND sa = ca AND sa <> '' AS DOUBLE)), 6) AS \"both\" FROM m"))
def canonical_match_rates(spark, sf_dir):
    return audit.canonical_match_rates(features.paired(true_pairs(_records(spark, sf_dir), "parts"), _canon(spark, sf_dir), ["canon_name", "canon_addr"]))


@query(with_(RECORDS["parts"], NORM, TRUTH["parts"], select="SELECT t.s1, t.cand, s.a_norm AS s_a_norm, p.a_norm AS c_a_norm FROM truth t JOIN norm s ON t.s1 = s.entity_id JOIN norm p ON t.cand = p.entity_id WHERE s.a_norm <> p.a_norm ORDER BY t.s1, t.cand LIMIT 10"))
def mismatching_pairs(spark, sf_dir):
    """A report of ten: true pairs whose normalised addresses differ."""
    pairs = features.paired(true_pairs(_records(spark, sf_dir), "parts"), _norm(spark, sf_dir), ["a_norm"])
    return audit.mismatches(pairs, "a_norm").select("s1", "cand", "s_a_norm", "c_a_norm")


@query(
    with_(
        RECORDS["parts"], TRUTH["parts"],
        "placed AS (SELECT entity_id, source, row_number() OVER (PARTITION BY source ORDER BY CAST(substring(entity_id, 4) AS BIGINT)) AS p FROM rec)",
        "j AS (SELECT a.p AS p1, coalesce(b.p, c.p) AS p FROM truth t JOIN placed a ON t.s1 = a.entity_id LEFT JOIN (SELECT * FROM placed WHERE source = 2) b ON t.cand = b.entity_id LEFT JOIN (SELECT * FROM placed WHERE source = 3) c ON t.cand = c.entity_id)",
        select="SELECT count(*) AS pairs, CASE WHEN isnan(corr(p1, p)) THEN NULL ELSE round(corr(p1, p), 6) END AS correlation, round(avg(abs(p1 - p)), 6) AS mean_distance FROM j WHERE p IS NOT NULL",
    )
)
def position_correlation(spark, sf_dir):
    records = _records(spark, sf_dir)
    return audit.position_leakage(records, true_pairs(records, "parts"))


@query(with_(RECORDS["docs"], select=f"SELECT entity_id FROM rec WHERE source = 1 AND {_bucket('entity_id', 42)} < 1500 AND {_bucket('entity_id', 43)} < 5000"))
def holdout_subsample(spark, sf_dir):
    """A sampling operator: half of the hold-out."""
    return splits.holdout_part(_records(spark, sf_dir, "docs").where("source = 1"), "entity_id", 0.15, 0.5).select("entity_id")


_TARGETS = "tgt AS (SELECT * FROM rec WHERE source <> 1 AND entity_id IN (SELECT cand FROM truth)), oth AS (SELECT * FROM rec WHERE source <> 1 AND entity_id NOT IN (SELECT cand FROM truth))"


def _targets(spark, sf_dir):
    records = _records(spark, sf_dir)
    pool = records.where("source <> 1")
    return pool.join(true_pairs(records, "parts").select(F.col("cand").alias("entity_id")), "entity_id", "left_semi"), pool


@query(with_(RECORDS["parts"], TRUTH["parts"], _TARGETS, select="SELECT entity_id, name FROM tgt UNION ALL SELECT entity_id, name FROM (SELECT * FROM oth ORDER BY md5('7:' || entity_id), entity_id LIMIT 100)"))
def targets_with_distractors(spark, sf_dir):
    """A sampling operator: all targets and a hundred other records."""
    targets, pool = _targets(spark, sf_dir)
    return splits.with_distractors(targets, pool, "entity_id", 100, 7).select("entity_id", "name")


@query(with_(RECORDS["parts"], TRUTH["parts"], _TARGETS, select="SELECT entity_id, name FROM (SELECT *, 1 AS o FROM tgt UNION ALL SELECT *, 2 FROM oth) ORDER BY o, entity_id LIMIT 150"))
def limit_over_union(spark, sf_dir):
    """A limit that binds to the whole of a union."""
    targets, pool = _targets(spark, sf_dir)
    return splits.limited_union(targets, pool.join(targets.select("entity_id"), "entity_id", "left_anti"), "entity_id", 150).select("entity_id", "name")


@query(with_(RECORDS["docs"], select="SELECT entity_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(addr, ''), '\\b[0-9]+\\b'))), ' ') AS numbers FROM rec"))
def raw_number_sets(spark, sf_dir):
    return _records(spark, sf_dir, "docs").select("entity_id", F.array_join(F.sort_array(text.raw_numbers(F.col("addr"))), " ").alias("numbers"))


@query(with_(RECORDS["parts"], select="SELECT country, count(*) AS records, count(DISTINCT name) AS names FROM rec WHERE source <> 1 GROUP BY country"))
def registered_sql(spark, sf_dir):
    """SQL over a frame registered as a table."""
    tables.register(_records(spark, sf_dir), "linkage_records")
    return spark.sql("SELECT country, count(*) AS records, count(DISTINCT name) AS names FROM linkage_records WHERE source <> 1 GROUP BY country")


_GROUPS = """flagged AS (SELECT sized.n, country, trim(coalesce(rec.addr, '')) = '' AS missing, regexp_matches(coalesce(rec.addr, ''), '[0-9]') AS digits, length(coalesce(rec.addr, '')) AS len FROM sized JOIN rec USING (country) WHERE s1 = entity_id),
grouped AS (SELECT 'country' AS kind, country AS grp, n FROM flagged UNION ALL SELECT 'missing', CAST(missing AS VARCHAR), n FROM flagged UNION ALL SELECT 'digits', CAST(digits AS VARCHAR), n FROM flagged
  UNION ALL SELECT 'length', CASE WHEN len < 20 THEN 'short' WHEN len < 50 THEN 'medium' ELSE 'long' END, n FROM flagged)"""


@query(with_(*_RESULTS, _GROUPS, select="SELECT kind, grp, count(*) AS records, round(avg(n), 6) AS mean, median(n) AS median, round(avg(CAST(n = 0 AS DOUBLE)), 6) AS share_zero FROM grouped GROUP BY kind, grp"))
def match_statistics_by_group(spark, sf_dir):
    """Matches by country, by missing address, by digits in it and by its length, in one aggregate."""
    missing, digits = audit.address_flags(F.col("addr"))
    kinds = {"country": F.col("country"), "missing": missing.cast("string"), "digits": digits.cast("string"), "length": audit.length_bin(F.col("addr"), 20, 50)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("grp")) for k, v in kinds.items()])).alias("g")
    groups = _records(spark, sf_dir).where("source = 1").select(F.col("entity_id").alias("s1"), each).select("s1", "g.kind", F.struct("g.kind", "g.grp").alias("by"))
    found = audit.match_statistics(_sizes(spark, sf_dir).join(groups, "s1"), "by")
    return found.select("grp.kind", "grp.grp", "records", "mean", "median", "share_zero")


# --- models ---------------------------------------------------------------------------------------------------------


#: The queries train with fewer rounds than production.
FEWER_ROUNDS = {"rounds": 40, "depth": 5, "rate": 0.1, "least": 5}


@query()
def model_scores(spark, sf_dir):
    records = _records(spark, sf_dir)
    fitted = linkage.train(records, true_pairs(records, "parts"), FEWER_ROUNDS)
    matches, _ = linkage.infer(records, fitted, threshold=0.5)
    return matches


@query()
def blended_scores(spark, sf_dir):
    records = _records(spark, sf_dir)
    rows = tables.kept(linkage.training_pairs(records, true_pairs(records, "parts")), "pairs")
    alike = tables.kept(model.gathered(rows, features.PRODUCTION), "alike")
    trees, forest = model.fit_trees(alike, features.PRODUCTION, **FEWER_ROUNDS), model.fit_forest(alike, features.PRODUCTION)
    tables.discard(alike)
    both = model.scores(forest, model.scores(trees, rows, "p_trees"), "p_forest")
    return model.blend(both, "p_trees", "p_forest").select("s1", "cand", "label", "p_trees", "p_forest", "p")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked end to end: normalise, block, rank, assign owners, list."""
    records = ADAPTERS["docs"](spark, sf_dir)
    cands = blocking.candidates(keys.production_keys(text.normalised(records), phonetic=False))
    matches = decide.exclusive(cands.select("s1", "cand", (F.col("blk") / FULL).alias("p")), 0.3)
    return decide.lists(linkage.spine(records), matches, "matches")
