"""SQL pieces, for DuckDB, from which the oracles of the catalogue are put together."""

from __future__ import annotations

from tessera.functions import lexicon


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, words)) + "]"


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in pairs.items()) + "}"


RECORDS = {
    "docs": """
rec AS (SELECT concat('S', 1 + doc_id % 3, '-', doc_id) AS entity_id, CAST(1 + doc_id % 3 AS INT) AS source,
  string_split(text, chr(10))[1] AS name, substring(text, CAST(length(string_split(text, chr(10))[1]) + 2 AS INT)) AS addr, lang AS country FROM documents)""",
    "parts": """
rec AS (SELECT concat('S', 1 + p_partkey % 3, '-', p_partkey) AS entity_id, CAST(1 + p_partkey % 3 AS INT) AS source,
  concat(p_name, ' ', p_type, ' Ltd') AS name, concat(p_size, ' ', p_brand, ' Rd ', 10000 + p_partkey % 50) AS addr, p_type AS country FROM part)""",
    "parties": """
rec AS (SELECT concat('S1-', c_custkey) AS entity_id, 1 AS source, c_name AS name, n_name AS addr, r_name AS country
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT concat('S2-', s_suppkey), 2, s_name, n_name, r_name
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
}

TRUTH = {
    "docs": "truth AS (SELECT a.entity_id AS s1, b.entity_id AS cand FROM rec a JOIN rec b ON a.country = b.country AND lower(a.name) = lower(b.name) WHERE a.source = 1 AND b.source <> 1)",
    "parts": "truth AS (SELECT a.entity_id AS s1, b.entity_id AS cand FROM rec a JOIN rec b ON a.country = b.country AND a.name = b.name AND string_split(a.addr, ' ')[2] = string_split(b.addr, ' ')[2] WHERE a.source = 1 AND b.source <> 1)",
}


def _plain(x: str) -> str:
    for letter, pair in lexicon.DOUBLE.items():
        x = f"replace({x}, '{letter}', '{pair}')"
    a, b = lexicon.latin()
    return f"lower(translate({x}, '{a}', '{b}'))"


_DOMAIN = r"(\.com|\.net|\.org|\.in|\.co|\.fr|\.io|\.biz|\.edu|\.info|www\.|https?://|@)"
_DOMAIN_WORD = r"\b(www\.)|\.(com|in|org|net|co|io|biz|info|fr|gov|edu|mil)\b"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[^a-z0-9]+'), lambda t: t <> '')"


def _mapped(x: str, table: dict[str, str]) -> str:
    return f"list_transform({x}, lambda t: coalesce({_map(table)}[t], t))"


def _zeros(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda n: regexp_replace(n, '^0+', '')), lambda n: length(n) BETWEEN 1 AND 6)"


#: n_norm, a_norm, n_toks, a_toks, first_tok and nums of ``rec``.
NORM = f"""
lowered AS (SELECT *, {_plain(f"regexp_replace(regexp_replace(coalesce(name, ''), '\\s*\\(ID:\\s*\\d+\\)\\s*$', '', 'i'), '{_DOMAIN}', ' ', 'gi')")} AS ln,
  {_plain(f"regexp_replace(coalesce(addr, ''), '{_DOMAIN}', ' ', 'gi')")} AS la FROM rec),
spelled AS (SELECT *, {_mapped(_words("ln"), lexicon.ABBREVIATIONS)} AS nx, {_mapped(_words("la"), lexicon.ABBREVIATIONS)} AS ax FROM lowered),
norm AS (SELECT entity_id, source, country, name, addr, array_to_string(nx, ' ') AS n_norm, array_to_string(ax, ' ') AS a_norm,
  list_filter(nx, lambda t: NOT list_contains({_list(lexicon.STOPWORDS)}, t)) AS n_toks,
  list_filter(ax, lambda t: NOT list_contains({_list(lexicon.STOPWORDS)}, t)) AS a_toks,
  coalesce(list_filter(nx, lambda t: NOT list_contains({_list(lexicon.STOPWORDS)}, t))[1], '') AS first_tok,
  {_zeros(chr(114) + "egexp_extract_all(la, '" + chr(92) + "b" + chr(92) + "d+" + chr(92) + "b')")} AS nums FROM spelled)"""

#: canon_name, core_toks, core_first, canon_addr, addr_nums, locality and trigrams of ``rec``.
CANON = f"""
cl AS (SELECT *, {_plain(f"regexp_replace(regexp_replace(coalesce(name, ''), '\\(id:\\s*\\d+\\)', ' ', 'gi'), '{_DOMAIN_WORD}', ' ', 'gi')")} AS ln,
  {_plain(f"regexp_replace(regexp_replace(coalesce(addr, ''), '\\(id:\\s*\\d+\\)', ' ', 'gi'), '{_DOMAIN_WORD}', ' ', 'gi')")} AS la FROM rec),
ce AS (SELECT *, {_mapped(_words("ln"), lexicon.EXPANSIONS)} AS nx, {_mapped(_words("la"), lexicon.EXPANSIONS)} AS ax FROM cl),
cc AS (SELECT *, list_filter(nx, lambda t: length(t) > 1 AND NOT list_contains({_list(lexicon.SUFFIXES)}, t)) AS strict FROM ce),
ck AS (SELECT *, CASE WHEN len(strict) > 0 THEN strict ELSE list_filter(nx, lambda t: length(t) > 1) END AS core_toks,
  list_sort(list_distinct({_zeros("list_filter(ax, lambda t: regexp_full_match(t, '[0-9]+'))")})) AS addr_nums,
  list_sort(list_distinct(list_filter(ax, lambda t: NOT regexp_full_match(t, '[0-9]+') AND length(t) > 1 AND NOT list_contains({_list(lexicon.SUFFIXES)}, t)))) AS locality FROM cc),
canon AS (SELECT entity_id, source, country, name, addr, core_toks, addr_nums, locality, coalesce(core_toks[1], '') AS core_first,
  array_to_string(list_sort(core_toks), ' ') AS canon_name,
  CASE WHEN len(ax) > 0 THEN concat(array_to_string(addr_nums, ' '), ' | ', array_to_string(locality, ' ')) ELSE '' END AS canon_addr,
  list_transform(range(1, greatest(1, length(array_to_string(core_toks, '')) - 1)), lambda i: substring(array_to_string(core_toks, ''), CAST(i AS INT), 3)) AS trigrams FROM ck)"""

#: Keys of the production generation without the phonetic one: (entity_id, source, country, kord, key, w).
KEYS = """
keyparts AS (SELECT entity_id, source, country, n_toks, nums, a_toks, coalesce(n_toks[1], '') AS t0, coalesce(n_toks[2], '') AS t1,
  array_to_string(list_sort(n_toks[1:3]), ' ') AS sig, coalesce(nums[1], '') AS num0, coalesce(a_toks[1], '') AS addr0,
  coalesce(list_filter(nums, lambda n: length(n) BETWEEN 5 AND 6)[1], '') AS code FROM norm),
keyed AS (
  SELECT entity_id, source, country, 1 AS kord, 'n1:' || t0 AS key, 5.0::DOUBLE AS w FROM keyparts WHERE length(t0) >= 2
  UNION ALL SELECT entity_id, source, country, 3, 'nb:' || t0 || '_' || t1, 5.0 FROM keyparts WHERE len(n_toks) >= 2 AND length(t1) >= 2
  UNION ALL SELECT entity_id, source, country, 4, 'nsort:' || sig, 4.0 FROM keyparts WHERE len(n_toks) >= 2 AND length(sig) >= 4
  UNION ALL SELECT entity_id, source, country, 5, 'na:' || num0 || '_' || addr0, 2.0 FROM keyparts WHERE num0 <> '' AND length(addr0) >= 3 AND addr0 <> num0
  UNION ALL SELECT entity_id, source, country, 6, 'pin:' || code, 3.0 FROM keyparts WHERE code <> '')"""

#: Keys of the cascade without the phonetic ones.
CASCADE_KEYS = """
keyed AS (
  SELECT entity_id, source, country, 1 AS kord, 'nsig:' || canon_name AS key, 10.0::DOUBLE AS w FROM canon WHERE canon_name <> ''
  UNION ALL SELECT entity_id, source, country, 2, 'tok:' || t, CASE WHEN t = core_first THEN 4.0 ELSE 2.5 END FROM (SELECT *, unnest(core_toks[1:6]) AS t FROM canon) WHERE length(t) >= 3
  UNION ALL SELECT entity_id, source, country, 4, 'num:' || n, 3.0 FROM (SELECT *, unnest(addr_nums) AS n FROM canon) WHERE length(n) >= 3
  UNION ALL SELECT entity_id, source, country, 5, 'tri:' || g, 0.5 FROM (SELECT *, unnest(trigrams[1:4]) AS g FROM canon))"""

_LEGACY = f"lambda t: NOT list_contains({_list(lexicon.LEGACY_STOPWORDS)}, t)"

#: Keys of the first experiments.
EXPERIMENT_KEYS = f"""
ex AS (SELECT *, list_filter({_words(_plain(f"regexp_replace(coalesce(name, ''), '{_DOMAIN}', ' ', 'gi')"))}, {_LEGACY}) AS n,
  list_filter({_words(_plain(f"regexp_replace(coalesce(addr, ''), '{_DOMAIN}', ' ', 'gi')"))}, {_LEGACY}) AS a,
  {_zeros(chr(114) + "egexp_extract_all(coalesce(addr, ''), '" + chr(92) + "b" + chr(92) + "d+" + chr(92) + "b')")} AS d FROM rec),
keyed AS (
  SELECT entity_id, source, country, 1 AS kord, 'n1:' || n[1] AS key, 5.0::DOUBLE AS w FROM ex WHERE length(n[1]) >= 2
  UNION ALL SELECT entity_id, source, country, 2, 'npref:' || substring(n[1], 1, 4), 3.0 FROM ex WHERE length(n[1]) >= 4
  UNION ALL SELECT entity_id, source, country, 3, 'n2:' || n[2], 3.0 FROM ex WHERE length(n[2]) >= 2
  UNION ALL SELECT entity_id, source, country, 4, 'nb:' || n[1] || '_' || n[2], 5.0 FROM ex WHERE length(n[2]) >= 2
  UNION ALL SELECT entity_id, source, country, 5, 'n3:' || n[3], 3.0 FROM ex WHERE length(n[3]) >= 3
  UNION SELECT entity_id, source, country, 6, 'na:' || x || '_' || y, 2.0 FROM
    (SELECT *, unnest(a[1:4]) AS y FROM (SELECT DISTINCT * FROM (SELECT entity_id, source, country, a, d, unnest(dd) AS x FROM
      (SELECT *, list_transform(list_filter(range(1, len(d) + 1), lambda i: list_position(d, d[i]) = i)[1:3], lambda i: d[i]) AS dd FROM ex)))) WHERE length(y) >= 3 AND x <> y
  UNION SELECT DISTINCT entity_id, source, country, 7, 'pin:' || x, 1.0 FROM (SELECT *, unnest(d) AS x FROM ex) WHERE length(x) BETWEEN 5 AND 6)"""

#: Keys weighted by kind, for scores by rarity.
IDF_KEYS = f"""
ir AS (SELECT *, {_words(_plain("coalesce(name, '')"))} AS n, regexp_replace({_plain("coalesce(addr, '')")}, '[^a-z0-9]+', ' ', 'g') AS l FROM rec),
keyed AS (SELECT DISTINCT * FROM (
  SELECT entity_id, source, country, 1 AS kord, 'n_' || t AS key, 3.0::DOUBLE AS w FROM (SELECT *, unnest(n) AS t FROM ir) WHERE length(t) >= 3 AND NOT list_contains({_list(lexicon.LEGACY_STOPWORDS)}, t)
  UNION ALL SELECT entity_id, source, country, 2, 'nb_' || n[1] || '_' || n[2], 3.0 FROM ir WHERE len(n) >= 2 AND NOT list_contains({_list(lexicon.LEGACY_STOPWORDS)}, n[1]) AND NOT list_contains({_list(lexicon.LEGACY_STOPWORDS)}, n[2])
  UNION ALL SELECT entity_id, source, country, 3, 'num_' || t, 1.5 FROM (SELECT *, unnest(regexp_extract_all(l, '\\b\\d{{2,6}}\\b')) AS t FROM ir)
  UNION ALL SELECT entity_id, source, country, 4, 'a_' || t, 1.0 FROM (SELECT *, unnest(string_split(l, ' ')) AS t FROM ir) WHERE length(t) >= 4 AND NOT list_contains({_list(lexicon.LEGACY_STOPWORDS)}, t)))"""


def scored(cap: int, never: str | None = None) -> str:
    """Frequencies, capped pool keys, pair scores (``pairs``)."""
    spare = f" OR starts_with(key, '{never}')" if never else ""
    return f"""
freq AS (SELECT country, key, count(*) AS df FROM keyed WHERE source <> 1 GROUP BY ALL),
poolkeys AS (SELECT k.*, df FROM keyed k JOIN freq USING (country, key) WHERE source <> 1 AND (df <= {cap}{spare})),
pairs AS (SELECT a.country, a.entity_id AS s1, b.entity_id AS cand, sum(a.w) AS blk, min(a.kord) AS min_kord
  FROM keyed a JOIN poolkeys b ON a.country = b.country AND a.key = b.key WHERE a.source = 1 GROUP BY ALL)"""


def idf_scored(cap: int, plus: float) -> str:
    return f"""
freq AS (SELECT country, key, count(*) AS df FROM keyed WHERE source <> 1 GROUP BY ALL),
poolkeys AS (SELECT k.*, df FROM keyed k JOIN freq USING (country, key) WHERE source <> 1 AND df <= {cap}),
total AS (SELECT count(*) AS n FROM rec WHERE source <> 1),
pairs AS (SELECT a.country, a.entity_id AS s1, b.entity_id AS cand,
    sum(CAST(round((ln((n + 1) / (df + 1)) + {plus}) * a.w, 9) AS DECIMAL(20,9))) AS blk, min(a.kord) AS min_kord
  FROM keyed a JOIN poolkeys b ON a.country = b.country AND a.key = b.key CROSS JOIN total WHERE a.source = 1 GROUP BY ALL)"""


def top(k: int) -> str:
    return f"cands AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY blk DESC, min_kord, cand) AS rnk FROM pairs) WHERE rnk <= {k})"


#: Totals over ``res`` (n_true, n_pred, tp, f).
TOTALS = """avg(f) AS macro_f05, CASE WHEN sum(n_pred) > 0 THEN sum(tp) / sum(n_pred) ELSE 0.0 END AS "precision",
  CASE WHEN sum(n_true) > 0 THEN sum(tp) / sum(n_true) ELSE 0.0 END AS recall, CAST(sum(tp) AS BIGINT) AS tp,
  CAST(sum(n_pred) - sum(tp) AS BIGINT) AS fp, CAST(sum(n_true) - sum(tp) AS BIGINT) AS fn,
  CASE WHEN count(*) FILTER (n_true = 0) > 0 THEN count(*) FILTER (n_true = 0 AND n_pred = 0) / count(*) FILTER (n_true = 0) ELSE 0.0 END AS singleton_accuracy,
  count(*) FILTER (n_true > 0 AND f > 0.5) AS well_matched"""

F_HALF = """CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN n_pred = 0 OR tp = 0 THEN 0.0::DOUBLE
  ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select.strip()
