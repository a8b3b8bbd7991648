import pytest
from pyspark.sql import functions as F

from tessera.functions import distance, lexicon, phonetic, text


def norm(spark, name, addr):
    df = spark.createDataFrame([(name, addr)], "name string, addr string")
    return text.normalised(df).first()


def test_golden_record(spark):
    r = norm(spark, "Walmart Supercenter Store #1234 (ID: 98765)", "1234 Main Street, Suite 500, Los Angeles, CA 90001")
    assert r["n_norm"] == "walmart supercenter store 1234"
    assert r["nums"] == ["1234", "500", "90001"]
    assert r["a_toks"][0] == "1234" and r["first_tok"] == "walmart"


@pytest.mark.parametrize("a, b", [("Galore Aluminium (India) Private Limited", "galore aluminium (india) private limited"), ("Lucky Barbershop", "Lücky-Barbershop"), ("Lucky Barbershop", "Lucky Barbershop Ltd"), ("Future Management Pvt Ltd", "Future Mgmt Private Limited")])
def test_variants_have_equal_tokens(spark, a, b):
    assert norm(spark, a, "")["n_toks"] == norm(spark, b, "")["n_toks"]


def test_numbers_lose_zeros_and_letters(spark):
    assert norm(spark, "x", "0017560 12a 5th 1234567 000 7")["nums"] == ["17560", "7"]


def test_nulls_and_empty_texts(spark):
    for name, addr in ((None, None), ("", "")):
        r = norm(spark, name, addr)
        assert (r["n_norm"], r["a_norm"], r["n_toks"], r["nums"], r["first_tok"]) == ("", "", [], [], "")


def test_inc_survives_as_a_token(spark):
    assert norm(spark, "Acme Inc", "")["n_toks"] == ["acme", "incorporated"]


def test_lexicon_sizes():
    assert (len(lexicon.ABBREVIATIONS), len(lexicon.STOPWORDS), len(lexicon.EXPANSIONS), len(lexicon.SUFFIXES)) == (121, 110, 154, 47)
    assert lexicon.ABBREVIATIONS["st"] == "street" and lexicon.EXPANSIONS["co"] == "colorado"


def test_canonical_forms(spark):
    df = spark.createDataFrame([("Services Inc", "12 0012 Main St, NY"), (None, None)], "name string, addr string")
    one, none = text.canonical(df).collect()
    assert one["canon_name"] == "inc services" and one["canon_addr"] == "12 | main new york street"
    assert none["canon_addr"] == "" and none["trigrams"] == []


def test_other_scripts_become_ascii(spark):
    out = spark.createDataFrame([("नमक é",), (None,)], "x string").select(text.to_ascii(F.col("x")).alias("y")).collect()
    assert out[0]["y"].isascii() and out[0]["y"].endswith(" e") and out[1]["y"] is None


@pytest.mark.parametrize("word, code", [("metaphone", "MTFN"), ("knight", "NT"), ("thumb", "0M"), ("which", "WX"), ("school", "SKL"), ("phone", "FN"), ("", "")])
def test_metaphone(word, code):
    assert phonetic.code(word) == code


def test_distances():
    assert distance.damerau_levenshtein("ca", "abc") == 2 and distance.damerau_levenshtein("", "ab") == 2
    assert round(distance.jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(distance.jaro_winkler("abcd", "abxy"), 4) == 0.6667
    assert distance.ratio("", "") == 100 and distance.ratio("abc", "") == 0 and distance.ratio("kitten", "sitting") == pytest.approx(61.538, abs=1e-3)
    assert distance.token_set_ratio("a b c", "a b") == 100 and distance.token_set_ratio("", "a") == 0
    assert distance.token_sort_ratio("b a", "a b") == 100 and distance.partial_ratio("bc", "abcd") == 100
    assert distance.common_substring_ratio("xabcy", "zabcw") == 60


def test_lcs_against_a_table():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert distance.lcs_length(a, b) == table[-1][-1]


def test_names_in_other_scripts_get_keys_and_find_their_copies(spark):
    from tessera.plans import linkage

    rows = [("S1-1", 1, "नमक भंडार", "12 मार्ग", "IN"), ("S2-1", 2, "नमक भंडार", "12 मार्ग", "IN"), ("S2-2", 2, "other firm", None, "IN"), ("S3-1", 3, "Ärzte", None, "DE"), ("S1-2", 1, "arzte", None, "DE")]
    df = spark.createDataFrame(rows, "entity_id string, source int, name string, addr string, country string")
    _, cands = linkage.production_candidates(df)
    assert sorted((r["s1"], r["cand"]) for r in cands.collect()) == [("S1-1", "S2-1"), ("S1-2", "S3-1")]
    _, found = linkage.cascade_candidates(df)
    assert ("S1-1", "S2-1") in [(r["s1"], r["cand"]) for r in found.collect()]


def test_damerau_against_a_full_table():
    import random

    def slow(a, b):
        """The published algorithm, with the whole table and no short cuts."""
        big, last = len(a) + len(b), {}
        d = {(-1, -1): big}
        for i in range(len(a) + 1):
            d[i, -1], d[i, 0] = big, i
        for j in range(len(b) + 1):
            d[-1, j], d[0, j] = big, j
        for i in range(1, len(a) + 1):
            row = 0
            for j in range(1, len(b) + 1):
                k, m = last.get(b[j - 1], 0), row
                cost = a[i - 1] != b[j - 1]
                row = row if cost else j
                d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
            last[a[i - 1]] = i
        return d[len(a), len(b)]

    rng = random.Random(4)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(10))) for _ in "ab")
        assert distance.damerau_levenshtein(a, b) == slow(a, b)


def test_other_measures_against_slow_versions():
    import random

    def subsequence(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    def ratio(a, b):
        return 200 * subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0

    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in "ab")
        assert distance.ratio(a, b) == pytest.approx(ratio(a, b))
        assert distance.token_sort_ratio(a, b) == pytest.approx(ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
        common = max((n for n in range(1, len(a) + 1) for i in range(len(a) - n + 1) if a[i : i + n] in b), default=0)
        assert distance.common_substring_ratio(a, b) == pytest.approx(200 * common / (len(a) + len(b)) if a and b else 0)
        short, long = sorted((a, b), key=len)
        windows = [long[max(0, k) : k + len(short)] for k in range(1 - len(short), len(long))] if short else []
        other = [short[max(0, k) : k + len(long)] for k in range(1 - len(long), len(short))] if short and len(a) == len(b) else []
        want = max([ratio(short, w) for w in windows] + [ratio(long, w) for w in other], default=0.0 if long else 100.0)
        assert distance.partial_ratio(a, b) == pytest.approx(want)


def test_damerau_of_many_pairs_equals_that_of_each():
    import random

    from tessera.functions import distance

    draw = random.Random(7)
    text_of = lambda letters, most: "".join(draw.choice(letters) for _ in range(draw.randint(0, most)))
    pairs = [(text_of(k, 9), text_of(k, 9)) for k in ("ab", "abc", "0123456789 ", "aé漢\U0001f600") for _ in range(1500)]
    pairs += [("x" * 100 + "ab", "ba" + "y" * 70), ("a", "b" * 64), ("", ""), ("", "a"), ("ca", "abc"), ("a\0b", "ab\0")]
    assert distance.damerau_similarities(pairs) == [distance.damerau_similarity(a, b) for a, b in pairs]
    assert distance.MANY["dl"](pairs) == [distance.MEASURES["dl"](a, b) for a, b in pairs]
