"""Personal data by weak supervision, in DataFrame functions only.

Candidates are base spans (e-mail, IP, card, phone), which always stay, and
looser finds (secrets, national phone numbers, social security numbers,
account numbers, spelled-out e-mail addresses).  Four labelers vote on each
candidate: a format regex, a gazetteer of words before it, the characters
around it, and the variety of its characters.  Expectation-maximisation over
the counts of vote patterns estimates the labelers' reliabilities; its
posteriors train the final span classifier (naive Bayes over kind, votes and
length), whose verdict adds spans to the base.

Pattern notes.  Offsets come from ``split`` and ``regexp_extract_all`` by one
pattern: pieces between the matches, and the matches.  Unbounded repeats are
possessive or cannot overlap what follows, and runs are entered at their
first character only, so matching is linear and needs no deep stack.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import text_or_empty, written

_LOCAL = "[A-Za-z0-9._%+-]"
#: kind: (pattern, text that any match contains).  Runs start after another character or where the last match ended.
BASE = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[ -]?[0-9])++", None),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
}
EXTRA = {
    "secret": r"(?i:passwd|password|pwd|secret|token|api[_-]?key|access[_-]?key)[\"' ]{0,2}[=:][\"' ]{0,2}[A-Za-z0-9_+/.-]{8,}+",
    "tel": r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mail": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{{1,63}}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{{1,63}}){{1,5}}",
}
#: What any match of EXTRA contains: an assignment (secret), a digit (tel, ssn, iban), or a spelled-out dot (mail).
EXTRA_NEEDS = r"[=:0-9]|\[dot\]|\(dot\)| dot "
KINDS = [*BASE, *EXTRA]
VOTES = ["v_format", "v_gazetteer", "v_context", "v_variety"]
#: Words before a span that speak for its kind.
GAZETTEER = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|master|amex|pay",
    "phone": "phone|tel|call|fax|mobile",
    "secret": "pass|pwd|secret|token|key",
    "tel": "phone|tel|call|fax|mobile",
    "ssn": "ssn|social|security",
    "iban": "iban|account|bank|konto",
    "mail": "mail|contact|write",
}
_BLOCK = 256
ROUNDS = 12


def _located(text: Column, pattern: str, needs: Column | None = None) -> Column:
    """array<struct<start, stop, hit>> of the matches, offsets in code points."""
    guard = (lambda c: c) if needs is None else (lambda c: F.when(needs, c))
    pieces, hits = guard(F.split(text, pattern, -1)), guard(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    pairs = F.zip_with(hits, pieces, lambda h, p: F.struct(F.length(p).cast("long").alias("gap"), F.length(h).cast("long").alias("len"), h.alias("hit")))
    pairs = F.filter(F.coalesce(pairs, F.expr("cast(array() as array<struct<gap:bigint,len:bigint,hit:string>>)")), lambda x: x["hit"].isNotNull())
    nothing = F.expr("cast(array() as array<struct<start:bigint,stop:bigint,hit:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + x["len"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["len"]).alias("stop"), x["hit"].alias("hit")))).alias("out"))

    def blocks(all_pairs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(all_pairs) / F.lit(_BLOCK)).cast("int") - 1))
        return F.transform(numbers, lambda b: F.aggregate(F.slice(all_pairs, b * _BLOCK + 1, F.lit(_BLOCK)), F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("out")), step))

    def placed(done: Column) -> Column:
        def shift(block: Column, b: Column) -> Column:
            before = F.aggregate(F.slice(done, F.lit(1), b), F.lit(0).cast("long"), lambda a, y: a + y["at"])
            return F.transform(block["out"], lambda s: F.struct((s["start"] + before).alias("start"), (s["stop"] + before).alias("stop"), s["hit"].alias("hit")))

        return F.flatten(F.transform(done, shift))

    # one-element arrays bind a value once, for use in several places
    found = F.transform(F.array(pairs), lambda x: F.when(F.size(x) > 0, F.transform(F.array(blocks(x)), placed)[0]))[0]
    return F.coalesce(found, nothing)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        x = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":

        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) < 4) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(hit, r"\."), small)
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(14, 19), _luhn(_digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def _ranked(found: Column, kind: str, rank: int) -> Column:
    valid = F.filter(found, lambda x: _valid(kind, x["hit"]))
    return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit(rank).alias("rank"), x["hit"].alias("hit")))


def _with_found(docs: DataFrame) -> DataFrame:
    """``docs`` (with a text column _t) plus _base and _extra, arrays of (start, stop, rank, hit)."""
    base = []
    for rank, (kind, (pattern, needs)) in enumerate(BASE.items()):
        col = f"_{kind}"
        docs = docs.withColumn(col, _located(F.col("_t"), pattern, F.col("_t").contains(needs) if needs else None))
        base.append(_ranked(F.col(col), kind, rank))
    docs = docs.withColumn("_base", F.concat(*base))
    pattern = "|".join(f"(?:{p})" for p in EXTRA.values())
    docs = docs.withColumn("_loose", _located(F.col("_t"), pattern, F.col("_t").rlike(EXTRA_NEEDS)))

    def named(x: Column) -> Column:
        rank = F.lit(None).cast("int")
        for kind, p in reversed(EXTRA.items()):
            rank = F.when(x["hit"].rlike("^(?:" + p + ")$"), F.lit(KINDS.index(kind))).otherwise(rank)
        value = F.when(rank == KINDS.index("secret"), F.regexp_extract(x["hit"], "[A-Za-z0-9_+/.-]+$", 0)).otherwise(x["hit"])
        return F.struct((x["stop"] - F.length(value)).alias("start"), x["stop"].alias("stop"), rank.alias("rank"), value.alias("hit"))

    docs = docs.withColumn("_named", F.transform("_loose", named))
    apart = lambda x: ~F.exists("_base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
    return docs.withColumn("_extra", F.filter("_named", lambda x: x["rank"].isNotNull() & apart(x)))


def _judged(text: Column, x: Column, base: bool) -> Column:
    """A candidate with the labelers' votes (1 for, -1 against, 0 abstains) and a length class."""
    before = F.lower(F.substring(text, F.greatest(F.lit(1).cast("long"), x["start"] - 23).cast("int"), F.least(F.lit(24).cast("long"), x["start"]).cast("int")))
    left, right = F.substring(before, -1, 1), F.substring(text, (x["stop"] + 1).cast("int"), F.lit(1))
    gazetteer = F.lit(0)
    for rank, kind in enumerate(KINDS):
        gazetteer = F.when((x["rank"] == rank) & before.rlike(GAZETTEER[kind]), F.lit(1)).otherwise(gazetteer)
    ssn, secret = KINDS.index("ssn"), KINDS.index("secret")
    sound = F.when(x["rank"] == ssn, ~x["hit"].rlike("^(?:000|666|9)")).when(x["rank"] == secret, x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]")).otherwise(F.lit(True))
    apart = (left == "") | left.rlike("[\\s\"'(=:,;>|\\[]")
    ended = (right == "") | right.rlike("[\\s\"').,;:!?<|\\]]")
    variety = F.size(F.array_distinct(F.split(F.lower(x["hit"]), "")))
    return F.struct(
        x["start"].alias("start"), x["stop"].alias("stop"), x["rank"].alias("rank"), F.lit(base).alias("base"),
        F.when(sound, 1).otherwise(-1).alias("v_format"), gazetteer.alias("v_gazetteer"), F.when(apart & ended, 1).otherwise(-1).alias("v_context"),
        F.when(variety >= 5, 1).when(variety <= 3, -1).otherwise(0).alias("v_variety"),
        F.least(F.lit(4), F.floor(F.length(x["hit"]) / 8).cast("int")).alias("size"),
    )


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``_candidates``: every base span and loose find with its votes."""
    found = _with_found(docs.withColumn("_t", text_or_empty(text_col)))
    judged = F.concat(F.transform("_base", lambda x: _judged(F.col("_t"), x, True)), F.transform("_extra", lambda x: _judged(F.col("_t"), x, False)))
    return found.withColumn("_candidates", judged).drop("_t", "_base", "_loose", "_named", "_extra", *(f"_{k}" for k in BASE))


def fit(found: DataFrame, rounds: int = ROUNDS) -> dict[str, dict[int, float]]:
    """Log-odds by feature and value ("bias" has one), learnt from all candidates.

    The patterns of kind, votes and size are few, so every round is an
    aggregate over a small table, however many candidates there are.  Without
    candidates all weights are zero.
    """
    one = found.select(F.explode("_candidates").alias("c")).select("c.rank", *(f"c.{v}" for v in VOTES), "c.size")
    patterns = written(one.groupBy("rank", *VOTES, "size").agg(F.count("*").alias("n")).coalesce(1), "vote_patterns")
    share, right = 0.7, {v: (0.8, 0.8) for v in VOTES}  # right: of votes for if private, of votes against if not

    def posterior() -> Column:
        odds = F.lit(math.log(share / (1 - share)))
        for v, (a, b) in right.items():
            odds += F.when(F.col(v) == 1, math.log(a / (1 - b))).when(F.col(v) == -1, math.log((1 - a) / b)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    for _ in range(rounds):
        q = patterns.withColumn("q", posterior())
        sums = [F.sum(F.col("n") * F.when(F.col(v) == vote, F.col("q") if y else 1 - F.col("q")).otherwise(0.0)).alias(f"{v}{vote}{y}") for v in VOTES for vote in (1, -1) for y in (1, 0)]
        r = q.agg(F.sum(F.col("n") * F.col("q")).alias("private"), F.sum("n").alias("n"), *sums).first()
        if not r["n"]:
            break
        bound = lambda x: min(0.99, max(0.55, x))  # noqa: E731  a labeler is better than chance
        share = min(0.99, max(0.01, (r["private"] + 1) / (r["n"] + 2)))
        right = {v: (bound((r[f"{v}11"] + 4) / (r[f"{v}11"] + r[f"{v}-11"] + 5)), bound((r[f"{v}-10"] + 4) / (r[f"{v}-10"] + r[f"{v}10"] + 5))) for v in VOTES}
    features = ["rank", *VOTES, "size"]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("value")) for f in features])).alias("f")
    counts = patterns.withColumn("q", posterior()).select("n", "q", each).groupBy("f.feature", "f.value").agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no")).collect()
    yes, no = (sum(r[k] for r in counts if r["feature"] == "rank") for k in ("yes", "no"))
    model: dict[str, dict[int, float]] = {"bias": {0: math.log((yes + 1) / (no + 1)) if counts else 0.0}}
    for f in features:
        model[f] = {r["value"]: math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2)) for r in counts if r["feature"] == f}
    return model


def _accepted(model: dict[str, dict[int, float]], x: Column) -> Column:
    odds = F.lit(model["bias"][0])
    for f, weights in model.items():
        if f != "bias":
            term = F.lit(0.0)
            for value, weight in sorted(weights.items()):
                term = F.when(x[f] == value, F.lit(weight)).otherwise(term)
            odds = odds + term
    return x["base"] | (odds >= 0)


def _kept(model: dict[str, dict[int, float]]) -> Column:
    """Accepted candidates as sorted (start, rank, stop, base)."""
    kept = F.filter("_candidates", lambda x: _accepted(model, x))
    return F.sort_array(F.transform(kept, lambda x: F.struct(x["start"], x["rank"], x["stop"], x["base"])))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and spans, a sorted array of (start, rank, stop, base).

    Offsets count code points, the stop excluded; ``rank`` indexes ``KINDS``.
    Null and empty texts have no span; repeated rows get equal results; an
    empty table gives an empty result; other columns are ignored.
    """
    found = written(candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).drop("text"), "pii_candidates")
    return found.select("doc_id", _kept(fit(found)).alias("spans"))


def merged(spans: Column) -> Column:
    """Sorted (start, rank, stop, base) as (start, rank, stop) without overlaps: spans that share a character are one, of the first one's kind."""

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["stop"]
        done = F.when(apart & (acc["rank"] >= 0), F.concat(acc["out"], F.array(F.struct(acc["start"], acc["rank"], acc["stop"])))).otherwise(acc["out"])
        return F.struct(
            F.when(apart, s["start"]).otherwise(acc["start"]).alias("start"), F.when(apart, s["rank"]).otherwise(acc["rank"]).alias("rank"),
            F.greatest(acc["stop"], s["stop"]).alias("stop"), done.alias("out"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("start"), F.lit(-1).alias("rank"), zero.alias("stop"), F.expr("cast(array() as array<struct<start:bigint,rank:int,stop:bigint>>)").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.when(acc["rank"] < 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["start"], acc["rank"], acc["stop"])))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; a null text stays null.

    Overlapping spans are replaced together, by the kind of the one that
    starts first: nothing of any span stays.  Rows and their candidates are
    written once, for fitting and for replacing.
    """
    found = written(candidates(docs.select(F.struct("*").alias("row"), text_or_empty(text_col).alias("text"))).drop("text"), "pii_rows")
    kinds, text = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), F.col(f"row.{text_col}").cast("string")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.array(gap, F.element_at(kinds, s["rank"] + 1))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    done = found.withColumn("_spans", merged(_kept(fit(found)))).withColumn("_cut", F.when(F.size("_spans") > 0, F.aggregate("_spans", start, step)))
    rest = F.substring(text, (F.col("_cut.at") + 1).cast("int"), F.length(text))
    clean = F.when(F.col("_cut").isNotNull(), F.concat(F.array_join("_cut.out", ""), rest)).otherwise(F.col(f"row.{text_col}"))
    return done.select(F.col("row").withField(text_col, clean).alias("row")).select("row.*")
