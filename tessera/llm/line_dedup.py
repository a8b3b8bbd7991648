"""Line deduplication over a suffix array of line sequences, in DataFrame functions only.

Every text is a sequence of line identifiers (128-bit content hashes).  Prefix
doubling ranks its suffixes: ranks at depth 1 order the lines by identifier,
and the ranks at depth 2h order the pairs (rank at a line, rank h lines on).
Suffixes of equal rank at depth h are an interval of the suffix array whose
longest common prefix is h lines or more.  A suffix alone in its interval
repeats nothing and takes no further part; doubling goes on until all are.

From ``min_lines`` on, every suffix keeps its deepest interval with an earlier
place, and that interval's first place.  A run that repeats between h and 2h
lines is covered by the two runs of depth h at its ends, so consecutive
suffixes whose first places advance with them join to one maximal run.  Later
copies of the maximal runs are deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import discard, text_or_empty, written

MIN_LINES, MIN_WORDS = 3, 10
_SPACE = r"[ \t\x0B\f\r]"


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.length(text), text)


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line: pos (its place), two hashes, and whether it has ``min_words`` words."""
    long = rf"^{_SPACE}*+" + (rf"(?:[^ \t\x0B\f\r]++{_SPACE}++){{{min_words - 1}}}[^ \t\x0B\f\r]" if min_words > 0 else "")
    one = docs.select("doc_id", _text_key(F.col("text")).alias("key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    place = F.struct("doc_id", "key", "line_no").alias("pos")
    return one.select(place, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.col("line").rlike(long).alias("long"))


def _ranked(members: DataFrame, by: list[str], name: str) -> DataFrame:
    """Members of the intervals of two or more: pos, rank (in order of ``by``) and the interval's first place.

    Intervals are summed up before they are joined back and are a table of
    their own, so one of any size may be split over tasks.  Ranks number the
    intervals in order, with gaps.
    """
    intervals = members.groupBy(*by).agg(F.min("pos").alias("first"), F.max("pos").alias("last")).where("first <> last").drop("last")
    ordered = written(intervals.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), f"{name}_intervals")
    # equal rows share a pos, once is enough
    out = written(members.join(ordered, by).drop(*by).distinct(), name)
    discard(ordered)
    return out


def _paired(ranks: DataFrame, away: int) -> DataFrame:
    """Places with their rank and the rank ``away`` lines on, where both are repeated."""
    on = F.struct("pos.doc_id", "pos.key", (F.col("pos.line_no") - away).alias("line_no"))
    return ranks.select("pos", F.col("rank").alias("r1")).join(ranks.select(on.alias("pos"), F.col("rank").alias("r2")), "pos")


def suffix_ranks(single: DataFrame, min_lines: int) -> list[tuple[int, DataFrame]]:
    """(depth, ranks) for ``min_lines`` and its doubles, until no run of the depth repeats; ``single`` ranks lines."""
    depth, ranks, out = 1, single, []
    while not ranks.isEmpty():
        if depth >= min_lines:
            out.append((depth, ranks))
        away = depth if depth >= min_lines else min(depth, min_lines - depth)
        pairs = written(_paired(ranks, away), f"pairs_{depth + away}")
        deeper = _ranked(pairs, ["r1", "r2"], f"ranks_{depth + away}")
        discard(pairs)
        if 1 < depth < min_lines:
            discard(ranks)
        depth, ranks = depth + away, deeper
    return out


def _maximal(later: DataFrame) -> DataFrame:
    """(doc_id, key, start, stop, source): maximal runs from (pos, first, depth) of suffixes with an earlier place.

    All windows are within a text.
    """
    text = Window.partitionBy("doc_id", "key")
    rows = later.select("pos.*", "first", "depth")
    deepest = rows.withColumn("_before", F.lag("line_no").over(text.orderBy("line_no", F.desc("depth")))).where("_before IS NULL OR _before <> line_no")
    before = F.lag(F.struct("line_no", "first")).over(text.orderBy("line_no"))
    step = F.struct(F.col("first.doc_id"), F.col("first.key"), (F.col("first.line_no") - 1).alias("line_no"))
    goes_on = (F.col("_b.line_no") == F.col("line_no") - 1) & (F.col("_b.first") == step)
    cut = F.when(goes_on, 0).otherwise(1)
    joined = deepest.withColumn("_b", before).withColumn("_run", F.sum(cut).over(text.orderBy("line_no")))
    runs = joined.groupBy("doc_id", "key", "_run").agg(F.min("line_no").alias("start"), F.max(F.col("line_no") + F.col("depth")).alias("stop"), F.min("first").alias("source"))
    reach = F.max("stop").over(text.orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("_reach", reach).where("_reach IS NULL OR stop > _reach").drop("_run", "_reach")


def _runs(single: DataFrame, min_lines: int) -> DataFrame:
    found = suffix_ranks(single, min_lines)
    parts = [ranks.where("first < pos").select("pos", "first", F.lit(depth).alias("depth")) for depth, ranks in found]
    if not parts:
        parts = [single.where("false").select("pos", "first", F.lit(0).alias("depth"))]
    runs = written(_maximal(reduce(DataFrame.unionByName, parts)), "maximal_runs")
    discard(*[ranks for depth, ranks in found if depth > 1])
    return runs


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, source_id, source_start): maximal runs of ``min_lines`` or more lines that have an earlier place.

    Lines count from 0.  The source is the first place of the run's deepest
    interval.  Runs may overlap, but none lies within another.  Repeated rows
    (equal identifier and text) are one text; nulls as in ``deduplicated``.
    """
    single = _ranked(_lines(_rows(docs, id_col, text_col), 0).drop("long"), ["h1", "h2"], "ranks_1")
    return _runs(single, min_lines).select("doc_id", "start", (F.col("stop") - F.col("start")).alias("length"), F.col("source.doc_id").alias("source_id"), F.col("source.line_no").alias("source_start"))


def _later_lines(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(doc_id, key, later): the numbers of the lines to delete, by text."""
    single = _ranked(_lines(docs, min_words), ["h1", "h2"], "ranks_1")
    of_runs = _runs(single, min_lines).select("doc_id", "key", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("line_no"))
    of_lines = single.where("long AND first < pos").select("pos.doc_id", "pos.key", "pos.line_no")
    return of_runs.unionByName(of_lines).groupBy("doc_id", "key").agg(F.collect_set("line_no").alias("later"))


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row (the input), text (what remains), n_lines, n_deleted.

    Later copies (by doc_id, then line number) of runs of ``min_lines`` or
    more lines, and of single lines of ``min_words`` or more words, go.  A
    text without any line left is empty.  Null and empty texts are one empty
    line.  Rows equal in identifier and text count as one text.  Null
    identifiers come first.  An empty table gives an empty result.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    later = _later_lines(rows.select("doc_id", "text"), min_lines, min_words).select(F.struct("doc_id", "key").alias("at"), "later")
    # always a sort-merge join: the plan, and so the need of disk, is the same at every size
    joined = rows.withColumn("at", F.struct("doc_id", _text_key(F.col("text")).alias("key"))).join(written(later, "later_lines").hint("merge"), "at", "left")
    n = F.size(F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("later"))
    lines = F.transform(F.array(F.split("text", "\n")), lambda all_lines: F.transform(left, lambda i: all_lines[i]))[0]
    clean = F.when(F.col("later").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return joined.select("row", clean.alias("text"), n.cast("long").alias("n_lines"), F.coalesce(F.size("later"), F.lit(0)).cast("long").alias("n_deleted"))


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without later copies of lines (see ``deduplicated``); a null text stays null."""
    done = deduplicated(docs, min_lines, min_words, id_col, text_col)
    text = F.when(F.col(f"row.{text_col}").isNotNull(), F.col("text"))
    return done.select(F.col("row").withField(text_col, text).alias("row")).select("row.*")
