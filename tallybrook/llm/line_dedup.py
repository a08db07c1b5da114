"""Operator 5: deletes later copies of repeated runs of lines. DataFrame functions only.

Lines that occur once in the corpus end every run, so only stretches of repeated lines with enough words
are kept. Their line ids form the sequences of a suffix array, sorted by distributed prefix
doubling: each round ranks every suffix by its rank so far and that of the suffix as many lines
further on. Ranks are counts of smaller suffixes; they come from the distinct pairs of ranks, which are
pre-aggregated, so a frequent line is one row by then, and what follows it is ranked in ranges. A run of ``words`` words
has at most so many lines, so rounds stop when ranks cover that depth, on any input.

For each line the shortest run of enough words that begins there, and the shortest that ends
there, is an interval of the suffix array: the suffixes whose longest common prefix has that many lines or more. Two ranks, of the
run's first and of its last lines, name it. In each interval the first place stays and the others are later copies. A line
is deleted if a later copy reaches it; where they overlap or touch, they make one maximal repeated run.

All of this is sums and windows over the lines of a stretch, so time grows with the lines, not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import SPACE, documents, saved, with_row_id

#: Words from which on a repeated run is deleted.
LEAST_WORDS = 50
#: Ranges of line ids, which are hashes, and of ranks that are summed apart.
RANGES = 1024


def _levels(words: int) -> int:
    return max(1, (max(1, words) - 1).bit_length())


def lines_of(docs: DataFrame) -> DataFrame:
    """row, doc_id, place (among the lines with words), line, the line's id in two halves, and n, its words."""
    content = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("content"), i.alias("line")))
    filled = F.filter(content, lambda x: x["content"].rlike(r"[^\x20\x09-\x0D]"))
    lines = docs.select("row", "doc_id", F.posexplode(filled).alias("place", "x"))
    return lines.select(
        "row", "doc_id", "place", "x.line", F.xxhash64("x.content").alias("h1"), F.xxhash64(F.lit(1), "x.content").alias("h2"),
        F.size(F.array_remove(F.split("x.content", f"{SPACE}+"), "")).alias("n"),
    )


def repeated_stretches(lines: DataFrame, words: int) -> DataFrame:
    """The lines that occur again, in stretches (numbered within a row) of `words` words or more.

    place numbers the lines of a stretch from 0, begin is the number of words before a line, and total that of the stretch."""
    often = saved(lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2"), "repeated-lines")
    kept = lines.join(often, ["h1", "h2"], "left_semi")
    kept = kept.withColumn("stretch", F.col("place") - F.row_number().over(Window.partitionBy("row").orderBy("place")))
    whole = Window.partitionBy("row", "stretch")
    ordered = whole.orderBy("place")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumns({"total": F.sum("n").over(whole), "begin": F.sum("n").over(upto) - F.col("n"), "place": F.row_number().over(ordered) - 1})
    return kept.where(F.col("total") >= words)


def _smaller(cells: DataFrame, keys: list[str], by: list[str], bucket: Column) -> DataFrame:
    """Adds `less`, the sum of c of the cells of the same keys that are smaller in `by`. Buckets, which rise with `by`, are
    summed apart, so a key with many cells is not one group."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cells = saved(cells.withColumn("bucket", bucket), "cells")
    sums = cells.groupBy(*keys, "bucket").agg(F.sum("c").alias("t"))
    sums = sums.select(*keys, "bucket", F.coalesce(F.sum("t").over(before(Window.partitionBy(*keys).orderBy("bucket"))), F.lit(0)).alias("earlier"))
    within = F.coalesce(F.sum("c").over(before(Window.partitionBy(*keys, "bucket").orderBy(*by))), F.lit(0))
    return cells.withColumn("within", within).join(sums, [*keys, "bucket"]).withColumn("less", F.col("earlier") + F.col("within")).drop("bucket", "earlier", "within")


def suffix_ranks(suffixes: DataFrame, words: int) -> DataFrame:
    """Adds r0, r1, ...: each suffix's rank by its first 1, 2, 4, ... lines, in the order of line ids."""
    ids = suffixes.groupBy("h1", "h2").agg(F.count("*").alias("c")).withColumn("all", F.lit(0))
    first = _smaller(ids, ["all"], ["h1", "h2"], F.shiftright(F.col("h1"), 64 - RANGES.bit_length() + 1))
    first = saved(first.select("h1", "h2", (F.col("less") + 1).alias("r0")), "line-ids")
    ranked = saved(suffixes.join(first, ["h1", "h2"]).drop("h1", "h2"), "ranks")
    width = F.lit(max(1, -(-ranked.count() // RANGES)))
    stretch = Window.partitionBy("row", "stretch").orderBy("place")
    for k in range(_levels(words) - 1):
        ranked = ranked.withColumn("next", F.coalesce(F.lead(f"r{k}", 1 << k).over(stretch), F.lit(0)))
        ranked = saved(ranked, "ranks")
        pairs = ranked.groupBy(f"r{k}", "next").agg(F.count("*").alias("c"))
        pairs = _smaller(pairs, [f"r{k}"], ["next"], F.floor(F.col("next") / width))
        pairs = saved(pairs.select(f"r{k}", "next", (F.col(f"r{k}") + F.col("less")).alias(f"r{k + 1}")), "pairs")
        ranked = saved(ranked.join(pairs, [f"r{k}", "next"]).drop("next"), "ranks")
    return ranked


def shortest_runs(ranked: DataFrame, words: int) -> DataFrame:
    """row, doc_id, stretch, place and line of each shortest run's first line, m, its number of lines, and head and tail, the ranks of its
    first and its last lines, as many as the greatest power of two in m."""
    levels = range(_levels(words))
    whole = Window.partitionBy("row", "stretch")
    # the rank of the lines that end here
    ranked = ranked.withColumns({f"t{k}": F.lag(f"r{k}", (1 << k) - 1).over(whole.orderBy("place")) for k in levels} | {"end": F.col("begin") + F.col("n")})
    tails, starts = F.struct(*(f"t{k}" for k in levels)), F.struct("place", "line", *(f"r{k}" for k in levels))
    onward, back = whole.orderBy("begin").rangeBetween(0, words - 1), whole.orderBy("end").rangeBetween(-(words - 1), 0)
    level = lambda pick: F.coalesce(*(F.when(F.col("m") >= (1 << k), pick(k)) for k in reversed(levels)))
    own = ["row", "doc_id", "stretch"]
    ahead = ranked.withColumns({"m": F.count("*").over(onward), "last": F.last(tails).over(onward)}).where(F.col("total") - F.col("begin") >= words)
    ahead = ahead.select(*own, "place", "line", "m", level(lambda k: F.col(f"r{k}")).alias("head"), level(lambda k: F.col(f"last.t{k}")).alias("tail"))
    behind = ranked.withColumns({"m": F.count("*").over(back), "first": F.first(starts).over(back)}).where(F.col("end") >= words)
    behind = behind.select(*own, "first.place", "first.line", "m", level(lambda k: F.col(f"first.r{k}")).alias("head"), level(lambda k: F.col(f"t{k}")).alias("tail"))
    return ahead.union(behind)


def covered_lines(docs: DataFrame, words: int = LEAST_WORDS) -> DataFrame:
    """row, line, n and run of the lines that are in later copies of repeated runs; run numbers a row's maximal ones."""
    ranked = suffix_ranks(saved(repeated_stretches(saved(lines_of(docs), "lines"), words), "stretches"), words)
    where = F.struct("doc_id", "row", "line")
    runs = saved(shortest_runs(ranked, words), "runs")
    firsts = runs.groupBy("m", "head", "tail").agg(F.min(where).alias("first"), F.max(where).alias("final")).where("final > first")
    copies = runs.join(saved(firsts.drop("final"), "intervals"), ["m", "head", "tail"]).where(where > F.col("first"))
    reach = saved(copies.groupBy("row", "stretch", "place").agg((F.col("place") + F.max("m")).alias("reach")), "reach")
    ordered = Window.partitionBy("row", "stretch").orderBy("place")
    marked = ranked.select("row", "stretch", "place", "line", "n").join(reach, ["row", "stretch", "place"], "left")
    covered = marked.withColumn("upto", F.max("reach").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).where("upto > place")
    alone = F.coalesce(F.lag("place").over(ordered) != F.col("place") - 1, F.lit(True))
    in_row = Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return covered.withColumn("opens", alone.cast("int")).select("row", "line", "n", F.sum("opens").over(in_row).alias("run"))


def maximal_runs(docs: DataFrame, words: int = LEAST_WORDS) -> DataFrame:
    """row, run, first and last line, and n_words of each maximal run of later copies; `docs` has row from with_row_id()."""
    return covered_lines(docs, words).groupBy("row", "run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.sum("n").alias("n_words"))


def later_copies(docs: DataFrame, words: int = LEAST_WORDS) -> DataFrame:
    """row and gone, the sorted numbers of its lines that are in later copies of a repeated run."""
    return covered_lines(docs, words).groupBy("row").agg(F.array_sort(F.collect_list("line")).alias("gone"))


def dedup_lines(docs: DataFrame, words: int = LEAST_WORDS) -> DataFrame:
    """Every row of `docs`, which has to be a table scan, with the later copies' lines taken out of text.

    n_lines and n_removed_lines count the lines with words (they replace columns of these names), and
    n_chars, where there is one, is that of the new text. The copy with the smallest (doc_id, row, line)
    stays. Runs of fewer than `words` words stay, and so do blank lines, but a text of which no word is
    left becomes empty. A null text stays null and has no lines. Repeated rows are copies like any
    others. An empty table gives no rows.
    """
    own = docs.columns
    numbered = with_row_id(docs, "_row")
    gone = later_copies(numbered.select(F.col("_row").alias("row"), "doc_id", "text"), words).select(F.col("row").alias("_row"), F.col("gone").alias("_gone"))
    joined = numbered.join(gone, "_row", "left")
    with_words = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    parts = F.split("text", "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_gone"), lambda i: F.get(parts, i))
    joined = joined.withColumn("_new", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    text = F.when(F.col("_gone").isNull() | with_words(F.col("_new")), F.col("_new")).otherwise(F.lit(""))
    made = {
        "n_lines": F.coalesce(F.size(F.filter(parts, with_words)), F.lit(0)).cast("long"),
        "n_removed_lines": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        "text": text,
    } | ({"n_chars": F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in own else {})
    names = [*own, *(c for c in ("n_lines", "n_removed_lines") if c not in own)]
    return joined.select(*(made[c].alias(c) if c in made else F.col(c) for c in names))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed_lines", "text")
