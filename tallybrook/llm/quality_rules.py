"""Operator 3: quality rules, with robust multivariate outliers. DataFrame functions only.

Each document gets counts over its whole text. Documents that pass the base rules are compared, as
vectors of transformed counts, with others of their language and source, by minimum-covariance-determinant
estimates: from three starts (medians and quartiles, the moments of clipped vectors, and those of their
directions) concentration steps go to the nearest three quarters again and again; the start with the least determinant
is followed until that falls no more. Documents beyond a Mahalanobis distance are rejected.

There are estimates of every language and source, every language, and all documents. Each is mixed with the
one above it, which counts as much as ``PRIOR_ROWS`` documents, so small groups have estimates too and no size
turns the method on or off; that of all documents is mixed with a fixed wide one.

Quantiles are those of fixed bins' counts, so they do not depend on the order in which parts are merged, and
estimates are rounded, so that the order of sums does not show either. All sums are pre-aggregated in the tasks, so a
source with a third of all rows is summed where its rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import SPACE, documents, lookup_join, saved, with_row_id

WINDOW = 5
LEAST_WORDS, REPEAT_PERCENT = 10, 20
#: Part of a group that an estimate rests on, and what its covariance is multiplied by for that (fixed
#: value: 0.75 / P(chi-square with 7 degrees < 0.75 quantile of that with 5)).
CORE, CONSISTENCY = 0.75, 1.41
#: Steps from each start before the best one is chosen, and by how much the determinant's logarithm has to fall for another.
STEPS, LEAST_FALL = 2, 1e-3
#: Documents that the estimate above a group's counts as.
PRIOR_ROWS = 50.0
#: Bins a unit of a vector's component, and bins for each doubling of a distance.
VALUE_BINS, DISTANCE_BINS = 1024, 32
#: Squared Mahalanobis distance beyond which a document is rejected: the 1 - 1e-4 quantile of chi-square with 5 degrees.
CUTOFF = 26.0
#: Added to the size of a text before a share of it is taken, so that short texts' shares, where a
#: few cases say little, are drawn to 0: 25 words, 25 lines, and 25 repeats of 10 words (two windows).
PRIOR = {"n_symbols": 25.0, "n_dup_lines": 25.0, "n_repeat_words": 250.0}
#: Squares of these are added to the variances: spreads smaller than these say nothing about quality. Those of
#: shares are the noise of counting: the root of a count varies by 1/2, so the root of a count over
#: n + 25 by at most 1 / (2 * 5), whatever the text's length; repeats count by tens.
FLOORS = (0.3, 0.5, 0.1, 0.1, 0.1)
DIMENSIONS = len(FLOORS)
#: Spreads of the fixed estimate that the one of all documents is mixed with.
WIDE = (2.0, 1.5, 0.5, 0.5, 0.5)
KEYS = ["level", "lang", "source"]
#: The places of a lower triangle, row by row.
TRIANGLE = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words within windows that occur twice or more, the first time included."""
    from_windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))
    )

    def covered(hashes: Column) -> Column:
        marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda m, i, x: F.coalesce(F.get(m, i)["h"] == x["h"], F.lit(False))
        repeated = let(marked, lambda m: F.filter(m, lambda x, i: same(m, i - 1, x) | same(m, i + 1, x)))
        places = F.array_sort(F.transform(repeated, lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    counted = let(from_windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(counted)


def base_counts(text: Column) -> Column:
    """A struct of the counts; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        F.array_remove(F.split(text, f"{SPACE}+"), ""),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("of_lines"),
            _repeated_words(w).alias("n_repeat_words"),
        ),
    )


def vector() -> list[Column]:
    """The counts as numbers of about normal spread. Mean word length is drawn to 5 in short texts,
    where it says little, and shares are drawn to 0."""
    n = F.col("n_words")
    share = lambda part, whole: F.sqrt(F.col(part) / (F.col(whole) + PRIOR[part]))
    return [F.log1p(n), (F.col("word_chars") + 250.0) / (n + 50.0), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]


def _distance() -> Column:
    """Squared Mahalanobis distance of x: whiten holds the rows of the covariance's inverse Cholesky factor."""
    place = {ij: n for n, ij in enumerate(TRIANGLE)}
    parts = [" + ".join(f"whiten[{place[i, j]}] * (x[{j}] - centre[{j}])" for j in range(i + 1)) for i in range(DIMENSIONS)]
    return F.expr(" + ".join(f"pow({part}, 2)" for part in parts))


def with_whitening(rows: DataFrame) -> DataFrame:
    """Adds whiten, the inverse Cholesky factor of cov, and logdet, both of lower triangles; one step at a time."""
    names, place = rows.columns, {ij: n for n, ij in enumerate(TRIANGLE)}
    less = lambda first, pairs: " - ".join([first, *(f"{x} * {y}" for x, y in pairs)])
    rest = lambda i, j: less(f"cov[{place[i, j]}]", [(f"l{i}_{k}", f"l{j}_{k}") for k in range(j)])
    inverse = lambda i, j: less("1" if i == j else "0", [(f"l{i}_{k}", f"w{k}_{j}") for k in range(j, i)])
    for j in range(DIMENSIONS):  # cov = l * l', a column at a time
        rows = rows.withColumn(f"l{j}_{j}", F.expr(f"sqrt(greatest({rest(j, j)}, 1e-6D))"))
        rows = rows.withColumns({f"l{i}_{j}": F.expr(f"({rest(i, j)}) / l{j}_{j}") for i in range(j + 1, DIMENSIONS)})
    for i in range(DIMENSIONS):  # w = l inverted, a row at a time
        rows = rows.withColumns({f"w{i}_{j}": F.expr(f"({inverse(i, j)}) / l{i}_{i}") for j in range(i + 1)})
    logdet = " + ".join(f"2 * ln(l{i}_{i})" for i in range(DIMENSIONS))
    return rows.select(*names, F.expr(f"array({', '.join(f'round(w{i}_{j}, 9)' for i, j in TRIANGLE)})").alias("whiten"), F.expr(f"round({logdet}, 9)").alias("logdet"))


def _estimates(rows: DataFrame, keys: list[str], vector: Column) -> DataFrame:
    """keys, centre, cov, whiten and logdet of the vectors of each group."""
    sums = [f"sum(_v[{i}]) as s{i}" for i in range(DIMENSIONS)] + [f"sum(_v[{i}] * _v[{j}]) as s{i}_{j}" for i, j in TRIANGLE]
    sums = rows.withColumn("_v", vector).groupBy(*keys).agg(F.count("*").alias("s"), *map(F.expr, sums))
    spread = lambda i, j: f"s{i}_{j} / s - (s{i} / s) * (s{j} / s)"
    cov = [f"{CONSISTENCY} * greatest({spread(i, i)}, 0) + {FLOORS[i] ** 2}D" if i == j else f"{CONSISTENCY} * ({spread(i, j)})" for i, j in TRIANGLE]
    centre = [f"s{i} / s" for i in range(DIMENSIONS)]
    arrays = {name: F.expr(f"array({', '.join(f'round(double({x}), 9)' for x in values)})").alias(name) for name, values in (("centre", centre), ("cov", cov))}
    return with_whitening(sums.select(*keys, *arrays.values()))


def quantiles(binned: DataFrame, keys: list[str], parts: list[float]) -> DataFrame:
    """keys, total and p0, p1, ...: the least bin with each part of the group's n in it or below, of rows of keys, bin and n."""
    cells = Window.partitionBy(*keys)
    upto = binned.withColumns({"upto": F.sum("n").over(cells.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(cells)})
    return upto.groupBy(*keys).agg(F.max("total").alias("total"), *(F.min(F.when(F.col("upto") >= p * F.col("total"), F.col("bin"))).alias(f"p{i}") for i, p in enumerate(parts)))


def _starts(points: DataFrame) -> DataFrame:
    """Three starts of each group, by medians and quartiles, by the moments of clipped vectors and by those of directions."""
    bins = F.transform("x", lambda v: F.greatest(F.least(F.floor(v * VALUE_BINS), F.lit(1 << 24)), F.lit(-(1 << 24))))
    cells = points.select(*KEYS, F.posexplode(bins).alias("i", "bin")).groupBy(*KEYS, "i", "bin").agg(F.count("*").alias("n"))
    by_place = quantiles(cells, [*KEYS, "i"], [0.25, 0.5, 0.75])
    middle = lambda c: (F.col(c) + 0.5) / VALUE_BINS
    floors = F.array(*map(F.lit, FLOORS))
    scale = F.sqrt(F.pow((F.col("p2") - F.col("p0")) / (1.349 * VALUE_BINS), 2) + F.pow(F.get(floors, F.col("i")), 2))
    own = lambda c, i: F.max(F.when(F.col("i") == i, c))
    middles = by_place.withColumn("scale", scale).groupBy(*KEYS).agg(
        F.max("total").alias("n"), F.array(*(own(middle("p1"), i) for i in range(DIMENSIONS))).alias("centre"), F.array(*(own(F.col("scale"), i) for i in range(DIMENSIONS))).alias("scale")
    )
    middles = saved(middles, "middles")
    first = middles.select(*KEYS, F.lit(0).alias("start"), "centre", F.array(*(F.pow(F.get("scale", F.lit(i)), 2) if i == j else F.lit(0.0) for i, j in TRIANGLE)).alias("cov"))
    z = F.transform("x", lambda v, i: (v - F.get("centre", i)) / F.get("scale", i))
    size = F.sqrt(F.aggregate("z", F.lit(1e-12), lambda a, v: a + v * v))
    drawn = lambda how: F.transform("z", lambda v, i: F.get("centre", i) + F.get("scale", i) * how(v))
    clipped, direction = drawn(lambda v: F.greatest(F.least(v, F.lit(1.5)), F.lit(-1.5))), drawn(lambda v: v / size)
    both = lookup_join(points, middles.drop("n"), KEYS, "inner").withColumn("z", z)
    both = both.select(*KEYS, F.posexplode(F.array(clipped, direction)).alias("start", "y")).withColumn("start", F.col("start") + 1)
    found = with_whitening(first).unionByName(_estimates(both, [*KEYS, "start"], F.col("y")))
    return saved(found.join(middles.select(*KEYS, "n"), KEYS), "starts")


def _concentrated(points: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimates of the nearest CORE of each group's vectors, by each of its present estimates."""
    keys = [*KEYS, "start"]
    distance = F.floor(DISTANCE_BINS * F.log2(_distance() + 1e-6))
    near = lambda e: lookup_join(points, e, KEYS, "inner").withColumn("bin", distance)
    cells = near(estimates.select(*keys, "centre", "whiten")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    most = quantiles(cells, keys, [CORE]).select(*keys, F.col("p0").alias("most"))
    present = saved(estimates.join(most, keys).select(*keys, "n", "centre", "whiten", "most"), "core")
    found = _estimates(near(present.drop("n")).where("bin <= most").select(*keys, "x"), keys, F.col("x"))
    return saved(found.join(present.select(*keys, "n"), keys), "estimates")


def robust_estimates(points: DataFrame) -> DataFrame:
    """KEYS, n, centre, cov, whiten and logdet of each group of `points` (KEYS and x, an array)."""
    found = _starts(points)
    for _ in range(STEPS):
        found = _concentrated(points, found)
    best = Window.partitionBy(*KEYS).orderBy("logdet", "start")
    found = found.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
    found = saved(found.withColumn("open", F.lit(True)), "best")
    names = ["centre", "cov", "whiten", "logdet"]
    while not (still := found.where("open")).isEmpty():  # each round lowers determinants, which the floors bound
        then = _concentrated(points, still).select(*KEYS, *(F.col(c).alias(f"new_{c}") for c in names))
        joined = found.join(then, KEYS, "left").withColumn("falls", F.coalesce(F.col("new_logdet") < F.col("logdet") - LEAST_FALL, F.lit(False)))
        found = saved(joined.select(*KEYS, "start", "n", *(F.when(F.col("falls"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in names), F.col("falls").alias("open")), "best")
    return found.drop("open", "start")


def mixed_estimates(found: DataFrame) -> DataFrame:
    """lang, source, centre and whiten: each group's estimate mixed with that of its language, which is with that of all."""
    wide = F.array(*(F.lit(WIDE[i] ** 2 if i == j else 0.0) for i, j in TRIANGLE))
    above = found.where("level = 0").select(F.lit("").alias("lang"), F.lit("").alias("source"), F.col("centre").alias("up_centre"), wide.alias("up_cov"))
    for level, keys in enumerate((["lang", "source"], ["source"], ["lang"])):  # source is empty above the last level, and lang above them all
        own = found.where(F.col("level") == level).join(above if level == 0 else above.select(*keys, "up_centre", "up_cov"), keys)
        own = own.withColumn("w", F.col("n") / (F.col("n") + PRIOR_ROWS))
        mixed = lambda c, n: f"w * {c}[{n}] + (1 - w) * up_{c}[{n}]"
        gap = lambda i: f"(centre[{i}] - up_centre[{i}])"
        centre = F.expr(f"array({', '.join(mixed('centre', i) for i in range(DIMENSIONS))})")
        cov = F.expr(f"array({', '.join(f'{mixed("cov", n)} + w * (1 - w) * {gap(i)} * {gap(j)}' for n, (i, j) in enumerate(TRIANGLE))})")
        made = own.select("lang", "source", centre.alias("centre"), cov.alias("cov"))
        above = made.select("lang", "source", F.col("centre").alias("up_centre"), F.col("cov").alias("up_cov"))
    return with_whitening(made).select("lang", "source", "centre", "whiten")


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the base counts, base_failed, distance and kept, and `row`, for every row of `docs`.

    A null or empty text has no words and fails the base rules. Null languages and sources count as
    empty ones. Every document that passes the base rules has a distance. Repeated rows are judged each for itself, an empty table gives no
    rows. Only doc_id, text, lang and source are read. `row` numbers the rows as with_row_id() does.
    """
    keyed = with_row_id(docs, "row", ["doc_id", "text", "lang", "source"]).select("row", "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), base_counts(F.col("text")).alias("c"))
    counted = saved(keyed, "counts").select(
        "row", "doc_id", "lang", "source", "c.n_words", "c.word_chars", "c.n_symbols", "c.of_lines.n_lines", "c.of_lines.n_dup_lines", "c.n_repeat_words"
    )
    counted = counted.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).withColumn("x", F.array(*vector()))
    group = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"))
    groups = F.array(group(0, F.lit(""), F.lit("")), group(1, F.col("lang"), F.lit("")), group(2, F.col("lang"), F.col("source")))
    points = saved(counted.where(~F.col("base_failed")).select(F.explode(groups).alias("g"), "x").select("g.*", "x"), "points")
    estimates = saved(mixed_estimates(robust_estimates(points)), "estimates")
    judged = lookup_join(counted, estimates, ["lang", "source"])
    judged = judged.withColumn("distance", _distance())
    return judged.select(
        "row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("row")
