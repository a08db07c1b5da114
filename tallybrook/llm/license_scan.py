"""Operator 1: licence scans of paragraphs. DataFrame functions only.

A multinomial logistic regression over word 1-, 2- and 3-grams tells licence families, licences of no listed family (`unknown`) and
other prose apart. It is trained on wordings of its own, with variants that have words left out. On the templates, other texts
by which the same licences announce themselves, and on prose held out of training, its temperature is fitted and two least probabilities
are set: one from which a paragraph is a licence, and one from which, if it is, its family is named. A named family is
confirmed if the paragraph has enough of the words of one of the family's templates, where words that few families use
weigh most; a licence that is not named, or not confirmed, is `unknown`.

A paragraph is a line, or a run of lines up to one without words, as wordings are wrapped. Long ones are read in
overlapping windows, so that a licence within them stands out. A run counts in place of its
lines where it confirms a heavier wording than they do; else they count and it does not.

Features without an anchor, a word that is much more frequent in some family's training wordings than in the prose, are left out of the
model, so a paragraph without an anchor has no feature and is no licence, and n-grams are made of the others only.
The weights are one small table of features, of at most ``FEATURES`` rows, whatever the corpus; it is fitted once a process.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import documents, saved, with_row_id
from tallybrook.llm.license_templates import FRAMES, NAMES, NOTICES, OTHER, TEMPLATES, UNLISTED, UNLISTED_NAMES

FEATURES = 8_000
GRAMS = 3
VARIANTS, ROUNDS = 3, 300
SEED = 1
CONFIRM = 0.8
NONE, UNKNOWN = "none", "unknown"
#: How many times as frequent in a family's wordings an anchor is, and anchors that a paragraph of several lines or a window has at least.
ANCHOR, LEAST_ANCHORS = 6.0, 3
#: Words of a window, and words from one to the next.
SPAN, STEP = 120, 60
#: Part of the held-out prose that may be taken for a licence, and of the unlisted licences that may be named a family.
FALSE, FALSE_NAMES = 0.005, 0.02
_WORD = re.compile("[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}


def _least(scores: np.ndarray, part: float) -> float:
    """Just above all but `part` of the scores, and a half at least: what is less likely than its opposite is not named."""
    ordered = np.sort(scores)
    return float(max(0.5, np.nextafter(ordered[min(len(ordered) - 1, int(np.ceil((1 - part) * len(ordered))))], 1)))


class Model:
    """Weights of the kept n-grams for each family, for `unknown` and for `none`, and the templates' words."""

    def __init__(self, seed: int = SEED):
        families = list(NOTICES)
        self.kinds = [*families, UNKNOWN, NONE]
        draw = np.random.default_rng(seed)
        fixed = {tuple(words_of(t)) for ts in TEMPLATES.values() for t in ts}
        made = [(words_of(f.format(n)), k) for k, names in enumerate([*(NAMES[f] for f in families), UNLISTED_NAMES]) for n in names for f in FRAMES]
        texts = [(words_of(t), k) for k, f in enumerate(families) for t in NOTICES[f]] + [(words_of(t), len(families)) for t in UNLISTED]
        prose = [(words_of(t), len(families) + 1) for t in OTHER]
        self.anchors = self._anchors(texts, prose) | self._anchors(made, prose)
        texts += [(w, k) for w, k in made if tuple(w) not in fixed]  # a template is no training text
        # one anchor among ordinary words is no licence
        anchors = sorted(self.anchors)
        loose = [([*w[:at], a, *w[at:]], k) for at in (2, 5, 9) for a, (w, k) in zip(anchors, [*prose[at::2], *prose[:at:2]] * len(anchors), strict=False)]
        train = texts + prose[::2] + loose
        train += [(self._variant(w, draw), k) for w, k in texts + prose[::2] for _ in range(VARIANTS)]
        seen = Counter(g for w, _ in train for g in grams_of(w) if self.anchors & set(g.split()))
        self.grams = [g for g, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:FEATURES]]
        self.weights, self.bias = self._fit(train)
        # thresholds are set on texts that it was not trained on: templates, the other prose, variants of both
        check = [(words_of(t), k) for k, f in enumerate(families) for t in TEMPLATES[f]] + prose[1::2]
        check += [(self._variant(w, draw), k) for w, k in check for _ in range(VARIANTS)]
        apart = [([*w[:at], a, *w[at:]], k) for at in (3, 7) for a, (w, k) in zip(anchors, [*prose[at::2], *prose[1:at:2]] * len(anchors), strict=False)]
        check += apart + [([*w[:4], w[-1], w[-1], *w[4:]], k) for w, k in apart]
        unnamed = [(self._variant(words_of(t), draw), len(families)) for t in UNLISTED for _ in range(VARIANTS)]
        self._calibrate([w for w, _ in check], np.asarray([k for _, k in check]), [w for w, _ in unnamed])
        self._template_words(TEMPLATES)

    @staticmethod
    def _anchors(texts: list[tuple[list[str], int]], prose: list[tuple[list[str], int]]) -> set[str]:
        """Words that two or more of a family's texts have, and that are ANCHOR times as usual in them as in prose."""
        usual, found = Counter(w for words, _ in prose for w in set(words)), set()
        for kind in {k for _, k in texts}:
            own = [set(words) for words, k in texts if k == kind]
            for w, c in Counter(w for words in own for w in words).items():
                if c > 1 and (c + 0.5) / (len(own) + 1) >= ANCHOR * (usual[w] + 0.5) / (len(prose) + 1) and not w.isdigit() and len(w) > 1:
                    found.add(w)
        return found

    @staticmethod
    def _variant(words: list[str], draw: np.random.Generator) -> list[str]:
        kept = [w for w in words if draw.random() > 0.1] or words
        return kept if draw.random() < 0.5 else [*(f"x{draw.integers(1000)}" for _ in range(draw.integers(1, 6))), *kept]

    def _matrix(self, texts: list[list[str]]) -> np.ndarray:
        at = {g: i for i, g in enumerate(self.grams)}
        x = np.zeros((len(texts), len(at)), dtype=np.float32)
        for i, words in enumerate(texts):
            x[i, [at[g] for g in grams_of(words) if g in at]] = 1
        return x

    def _fit(self, rows: list[tuple[list[str], int]], rate: float = 0.5, penalty: float = 1e-4):
        x, y = self._matrix([w for w, _ in rows]), np.eye(len(self.kinds), dtype=np.float32)[[k for _, k in rows]]
        y_weight = np.sqrt(1 / np.maximum(y.sum(axis=0), 1))[y.argmax(axis=1)][:, None]  # small kinds count more
        y_weight = (y_weight / y_weight.mean()).astype(np.float32)
        weights, bias = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32), np.zeros(y.shape[1], dtype=np.float32)
        bias[-1] = 1.0
        for _ in range(ROUNDS):
            z = x @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            off = (p - y) * y_weight
            weights -= rate * (x.T @ off / len(x) * 20 + penalty * weights)
            bias -= rate * off.mean(axis=0)
        bias[-1] += max(0.0, 1 + float(bias[:-1].max() - bias[-1]))  # a text without features is no licence
        return weights.astype(np.float64), bias.astype(np.float64)

    def _calibrate(self, texts: list[list[str]], kinds: np.ndarray, unnamed: list[list[str]]) -> None:
        x = self._matrix(texts).astype(np.float64)
        z = x @ self.weights + self.bias

        def loss(t: float) -> float:
            top = z.max(axis=1)
            return float((np.log(np.exp((z - top[:, None]) / t).sum(axis=1)) + (top - z[np.arange(len(z)), kinds]) / t).mean())

        self.temperature = min(np.geomspace(0.25, 8, 41), key=loss)
        self.weights, self.bias = self.weights / self.temperature, self.bias / self.temperature
        p, q = self.probabilities(texts), self.probabilities(unnamed)
        none = kinds == len(self.kinds) - 1
        self.least_licence = _least(1 - p[none, -1], FALSE)
        self.least_named = _least(q[:, :-2].max(axis=1) / (1 - q[:, -1]), FALSE_NAMES)

    def _template_words(self, templates: dict[str, list[str]]) -> None:
        """Words of each template with their share of its weight; a word weighs more, the fewer families use it."""
        used = Counter(w for ts in templates.values() for w in {w for t in ts for w in words_of(t)})
        self.template_words, self.template_of = [], []
        for family, ts in templates.items():
            for t in ts:
                weight = {w: float(np.log1p(len(templates) / used[w])) for w in words_of(t)}
                self.template_words += [(w, len(self.template_of), family, v / sum(weight.values()), sum(weight.values())) for w, v in sorted(weight.items())]
                self.template_of.append(family)

    def probabilities(self, texts: list[list[str]]) -> np.ndarray:
        z = self._matrix(texts).astype(np.float64) @ self.weights + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    return Model()


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _slices(words: Column, n: int) -> Column:
    """The n-grams of words; none if there are fewer."""
    made = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))


def _windows(tagged: Column) -> Column:
    """Slices of SPAN items, each STEP after the last; all items are in one."""
    last = F.greatest(F.ceil((F.size(tagged) - SPAN) / F.lit(STEP)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tagged, i * STEP + 1, SPAN))


def paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """row, single, run, window, line, last, words of the paragraphs with enough anchors; no others can be licences. They are
    the lines from `line` to `last`: of single ones, or within a run of several; run is the first line of either, window the place in it."""
    split = lambda x: F.array_remove(F.split(F.lower(x), "[^a-z0-9]+"), "")
    anchors = _strings(sorted(model.anchors))
    held = F.size(F.array_intersect(split(F.col("text")), anchors))
    able = docs.select("row", "text", held.alias("held")).where("held > 0").select("row", "text", (F.col("held") >= LEAST_ANCHORS).alias("many"))
    lines = able.select("row", "many", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    lines = lines.select("row", "many", "line", split(F.col("content")).alias("words"))
    # of texts with too few anchors for a paragraph of several lines, only lines that have one are of use
    lines = saved(lines.where(F.col("many") | F.arrays_overlap("words", anchors)), "lines")
    gaps = F.sum((F.size("words") == 0).cast("int")).over(Window.partitionBy("row").orderBy("line"))
    with_words = lines.where("many").withColumn("run", gaps).where(F.size("words") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("line", "words")))
    runs = with_words.groupBy("row", "run").agg(F.min("line").alias("line"), F.max("line").alias("last"), ordered.alias("parts")).where("last > line")
    tagged = F.flatten(F.transform("parts", lambda x: F.transform(x["words"], lambda w: F.struct(x["line"].alias("line"), w.alias("word")))))
    single = lines.where(F.arrays_overlap("words", anchors))
    single = single.select("row", F.lit(True).alias("single"), F.col("line").alias("run"), F.transform("words", lambda w: F.struct(F.col("line"), w.alias("word"))).alias("tagged"))
    both = single.union(runs.select("row", F.lit(False), "line", tagged))
    cut = both.select("row", "single", "run", F.posexplode(_windows(F.col("tagged"))).alias("window", "x"))
    cut = cut.select("row", "single", "run", "window", F.get("x.line", F.lit(0)).alias("line"), F.element_at("x.line", -1).alias("last"), F.col("x.word").alias("words"))
    least = F.when(F.col("single"), 1).otherwise(LEAST_ANCHORS)
    return saved(cut.where(F.size(F.array_intersect("words", anchors)) >= least), "paragraphs")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """row, single, run, window, line, last, family, probability, similarity, covered and confirmed of the paragraphs that are licences.

    `docs` is a table scan with `row` from with_row_id(). A null or empty text has no paragraph. Family is
    `unknown` where no family reaches its least probability or none of its templates is like the paragraph; probability is
    that of the likeliest family, named or not, for unknown ones of a licence. covered: weight of the heaviest wording that is confirmed.
    """
    model = model or default_model()
    spark = docs.sparkSession
    found = paragraphs(docs, model)
    keys = ["row", "single", "run", "window", "line", "last"]
    columns = [f"w{k}" for k in range(len(model.kinds))]
    rows = [(g, *map(float, w)) for g, w in zip(model.grams, model.weights, strict=True)]
    weights = spark.createDataFrame(rows, "gram string, " + ", ".join(f"{c} double" for c in columns))
    slices = [_slices(F.col("words"), n) for n in range(1, GRAMS + 1)]
    grams = found.select(*keys, F.explode(F.array_distinct(F.concat(*slices))).alias("gram"))
    # the weights are at most FEATURES rows of a few dozen numbers
    sums = grams.join(F.broadcast(weights), "gram").groupBy(*keys).agg(*(F.sum(c).alias(c) for c in columns))
    odds = F.array(*(F.exp(F.col(c) + float(b)) for c, b in zip(columns, model.bias, strict=True)))
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    scored = sums.withColumn("odds", odds).withColumn("licence", 1 - F.element_at("odds", -1) / total)
    best = F.array_max(F.slice("odds", 1, len(columns) - 2))
    named = F.element_at(_strings(model.kinds), F.array_position("odds", best).cast("int"))
    scored = scored.withColumns({"named": named, "probability": best / total}).where(F.col("licence") >= model.least_licence)
    scored = saved(scored.select(*keys, "named", "probability", "licence"), "licences")
    # the words of the templates, which are fixed texts
    words = spark.createDataFrame(model.template_words, "word string, template int, named string, share double, weight double")
    held = found.join(scored, keys).select(*keys, "named", F.explode(F.array_distinct("words")).alias("word")).join(F.broadcast(words), ["word", "named"])
    alike = held.groupBy(*keys, "template").agg(F.sum("share").alias("share"), F.max("weight").alias("weight")).groupBy(*keys)
    alike = alike.agg(F.round(F.max("share"), 9).alias("similarity"), F.max(F.when(F.col("share") >= CONFIRM, F.col("weight"))).alias("covered"))
    judged = scored.join(alike, keys, "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    confirmed = (F.col("probability") >= model.least_named * F.col("licence")) & F.col("covered").isNotNull()
    return judged.select(
        *keys, F.when(confirmed, F.col("named")).otherwise(UNKNOWN).alias("family"), F.round(F.when(confirmed, F.col("probability")).otherwise(F.col("licence")), 9).alias("probability"),
        "similarity", F.when(confirmed, F.col("covered")).otherwise(0.0).alias("covered"), confirmed.alias("confirmed"),
    )


def _counted(found: DataFrame) -> DataFrame:
    """Of each line or run and family the best window; of runs those that confirm a heavier wording than each of their lines does, and
    unknown ones without a line that is a licence; and the lines in no such run."""
    best = Window.partitionBy("row", "single", "run", "family").orderBy(F.desc("covered"), F.desc("probability"), "line")
    found = saved(found.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place"), "found")
    keys = ["row", "run", "line", "last", "family"]
    lines = found.where("single").select("row", F.col("line").alias("at"), F.col("covered").alias("by_line"))
    runs = found.where("not single")
    most = runs.join(lines, "row").where("at between line and last").groupBy(*keys).agg(F.max("by_line").alias("by_line"))
    runs = runs.join(most, keys, "left").where("covered > coalesce(by_line, -1)").drop("by_line")
    # a run that is no listed licence in itself, where another window of it is one
    named = runs.where("confirmed").select("row", "run").distinct()
    runs = runs.where("confirmed").unionByName(runs.where("not confirmed").join(named, ["row", "run"], "left_anti"))
    within = runs.select(F.col("row").alias("in_row"), F.col("line").alias("begin"), F.col("last").alias("end"))
    single = found.where("single").join(within, (F.col("row") == F.col("in_row")) & F.col("line").between(F.col("begin"), F.col("end")), "left_anti")
    return single.unionByName(runs.select(*single.columns))


def license_scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, family, probability, similarity, line, n_paragraphs and n_unknown for every row of `docs`.

    family is that of the document's most probable confirmed paragraph (the first one, of equals), else `unknown` if a paragraph
    is a licence of no listed family, and line the number of its first line; `none` without any, then the other columns are null and
    n_paragraphs, of confirmed ones, and n_unknown 0. Null and empty texts have none. Repeated rows are scanned each for itself;
    an empty table gives no rows. Only doc_id and text are read.
    """
    docs = with_row_id(docs, "row", ["doc_id", "text"])
    found = _counted(saved(scan(docs, model), "scanned"))
    first = F.struct(~F.col("confirmed"), -F.col("probability"), F.col("line"))
    best = found.groupBy("row").agg(
        F.min_by("family", first).alias("family"), F.min_by("probability", first).alias("probability"), F.min_by("similarity", first).alias("similarity"),
        F.min_by("line", first).alias("line"), F.count_if("confirmed").alias("n_paragraphs"), F.count_if(~F.col("confirmed")).alias("n_unknown"),
    )
    joined = docs.select("row", "doc_id").join(best, "row", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", F.coalesce("family", F.lit(NONE)).alias("family"), "probability", "similarity", "line", count("n_paragraphs"), count("n_unknown"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
