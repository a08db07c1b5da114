"""Operator 10: a Brown class bigram language model with exchange clustering.

Every word of the vocabulary has a class. The ``core``, the most frequent words, is clustered by exchange on the counts of
its neighbouring words: each word in turn goes where the likelihood of the class bigrams is highest, until
nothing is gained. Each word outside the core then joins the class under which its own neighbours, over the whole
corpus, are likeliest. A core as large as the vocabulary is exchange clustering of every word. A text's probability is the
product of class transitions and of the words' emissions by their classes, each smoothed by one added count.

Counts, vocabulary, classes and transitions cover all training tokens. Frequent words, a table of bounded size, are
looked up in the task that reads a text; its other words are joined to the whole vocabulary by the word, where no
key is frequent, so none is hot, and fill the gaps in the text's sequence of classes.

The driver holds the core's bigrams, at most core squared counts (50 MB as they arrive, and 67 MB as two matrices, for 2,048
words), and FREQUENT words with their counts and classes (about 25 MB), whatever the corpus.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm.common import Table, bytes_of, crc_mod, documents, tree_sum

CORE, CLASSES = 2_048, 64
#: Exchange ends with a sweep that raises the log likelihood of a token by less than this.
TOLERANCE = 1e-5
#: Words that every task gets, of at most so many bytes each.
FREQUENT, LONGEST = 262_144, 64
#: Distinct words a task counts before it passes the counts on; tokens it holds before it passes their neighbours on.
HELD, CHUNK = 200_000, 2_000_000
#: Tokens that are looked up at once.
LOOKUP = 400_000
END = b"\n"
#: In a sequence of classes, a word that is not in the table of frequent ones.
HOLE = 255


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words and the end; bytes.split() and lower() are those of ASCII."""
    return [*text.lower().split(), END]


# ---------------------------------------------------------------- counting

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})
        counts.clear()
        return made

    for batch in batches:
        for text in bytes_of(batch):
            counts.update(words_of(text))
            if len(counts) >= HELD:
                yield out()
    if counts:
        yield out()


def _level() -> Column:
    return F.floor(F.log2("c") * 64).cast("int")


def frequency_level(vocabulary: DataFrame, most: int) -> int | None:
    """The least level of counts at and above which there are at most `most` words; None if there is none."""
    sizes = {r.level: r.n for r in vocabulary.groupBy(_level().alias("level")).agg(F.count("*").alias("n")).collect()}  # at most 64 * 63 rows
    found, total = None, 0
    for level in sorted(sizes, reverse=True):
        total += sizes[level]
        if total > most:
            break
        found = level
    return found


class _Default(dict):
    """A dictionary with one value for all other keys, which it does not keep."""

    def __init__(self, items, other: int):
        super().__init__(items)
        self.other = other

    def __missing__(self, key: bytes) -> int:
        return self.other


class _Numbers(dict):
    """Numbers new keys."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _neighbours(core: list[bytes]):
    """How often one core word follows another in the task's texts; code is first * len(core) + second."""
    size = len(core) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, total = _Default(zip(core, range(len(core)), strict=True), len(core)), np.zeros(size * size, dtype=np.int64)
        flat = array("i", [numbers[END]])

        def add() -> None:
            nonlocal flat, total
            a = np.frombuffer(flat, dtype=np.int32).astype(np.int64)
            total += np.bincount(a[:-1] * size + a[1:], minlength=len(total))
            flat = array("i", [numbers[END]])  # texts end with END

        for batch in batches:
            for text in bytes_of(batch):
                flat.extend(map(numbers.__getitem__, words_of(text)))
                if len(flat) > CHUNK:
                    add()
        add()
        inner = total.reshape(size, size)[:-1, :-1].ravel()
        codes = np.flatnonzero(inner)
        yield pa.RecordBatch.from_pydict({"code": pa.array(codes.astype(np.int32)), "n": pa.array(inner[codes])})

    return run


# ---------------------------------------------------------------- classes

def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, x, 1.0))


def exchange(counts: np.ndarray, classes: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """The class of each unit: each in turn goes to the class where the likelihood of the class
    bigrams is highest, until a sweep gains too little. counts[a, b]: how often b follows a."""
    units = len(counts)
    counts = np.ascontiguousarray(counts, dtype=np.float64)
    flipped = np.ascontiguousarray(counts.T)
    order = np.argsort(-counts.sum(axis=0), kind="stable")
    of = np.empty(units, dtype=np.int64)
    of[order] = np.arange(units) % classes
    hot = np.eye(classes)[of]
    after, before = counts @ hot, flipped @ hot  # of each unit, by the neighbour's class
    table = hot.T @ after
    every, total = np.arange(classes), max(1.0, float(counts.sum()))
    while True:
        gained = 0.0
        for w in order:
            own, self_n = of[w], counts[w, w]
            follow, precede = after[w].copy(), before[w].copy()
            if not follow.sum() + precede.sum():
                continue
            follow[own] -= self_n
            precede[own] -= self_n
            table[own] -= follow
            table[:, own] -= precede
            table[own, own] -= self_n
            # wherever the word goes, its neighbours' classes get what it follows and precedes
            rows, columns, logs = table.sum(axis=1) + precede, table.sum(axis=0) + follow, _xlogx(table)
            f, p = np.flatnonzero(follow), np.flatnonzero(precede)
            gain = (_xlogx(table[:, f] + follow[f]) - logs[:, f]).sum(axis=1) + (_xlogx(table[p] + precede[p, None]) - logs[p]).sum(axis=0)
            at = table[every, every]
            gain += _xlogx(at + follow + precede + self_n) - _xlogx(at + follow) - _xlogx(at + precede) + logs[every, every]
            gain -= _xlogx(rows + follow.sum() + self_n) - _xlogx(rows) + _xlogx(columns + precede.sum() + self_n) - _xlogx(columns)
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            table[best] += follow
            table[:, best] += precede
            table[best, best] += self_n
            if best != own:
                gained += float(gain[best] - gain[own])
                of[w] = best
                after[:, own] -= flipped[w]
                after[:, best] += flipped[w]
                before[:, own] -= counts[w]
                before[:, best] += counts[w]
        if gained <= tolerance * total:
            return of


def _contexts(class_of: dict[bytes, int], classes: int):
    """For each word outside the core, and chunk of texts, two bytes an occurrence: the class of the
    word before it and that of the word after it, or `classes` where that is outside the core, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, codes = _Numbers(), array("i")

        def out() -> pa.RecordBatch:
            own, words = np.frombuffer(codes, dtype=np.int32), list(numbers)
            kinds = np.fromiter((class_of.get(w, classes) for w in words), dtype=np.uint8, count=len(words))[own]
            before, after = np.roll(kinds, 1), np.roll(kinds, -1)  # a chunk ends with END, which is before its first word
            at = np.flatnonzero(kinds == classes)
            at = at[np.argsort(own[at], kind="stable")]
            number, first = np.unique(own[at], return_index=True)
            ends = (2 * np.append(first, len(at))).astype("<i4").tobytes()
            pairs = np.stack([before[at], after[at]], axis=1).tobytes()
            payload = pa.Array.from_buffers(pa.binary(), len(number), [None, pa.py_buffer(ends), pa.py_buffer(pairs)])
            return pa.RecordBatch.from_arrays([pa.array([words[i] for i in number.tolist()], pa.binary()), payload], ["word", "around"])

        for batch in batches:
            for text in bytes_of(batch):
                codes.extend(map(numbers.__getitem__, words_of(text)))
                if len(codes) >= CHUNK:
                    yield out()
                    numbers, codes = _Numbers(), array("i")
        if codes:
            yield out()

    return run


def best_classes(before: np.ndarray, after: np.ndarray, table: np.ndarray, other: int) -> np.ndarray:
    """For each word the class under which its neighbours are likeliest, of counts by their class; `other` for words without any."""
    t = table + 0.5
    gain = before @ np.log(t / t.sum(axis=0, keepdims=True)) + after @ np.log(t / t.sum(axis=1, keepdims=True)).T
    return np.where(before.sum(axis=1) + after.sum(axis=1) > 0, gain.argmax(axis=1), other)


def _assign(table: np.ndarray, other: int):
    """Word, count and class of each word, whose rows follow one another."""
    classes = len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, held = None, np.zeros((1, 2, classes + 1), dtype=np.int64)

        def out(words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
            found = best_classes(counts[:, 0, :-1], counts[:, 1, :-1], table, other)
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "c": pa.array(counts[:, 0].sum(axis=1)), "class": pa.array(found.astype(np.int32))})

        for batch in batches:
            if not batch.num_rows:
                continue
            words, around = batch.column("word"), batch.column("around")
            new = np.concatenate([[True], pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)])
            number = np.repeat(np.cumsum(new) - 1, pc.binary_length(around).to_numpy() // 2)
            pairs = np.frombuffer(b"".join(around.to_pylist()), dtype=np.uint8).reshape(-1, 2)
            k = int(new.sum())
            counts = np.stack([np.bincount(number * (classes + 1) + pairs[:, i], minlength=k * (classes + 1)).reshape(k, -1) for i in (0, 1)], axis=1)
            own = words.filter(pa.array(new)).to_pylist()
            if word == own[0]:
                counts[:1] += held
            elif word is not None:
                yield out([word], held)
            if k > 1:
                yield out(own[:-1], counts[:-1])
            word, held = own[-1], counts[-1:].copy()
        if word is not None:
            yield out([word], held)

    return run


# ---------------------------------------------------------------- the model

class Model:
    """What every task needs: frequent words with counts and classes, the classes' sizes, totals."""

    def __init__(self, frequent: dict[bytes, tuple[int, int]], sizes: np.ndarray, other: int, tokens: int, distinct: int):
        self.words = list(frequent)
        self.counts, self.classes = (np.asarray([v[i] for v in frequent.values()], dtype=np.int64) for i in (0, 1))
        self.sizes, self.other, self.tokens, self.distinct = sizes, other, tokens, distinct
        self.end_class = int(self.classes[0])

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.tokens + self.distinct + 1))

    def emission(self, n: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / self.sizes[kind])


def fit(train: DataFrame, core: int = CORE, classes: int = CLASSES, frequent: int = FREQUENT) -> tuple[Model, Table]:
    """The model without its transitions, and the table (word, c, class) of the vocabulary outside the core."""
    if not 2 <= classes < HOLE:
        raise ValueError(f"classes have to be from 2 to {HOLE - 1}")
    spark, train = train.sparkSession, train.select("text")
    vocabulary = Table(train.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    total = vocabulary.df.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = vocabulary.df.where(F.col("word") == F.lit(END)).first()
    short = (F.octet_length("word") <= LONGEST) & (F.col("word") != F.lit(END))
    level = frequency_level(vocabulary.df.where(short), max(core, frequent))
    often = (short & (_level() >= level)) if level is not None else F.lit(False)
    top = {bytes(r.word): r.c for r in vocabulary.df.where(often).collect()}  # at most max(core, frequent) rows
    vocabulary.drop()
    core_words = [END, *sorted(top, key=lambda w: (-top[w], w))[: core - 1]]

    found = train.mapInArrow(_neighbours(core_words), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most core squared rows
    counts = np.zeros(len(core_words) ** 2, dtype=np.float64)
    counts[found.column("code").to_numpy()] = found.column("n").to_numpy()
    counts = counts.reshape(len(core_words), -1)
    kinds = exchange(counts, classes)
    hot = np.eye(classes)[kinds]
    class_of, other = dict(zip(core_words, kinds.tolist(), strict=True)), int(kinds[-1])

    sent = spark.sparkContext.broadcast((class_of, hot.T @ counts @ hot))
    around = train.mapInArrow(lambda b: _contexts(sent.value[0], classes)(b), "word binary, around binary")
    around = around.repartition("word").sortWithinPartitions("word")
    rest = Table(around.mapInArrow(lambda b: _assign(sent.value[1], other)(b), "word binary, c long, class int"), "word-classes")

    known = {w: (ends.c if ends else 0) if w == END else top[w] for w in core_words}
    sizes = np.bincount(kinds, weights=[n + 1 for n in known.values()], minlength=classes)
    sizes[other] += 1  # words never seen
    for r in rest.df.groupBy("class").agg(F.sum(F.col("c") + 1).alias("n")).collect():
        sizes[r["class"]] += r.n
    table = {w: (n, class_of[w]) for w, n in known.items()}
    table |= {bytes(r.word): (r.c, r["class"]) for r in rest.df.where(often).collect()}  # as `top`, less the core
    return Model(table, np.maximum(sizes, 1), other, total.n, total.v), rest


# ---------------------------------------------------------------- scoring

_ROW = {"row": pa.int64(), "pos": pa.int32(), "word": pa.binary(), "seq": pa.binary(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "emission": pa.float64()}


def _lookup(sent):
    """For each text one row of its sequence of classes, with holes, and of what its frequent words give; for each hole one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        codes = _Default(zip(m.words, range(len(m.words)), strict=True), -1)
        base, emission, kinds = m.base(m.counts), m.emission(m.counts, m.classes), m.classes.astype(np.uint8)
        seen = m.counts > 0
        first, row = TaskContext.get().partitionId() << 33, 0

        def out(part: pa.RecordBatch, flat: list[bytes], lengths: list[int]) -> Iterator[pa.RecordBatch]:
            n = len(lengths)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            code = np.fromiter(map(codes.__getitem__, flat), dtype=np.int32, count=len(flat))
            hole = code < 0
            seq = np.where(hole, np.uint8(HOLE), kinds[code])
            sums = lambda x: np.add.reduceat(np.where(hole, 0, x[code]), starts)
            rows = np.arange(first + row, first + row + n)
            # a key that no word can be, as it begins with a space, and that no other row has
            made = {
                "row": pa.array(rows), "pos": pa.array(np.full(n, -1, dtype=np.int32)), "word": pa.array([b" %d" % r for r in rows.tolist()], pa.binary()),
                "seq": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, ends).astype("<i4").tobytes()), pa.py_buffer(seq.tobytes())]),
                "n_tokens": pa.array(np.asarray(lengths, dtype=np.int64)), "n_known": pa.array(sums(seen).astype(np.int64)), "base": pa.array(sums(base)), "emission": pa.array(sums(emission)),
            }
            yield pa.RecordBatch.from_pydict(made | {c: part.column(c) for c in ("doc_id", "held_out")})
            at = np.flatnonzero(hole)
            if len(at):
                owner = np.searchsorted(ends, at, side="right")
                made = {k: pa.nulls(len(at), t) for k, t in _ROW.items()} | {c: pa.nulls(len(at), part.column(c).type) for c in ("doc_id", "held_out")}
                made |= {"row": pa.array(rows[owner]), "pos": pa.array((at - starts[owner]).astype(np.int32)), "word": pa.array([flat[i] for i in at.tolist()], pa.binary())}
                yield pa.RecordBatch.from_pydict(made)

        for batch in batches:
            flat, lengths, begun = [], [], 0
            for text in bytes_of(batch):
                words = words_of(text)
                flat += words
                lengths.append(len(words))
                if len(flat) >= LOOKUP:
                    yield from out(batch.slice(begun, len(lengths)), flat, lengths)
                    row, begun = row + len(lengths), begun + len(lengths)
                    flat, lengths = [], []
            if lengths:
                yield from out(batch.slice(begun, len(lengths)), flat, lengths)
                row += len(lengths)

    return run


_FILLED = ["doc_id", "held_out", "n_tokens", "n_known", "base", "emission", "seq"]


def _fill(sent):
    """Puts the classes of the other words into the sequences; a text's rows follow one another, the sequence first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held = sent.value, []

        def out(table: pa.Table) -> pa.RecordBatch:
            pos = table.column("pos").to_numpy()
            is_text = pos < 0
            texts = table.filter(pa.array(is_text)).combine_chunks()
            n = texts.num_rows
            lengths = texts.column("n_tokens").to_numpy()
            ends = np.cumsum(lengths)
            seq = np.frombuffer(b"".join(texts.column("seq").to_pylist()), dtype=np.uint8).copy()
            hole = ~is_text
            owner = (np.cumsum(is_text) - 1)[hole]
            c = pc.fill_null(table.column("c"), 0).to_numpy()[hole]
            kind = pc.fill_null(table.column("class"), m.other).to_numpy()[hole]
            seq[(ends - lengths)[owner] + pos[hole]] = kind
            plus = lambda name, x: texts.column(name).to_numpy() + np.bincount(owner, weights=x, minlength=n)
            made = {
                "n_known": pa.array(plus("n_known", c > 0).astype(np.int64)), "base": pa.array(plus("base", m.base(c))), "emission": pa.array(plus("emission", m.emission(c, kind))),
                "seq": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, ends).astype("<i4").tobytes()), pa.py_buffer(seq.tobytes())]),
            }
            plain = {k: texts.column(k).combine_chunks() for k in ("doc_id", "held_out", "n_tokens")}
            return pa.RecordBatch.from_arrays([(plain | made)[k] for k in _FILLED], _FILLED)

        for batch in batches:
            starts = np.flatnonzero(batch.column("pos").to_numpy() < 0)
            if len(starts):  # all that came before the last text is whole
                last = int(starts[-1])
                held.append(batch.slice(0, last))
                if whole := [b for b in held if b.num_rows]:
                    yield out(pa.Table.from_batches(whole))
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if whole := [b for b in held if b.num_rows]:
            yield out(pa.Table.from_batches(whole))

    return run


def _pairs(batch: pa.RecordBatch, end_class: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class before each token, its own, and where each text starts. No text is without a token."""
    lengths = batch.column("n_tokens").to_numpy()
    own = np.frombuffer(b"".join(batch.column("seq").to_pylist()), dtype=np.uint8).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    before = np.roll(own, 1)
    before[starts] = end_class
    return before, own, starts


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, core: int = CORE, classes: int = CLASSES, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `docs`.

    Learns from the rows whose crc32(doc_id as text) is not `held_out` modulo `folds`. Null texts are
    empty: one token, the end. Rows with a null id are learnt from and not held out; repeated rows
    count and are scored each for itself. Without any training row all counts are 0. An empty table gives
    no rows. Columns other than doc_id and text are not read.

    `core` words are clustered by exchange, all others by their neighbours in the core; `frequent` decides
    how many are looked up in the tasks, which changes no count and no class.
    """
    docs = docs.select("doc_id", "text", (crc_mod("doc_id", folds) == held_out).alias("held_out"))
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    model, rest = fit(docs.where(~F.col("held_out")), core, classes, frequent)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.mapInArrow(
        _lookup(sent), f"row long, pos int, word binary, seq binary, n_tokens long, n_known long, base double, emission double, doc_id {kind}, held_out boolean"
    )
    joined = rows.join(rest.df, "word", "left").drop("word").repartition("row").sortWithinPartitions("row", "pos")
    filled = Table(joined.mapInArrow(_fill(sent), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, emission double, seq binary"), "sequences")
    rest.drop()
    end_class = model.end_class

    def transitions(batch: pa.RecordBatch) -> np.ndarray:
        before, own, _ = _pairs(batch, end_class)
        return np.bincount(before * classes + own, minlength=classes * classes).astype(np.float64)

    counts = tree_sum(filled.df.where(~F.col("held_out")).select("n_tokens", "seq"), transitions, classes * classes).reshape(classes, classes)
    moves = np.log10((counts + 1) / (counts.sum(axis=1, keepdims=True) + classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                before, own, starts = _pairs(batch, end_class)
                made = batch.column("emission").to_numpy() + np.add.reduceat(moves[before, own], starts)
                columns = [*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base")), pa.array(made)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    found = filled.df.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
