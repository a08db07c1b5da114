"""Operator 8: best-fit packing of token sequences, improved by swap-based local search.

Documents become pieces of at most `capacity` tokens. Which pieces are alike is only a matter of
their lengths, so the packing is planned on the histogram of lengths, of at most `capacity`
entries at any input size: bins with the same contents are one class with a count. Best fit
in falling lengths makes the first packing; local search then moves a piece, exchanges one for one
or two for one between classes of underfull bins, wherever that makes the fuller one
fuller (the sum of squared fills rises), until bins are empty. Each piece finds its place by its rank
among the pieces of its length, which comes from counts per task and length.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybrook.llm import pretokens
from tallybrook.llm.common import documents, saved, texts_of, tokenizer_path

CAPACITY = 2048
CACHE_SIZE = 400_000

# ---------------------------------------------------------------- tokens

#: Splitting of the word vocabulary's texts (fixed value).
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_CONTROL = regex.compile(r"[\x1c-\x1f]")


class WordIds(dict):
    """White-space-delimited chunk (lower case) to its ids as little-endian 32-bit numbers."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.cache_size = Tokenizer.from_file(path), cache_size
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= self.cache_size:
                self.words.clear()
            # the library's model alone: a word of letters below U+0100 needs no more normalising
            tokens = self.model.tokenize(pretokens.as_letters(word))
            ids = self.words[word] = np.asarray([t.id for t in tokens], dtype="<u4").tobytes()
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > 64:
            return self.whole(chunk)
        ids = b"".join(map(self._word, _PIECE.findall(chunk)))
        if len(self) >= self.cache_size:
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Texts with special strings, or with characters that the engines may class differently,
        go to the library as a whole."""
        if not pretokens.is_latin(text) or _CONTROL.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.lower().split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and the task and the rank among the
    task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = word_ids(path), np.asarray([end_id], dtype="<u4").tobytes()
        task, seen, step = TaskContext.get().partitionId(), Counter(), 4 * capacity
        for batch in batches:
            at, piece, length, crc, rank = [], [], [], [], []
            for i, text in enumerate(texts_of(batch)):
                ids = own.encode(text) + end
                for k, start in enumerate(range(0, len(ids), step)):
                    part = ids[start : start + step]
                    n = len(part) // 4
                    at.append(i)
                    piece.append(k)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    rank.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(at, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(np.asarray(piece, dtype=np.int64) * capacity),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "task": pa.array([task] * len(at), pa.int32()),
                    "rank_in_task": pa.array(rank, pa.int64()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank_in_task long"
    )


# ---------------------------------------------------------------- planning on the histogram

Contents = tuple[tuple[int, int], ...]  # lengths, falling, with their numbers


def _added(contents: Contents, length: int, n: int) -> Contents:
    held = dict(contents)
    held[length] = held.get(length, 0) + n
    if held[length] < 0:
        raise ValueError("a bin can't give what it doesn't hold")
    return tuple(sorted(((k, v) for k, v in held.items() if v), reverse=True))


def fill(contents: Contents) -> int:
    return sum(k * v for k, v in contents)


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Best fit in falling lengths, a class of equal bins at a time."""
    by_slack: dict[int, Counter] = defaultdict(Counter)
    slacks: list[int] = []

    def put(contents: Contents, n: int) -> None:
        slack = capacity - fill(contents)
        if slack not in by_slack:
            bisect.insort(slacks, slack)
        by_slack[slack][contents] += n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(slacks, length)
            if at == len(slacks):  # no bin has room: open new ones
                each = capacity // length
                if left // each:
                    put(((length, each),), left // each)
                if left % each:
                    put(((length, left % each),), 1)
                break
            slack = slacks[at]
            contents, bins = by_slack[slack].popitem()
            if not by_slack[slack]:
                del by_slack[slack]
                slacks.pop(at)
            each = slack // length
            whole = min(bins, left // each)
            rest = left - whole * each if whole < bins else 0
            if whole:
                put(_added(contents, length, each), whole)
            if whole < bins and 0 < rest < each:
                put(_added(contents, length, rest), 1)
                if bins - whole > 1:
                    put(contents, bins - whole - 1)
                left = 0
            else:
                if bins - whole:
                    put(contents, bins - whole)
                left -= whole * each
    return sum(by_slack.values(), Counter())


def least_bins(histogram: dict[int, int], capacity: int) -> int:
    """A number of bins that no packing can go below. For each k up to half a bin: pieces longer than capacity - k have a bin
    to themselves, the other ones longer than half have one each, and what these leave may hold the rest from k on."""
    counts = np.zeros(capacity + 2, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    number, tokens = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 2))
    half, most = capacity // 2, -(-int(tokens[-1]) // capacity)
    for k in range(1, half + 1):
        apart, halves = int(number[capacity] - number[capacity - k]), int(number[capacity - k] - number[half])
        left = halves * capacity - int(tokens[capacity - k] - tokens[half])
        small = int(tokens[half] - tokens[k - 1])
        most = max(most, apart + halves + max(0, -(-(small - left) // capacity)))
    return most


class _Open:
    """The classes of underfull bins, with their numbers, and for each amount (a piece's length, or two of a bin's
    together) the emptiest class that can give it."""

    def __init__(self, bins: Counter, capacity: int):
        self.capacity, self.bins = capacity, Counter()
        self.givers: list[list[tuple[int, Contents]]] = [[] for _ in range(capacity + 1)]
        self.emptiest = np.full(capacity + 1, capacity + 1, dtype=np.int64)
        self.known: set[Contents] = set()
        for contents, n in bins.items():
            self.add(contents, n)

    def add(self, contents: Contents, n: int) -> None:
        if n < 0 and self.bins[contents] + n < 0:
            raise ValueError("there are not so many bins of a class")
        self.bins[contents] += n
        if not self.bins[contents]:
            del self.bins[contents]
        full = fill(contents)
        if contents in self.known or full >= self.capacity or n <= 0 or not contents:
            return
        self.known.add(contents)
        amounts = {a for a, _ in contents}
        amounts |= {a + c for i, (a, n_a) in enumerate(contents) for c, _ in contents[i if n_a > 1 else i + 1 :]}
        for t in amounts:
            heapq.heappush(self.givers[t], (full, contents))
            self.emptiest[t] = self.givers[t][0][0]

    def giver(self, t: int, taker: Contents) -> Contents | None:
        """The emptiest class that gives t, which is the taker's own only if there are two such bins."""
        heap = self.givers[t]
        while heap and heap[0][1] not in self.bins:
            gone = heapq.heappop(heap)[1]
            self.known.discard(gone)  # it is listed anew if there are such bins again
        self.emptiest[t] = heap[0][0] if heap else self.capacity + 1
        if not heap:
            return None
        if heap[0][1] != taker or self.bins[taker] > 1:
            return heap[0][1]
        return min((x for x in heap if x[1] in self.bins and x[1] != taker), default=(0, None))[1]

    def step(self, high: Contents) -> tuple[Contents, int, int] | None:
        """The giver, what it gives and what it gets, of the step that raises the sum of squared fills most."""
        full = fill(high)
        slack = self.capacity - full
        while True:
            best, found = 0, None
            for b in (0, *(x for x, _ in high)):
                upto = min(self.capacity, b + slack)
                low = self.emptiest[b + 1 : upto + 1]
                gained = np.arange(1, len(low) + 1)
                worth = np.where(low <= full, gained * (full - low + gained), 0)
                at = int(worth.argmax()) if len(worth) else 0
                if len(worth) and worth[at] > best:
                    best, found = int(worth[at]), (b + 1 + at, b)
            if found is None:
                return None
            t, b = found
            before = self.emptiest[t]
            giver = self.giver(t, high)
            if giver is not None and fill(giver) == before:
                return giver, t, b
            if self.emptiest[t] == before:  # the taker is the emptiest, and the only bin of its class
                return self._without(high)

    def _without(self, high: Contents) -> tuple[Contents, int, int] | None:
        """As step(), where the taker itself is the only bin that gives some amount: each amount is looked up."""
        full, best, found = fill(high), 0, None
        for b in (0, *(x for x, _ in high)):
            for t in np.flatnonzero(self.emptiest[b + 1 : min(self.capacity, b + self.capacity - full) + 1] <= full) + b + 1:
                giver = self.giver(int(t), high)
                if giver is None or fill(giver) > full:
                    continue
                worth = int(t - b) * int(full - fill(giver) + t - b)
                if worth > best:
                    best, found = worth, (giver, int(t), b)
        return found


def _parts(contents: Contents, t: int) -> Counter:
    """The piece of length t, or two pieces of t together."""
    held = dict(contents)
    if t in held:
        return Counter({t: 1})
    return next(Counter([a, t - a]) for a, n in contents if t - a in held and (t != 2 * a or n > 1))


def local_search(bins: Counter, capacity: int) -> Counter:
    """Moves, one-for-one and two-for-one exchanges between underfull bins: pieces go from the
    emptier to the fuller bin, so each step raises the sum of squared fills; empty bins go.
    It ends at the least number of bins there can be, or where no step is left."""
    histogram: Counter = Counter()
    for contents, n in bins.items():
        for length, each in contents:
            histogram[length] += n * each
    least, total = least_bins(histogram, capacity), sum(bins.values())
    state = _Open(bins, capacity)
    moved = True
    while moved and total > least:
        moved = False
        for high in sorted((c for c in state.bins if fill(c) < capacity), key=lambda c: (-fill(c), c)):
            while high in state.bins and total > least and fill(high) < capacity and (change := state.step(high)):
                low, t, b = change
                n = state.bins[high] // 2 if low == high else min(state.bins[low], state.bins[high])
                new_low, new_high = low, high
                for k, v in _parts(low, t).items():
                    new_low, new_high = _added(new_low, k, -v), _added(new_high, k, v)
                if b:
                    new_low, new_high = _added(new_low, b, 1), _added(new_high, b, -1)
                for c, d in ((low, -n), (high, -n), (new_low, n), (new_high, n)):
                    state.add(c, d)
                if not new_low:
                    total -= state.bins.pop(new_low)
                moved, high = True, new_high
    return state.bins


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length, spans of ranks as rows of (first rank, first bin, number of bins, pieces a bin,
    offset of the first of them). Spans of a length follow one another."""
    spans: dict[int, list] = defaultdict(list)
    used: Counter = Counter()
    first = 0
    for contents, n in sorted(local_search(best_fit(histogram, capacity), capacity).items()):
        offset = 0
        for length, each in contents:
            spans[length].append((used[length], first, n, each, offset))
            used[length] += n * each
            offset += length * each
        first += n
    return {k: np.asarray(v, dtype=np.int64) for k, v in spans.items()}


# ---------------------------------------------------------------- the operator

def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset, for every row of `docs`.

    Null texts count as empty: their one piece is the end id. Rows with equal ids are packed each for
    itself; their pieces differ in place only. An empty table gives no rows. Columns other than doc_id
    and text are not read.
    """
    cut = saved(pieces(docs, path, end_id, capacity), "pieces")
    counts = saved(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    spans = docs.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["task", "length"]).withColumn("rank", F.col("before") + F.col("rank_in_task"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                s = spans.value[int(n)]
                s = s[np.searchsorted(s[:, 0], rank[own], side="right") - 1]
                k = rank[own] - s[:, 0]
                sequence[own] = s[:, 1] + k // s[:, 3]
                offset[own] = s[:, 4] + k % s[:, 3] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select(*names, "rank").mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
