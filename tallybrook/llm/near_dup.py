"""Operator 6: near-duplicate documents by MinHash with tensored banding.

A table's key is usually made of k minima for each of L tables, k*L hash functions. Here two small
collections of groups of minima are made, and each pair of a group of the first and a group of the second is
a table: g squared tables of 2*r minima from 2*g*r functions, 144 of 8 from 96 at a similarity of 0.85. How many groups there are
follows from the similarity (`layout`), so that a link just at it is missed with a chance of at most ``MISSED``.

Documents with equal shingle sets are one representative. In each table the members of a key are
tied to its smallest one, its hub. A document has one row a table, so of all rows that are dealt for this one key
has one in as many as there are tables, at most. Ties whose estimated similarity is high enough are verified exactly on full
sets, a member at a time against its hub, and make families, the connected parts of their graph.

Most copies are linked by then. In a family that is not, the documents outside its largest linked part are compared
with all others of the family that share a rare shingle with them: any two sets as similar as asked share one of each's few
rarest. Blocks of bounded size meet for that, so that neither pairs are emitted nor is a family held whole. The cost is linear
in a family's linked part, and the product of the rest and the family in how often blocks are sent.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import Table, bytes_of, documents, lookup_join, saved, with_row_id

SHINGLE, PERCENT = 5, 80
#: Chance of missing a link at exactly the threshold, minima a group at most, groups at most where fewer minima would do.
MISSED, ROWS, GROUPS = 3e-4, 4, 14
#: Estimated similarity from which a tie counts for a family; far below the threshold.
FAMILY, BELOW = 0.5, 0.3
#: Ties of a hub in one task's part, and shingles and documents, about, that a block of a family's other documents holds, and
#: how many such blocks the family is divided in for each of those.
TIES, BLOCK_SHINGLES, BLOCK_DOCUMENTS, FINER = 20_000, 400_000, 20_000, 4
#: Documents that are compared with one at once.
AT_ONCE = 4_096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def layout(percent: int) -> tuple[int, int]:
    """Groups in each collection, and minima in a group: a link is missed if either collection has no equal group."""
    t = percent / 100
    for rows in range(ROWS, 0, -1):
        equal = min(t**rows, 1 - 1e-12)
        groups = max(1, math.ceil(math.log(1 - math.sqrt(1 - MISSED)) / math.log(1 - equal)))
        if groups <= GROUPS:
            break
    return groups, rows


@functools.lru_cache(maxsize=4)
def _seeds(functions: int) -> np.ndarray:
    return np.random.default_rng(6).integers(1, 1 << 63, size=(2, functions), dtype=np.uint64) | np.uint64(1)


#: Words whose hashes a worker keeps.
KEPT = 150_000


class _WordHashes(dict):
    """Word to a 64-bit hash, kept for words met before."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[word] = h
        return h


_hashes = _WordHashes()


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles of `size` words, as sorted 64-bit hashes; the whole sequence where it is shorter.

    Two shingles of one document of 20,000 words share a hash with a chance of about 1e-11."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), dtype=np.uint64)
    for k in range(min(size, len(h))):
        out = _scrambled(out * _MIX + h[k : k + n])
    return np.unique(out)


def minima(sets: list[np.ndarray], functions: int) -> np.ndarray:
    """For each set, one minimum for each hash function. No set may be empty."""
    seeds = _seeds(functions)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), functions), dtype=np.uint64)
    for f in range(functions):
        out[:, f] = np.minimum.reduceat((flat ^ seeds[0, f]) * seeds[1, f], starts)
    return out


def _sign(size: int, percent: int):
    """Signatures of the documents that have words; others get a null fingerprint."""
    groups, rows = layout(percent)
    at_once = 500_000

    def out(part: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        full, n = [i for i, s in enumerate(sets) if len(s)], len(sets)
        marks, a, b, sketch = [None] * n, [None] * n, [None] * n, [None] * n
        if full:
            least = minima([sets[i] for i in full], 2 * groups * rows)
            keys = np.zeros((len(full), 2 * groups), dtype=np.uint64)
            for r in range(rows):
                keys = _scrambled(keys * _MIX + least[:, r::rows])
            keys = (keys + np.arange(2 * groups, dtype=np.uint64) * _MIX).view(np.int64)
            low = (least >> np.uint64(40)).astype(np.uint8)
            for j, i in enumerate(full):
                marks[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                a[i], b[i], sketch[i] = keys[j, :groups], keys[j, groups:], low[j].tobytes()
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [part.column("row"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array(a, longs), pa.array(b, longs), pa.array(sketch, pa.binary())],
            ["row", "doc_id", "n_shingles", "mark", "first", "second", "sketch"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[np.ndarray] = []
            begun = total = 0
            for i, text in enumerate(bytes_of(batch)):
                sets.append(shingles(text, size))
                total += len(sets[-1])
                if total >= at_once:
                    yield out(batch.slice(begun, len(sets)), sets)
                    sets, begun, total = [], i + 1, 0
            if sets:
                yield out(batch.slice(begun, len(sets)), sets)

    return run


def _resemblance(a: pa.RecordBatch) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(a.column(c).to_pylist()), dtype=np.uint8).reshape(a.num_rows, -1) for c in ("sketch", "hub_sketch"))
    return (x == y).mean(axis=1)


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(_resemblance(batch) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("row").filter(keep), batch.column("hub").filter(keep)], ["row", "hub"])

    return run


def _flattened(labels: Table) -> Table:
    """Replaces each root by its own root until nothing changes; every root has to be a row."""
    while True:
        far = labels.df.select(F.col("row").alias("root"), F.col("root").alias("far"))
        jumped = labels.df.join(far, "root").select("row", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved"))
        jumped = Table(jumped, "labels")
        labels.drop()
        labels = jumped
        if labels.df.where("moved").isEmpty():
            return labels


def components(edges: DataFrame) -> DataFrame:
    """row and root, the smallest row it is connected with, for every row in `edges` (row, hub).

    Each row points to the smallest of itself and its neighbours. These pointers form trees, which
    are flattened by doubling; then a tree becomes its root, and only edges between trees are
    left. A tree has two rows or more, so rows halve at least from round to round, and the edges of
    a large group are gone after the first few."""
    edges = Table(edges.select("row", "hub").distinct(), "edges")
    found = None
    while True:
        ends = edges.df.union(edges.df.select(F.col("hub").alias("row"), F.col("row").alias("hub")))
        labels = _flattened(Table(ends.groupBy("row").agg(F.least(F.col("row"), F.min("hub")).alias("root")), "labels"))
        ends_to = [labels.df.select(F.col("row").alias(c), F.col("root").alias(f"{c}_root")) for c in ("row", "hub")]
        between = edges.df.join(ends_to[0], "row").join(ends_to[1], "hub").where("row_root <> hub_root")
        rest = Table(between.select(F.col("row_root").alias("row"), F.col("hub_root").alias("hub")).distinct(), "edges")
        edges.drop()
        edges = rest
        if found is None:
            found = labels
        else:
            further = labels.df.select(F.col("row").alias("root"), F.col("root").alias("far"))
            joined = Table(found.df.join(further, "root", "left").select("row", F.coalesce("far", "root").alias("root")), "labels")
            found.drop()
            labels.drop()
            found = joined
        if edges.df.isEmpty():
            edges.drop()
            return found.df.select("row", "root")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.asarray(pairs, dtype=np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["row", "hub"])


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u8") for x in column.to_pylist()]


def _with_hub(percent: int):
    """Links of members with their hub, of rows sorted by hub and part, the hub itself first in each part; only its set is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            found, sets = [], _sets_of(batch.column("shingles"))
            hubs, parts, rows = (batch.column(c).to_pylist() for c in ("hub", "part", "row"))
            at = 0
            while at < len(rows):
                if (hubs[at], parts[at]) != key:
                    key, held = (hubs[at], parts[at]), sets[at]
                    at += 1
                    continue
                end = at
                while end < len(rows) and (hubs[end], parts[end]) == key:
                    end += 1
                sizes = np.asarray([len(s) for s in sets[at:end]])
                flat = np.concatenate(sets[at:end])
                hit = held[np.minimum(np.searchsorted(held, flat), len(held) - 1)] == flat
                common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
                linked = 100 * common >= percent * (sizes + len(held) - common)
                found += [(rows[at + i], key[0]) for i in np.flatnonzero(linked)]
                at = end
            if found:
                yield _edges(found)

    return run


def link(rows: list[int], sets: list[np.ndarray], parts: list[int], first: int, percent: int) -> list[tuple[int, int]]:
    """Links, 100 * intersection >= percent * union, of the rows from `first` on with those before it, one for each two parts
    that they connect. parts: what is connected already."""
    sizes = np.asarray([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner, ends = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes)
    _, codes, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), dtype=np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    order = np.lexsort((rank[codes], owner))
    codes = rank[codes][order]  # of each set in turn, its rarest shingles first
    # two sets that are as similar share one of these: the others are fewer than they have to share
    rarest = sizes - -(-percent * sizes // 100) + 1
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    listed = (place < rarest[owner]) & (owner < first)
    by_code = np.argsort(codes[listed], kind="stable")
    listed_code, listed_owner = codes[listed][by_code], owner[listed][by_code]
    root = {p: p for p in parts}

    def of(p: int) -> int:
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    found, mark = [], np.zeros(len(counts), dtype=bool)
    numbers, part_of = np.unique(np.asarray(parts[:first]), return_inverse=True)
    for u in range(first, len(sets)):
        own = codes[ends[u] - sizes[u] : ends[u]]
        lo, hi = (np.searchsorted(listed_code, own[: rarest[u]], side=x) for x in ("left", "right"))
        near = np.unique(np.concatenate([listed_owner[a:b] for a, b in zip(lo, hi, strict=True)])) if len(lo) else lo
        near = near[100 * np.minimum(sizes[near], sizes[u]) >= percent * np.maximum(sizes[near], sizes[u])]
        mark[own] = True
        while len(near):
            done = np.asarray([of(int(p)) == of(parts[u]) for p in numbers[np.unique(part_of[near])]])
            near = near[~done[np.searchsorted(np.unique(part_of[near]), part_of[near])]]
            now, near = near[:AT_ONCE], near[AT_ONCE:]
            if not len(now):
                break
            length = sizes[now]
            begin = np.cumsum(length) - length
            at = np.arange(int(length.sum())) - np.repeat(begin, length) + np.repeat(ends[now] - length, length)
            common = np.add.reduceat(mark[codes[at]], begin, dtype=np.int64)
            for v in now[100 * common >= percent * (length + sizes[u] - common)].tolist():
                if of(parts[v]) != of(parts[u]):
                    found.append((rows[u], rows[v]))
                    root[of(parts[v])] = of(parts[u])
        mark[own] = False
    return found


def _verify(percent: int):
    """Links of two blocks' documents, of rows sorted by blocks, the listed block's before those that are compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> list[tuple[int, int]]:
            first = sum(not r[1] for r in held)
            if not 0 < first < len(held):
                return []
            return link([r[0] for r in held], [np.frombuffer(r[3], dtype="<u8") for r in held], [r[2] for r in held], first, percent)

        for batch in batches:
            made = []
            for *new, row, compared, part, data in zip(*(batch.column(c).to_pylist() for c in ("family", "d", "a", "row", "compared", "part", "shingles")), strict=True):
                if new != key:
                    made += out()
                    key, held = new, []
                held.append((row, compared, part, data))
            if made:
                yield _edges(made)
        if made := out():
            yield _edges(made)

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size) for t in bytes_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["row", "n", "shingles"]
            )

    return run


def links_of(ties: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """row and root of the connected parts of exact links among the families of `ties` (row, hub), a table scan."""
    tied = saved(ties.select("row").union(ties.select("hub")).distinct(), "tied")
    sets = saved(docs.select("row", "text").join(tied, "row", "left_semi").mapInArrow(_full_sets(size), "row long, n long, shingles binary"), "sets")
    hubs = saved(ties.groupBy("hub").agg(F.ceil(F.count("*") / TIES).cast("int").alias("parts")), "hubs")
    members = lookup_join(ties, hubs, ["hub"], "inner").select("hub", F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part"), F.lit(True).alias("member"), "row")
    heads = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), F.col("hub").alias("row"))
    dealt = members.union(heads).join(sets.select("row", "shingles"), "row").repartition("hub", "part").sortWithinPartitions("hub", "part", "member", "row")
    links = Table(dealt.mapInArrow(_with_hub(percent), "row long, hub long"), "links")
    linked = components(links.df)
    links.drop()

    families = components(ties).withColumnRenamed("root", "family")
    placed = saved(families.join(linked, "row", "left").select("row", "family", F.coalesce("root", "row").alias("part")), "families")
    parts = placed.groupBy("family", "part").agg(F.count("*").alias("c")).groupBy("family")
    parts = parts.agg(F.max_by("part", F.struct("c", -F.col("part"))).alias("largest"), F.count("*").alias("n_parts")).where("n_parts > 1").drop("n_parts")
    still = lookup_join(placed, saved(parts, "open"), ["family"], "inner").withColumn("rest", F.col("part") != F.col("largest")).drop("largest")
    still = Table(still.join(sets, "row"), "open-sets")
    if still.df.isEmpty():
        return linked
    parts_of = lambda total, size: F.ceil(total / F.lit(size)).cast("int")
    blocks = lambda of, k: F.greatest(parts_of(k * F.sum(F.when(of, F.col("n"))), BLOCK_SHINGLES), parts_of(k * F.count(F.when(of, 1)), BLOCK_DOCUMENTS))
    counted = saved(still.df.groupBy("family").agg(blocks(F.col("rest"), 1).alias("n_d"), blocks(F.lit(True), FINER).alias("n_a")), "blocks")
    own = lookup_join(still.df, counted, ["family"], "inner")
    block = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    listed = own.select("family", every("n_d").alias("d"), block("n_a").alias("a"), "row", F.lit(False).alias("compared"), "part", "shingles")
    compared = own.where("rest").select("family", block("n_d").alias("d"), every("n_a").alias("a"), "row", F.lit(True).alias("compared"), "part", "shingles")
    met = listed.union(compared).repartition("family", "d", "a").sortWithinPartitions("family", "d", "a", "compared", "row")
    further = saved(met.mapInArrow(_verify(percent), "row long, hub long"), "links")
    still.drop()
    if further.isEmpty():
        return linked
    return components(further.union(linked.select("row", F.col("root").alias("hub"))))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """row, root, doc_id, n_shingles and component_id for every row of `docs`, which has to be a table scan.

    A null text, or one without words, has no shingles and is linked with nothing. component_id is
    the smallest doc_id of the rows that a row is connected with, itself included; null ids are
    not smaller than any, and repeated rows are in one component. Ids may be null or repeated, so only
    root, a row of the component, tells components apart. An empty table gives no
    rows. Only doc_id and text are read, `row` numbers the rows as with_row_id() does.
    """
    docs = with_row_id(docs, "row", ["doc_id", "text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = saved(
        docs.mapInArrow(_sign(size, percent), f"row long, doc_id {kind}, n_shingles long, mark binary, first array<long>, second array<long>, sketch binary"), "signatures"
    )
    marks = saved(signed.where("mark is not null").groupBy("mark").agg(F.min("row").alias("rep")), "marks")
    reps = signed.join(marks.select(F.col("rep").alias("row")), "row", "left_semi")
    tables = F.flatten(F.transform("first", lambda a: F.transform("second", lambda b: F.xxhash64(a, b))))
    keyed = reps.select("row", F.explode(tables).alias("key"))
    tied = keyed.withColumn("hub", F.min("row").over(Window.partitionBy("key").orderBy("row"))).where("hub <> row").select("row", "hub").distinct()
    sketches = signed.select("row", "sketch")
    near = tied.join(sketches, "row").join(sketches.select(F.col("row").alias("hub"), F.col("sketch").alias("hub_sketch")), "hub")
    family = max(0.0, min(FAMILY, percent / 100 - BELOW))
    ties = saved(near.select("row", "hub", "sketch", "hub_sketch").mapInArrow(_alike(family), "row long, hub long"), "ties")
    linked = links_of(ties, docs, size, percent)

    # tables of one row a key are written first, so that a hot key's rows can be dealt to several tasks
    joined = marks.join(linked.withColumnRenamed("row", "rep"), "rep", "left").select("mark", F.coalesce("root", "rep").alias("root"))
    rooted = signed.select("row", "doc_id", "n_shingles", "mark").join(saved(joined, "roots"), "mark", "left").withColumn("root", F.coalesce("root", "row"))
    rooted = saved(rooted.select("row", "doc_id", "n_shingles", "root"), "rooted")
    smallest = saved(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    return rooted.join(smallest, "root").select("row", "root", "doc_id", "n_shingles", "component_id")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
