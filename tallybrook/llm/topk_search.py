"""Operator 9: exact top-k by inner product: tiles of queries and shards, partial selection, tree merge.

Candidate vectors are packed into blocks and dealt to shards of bounded size; blocks of queries go to
every shard. A task holds one shard, multiplies a block of queries by a tile of candidates at a
time and keeps the best k of each tile; vectors are sent in the smallest kind of
number that holds them; tiles are merged within the shard, and shards in groups of
``FAN_IN``, so what is merged at once stays bounded.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a shard at most, and bytes of its vectors as they are sent; each query block goes to every shard.
SHARD_ROWS, SHARD_BYTES = 262_144, 1 << 26
BLOCK_ROWS = 4_096
QUERY_ROWS = 512
TILE = 8_192
FAN_IN = 16
EXACT, EXACT_SINGLE = float(1 << 53), float(1 << 24)


#: Kinds of numbers that blocks are sent in, and the largest that each holds.
KINDS = (("<i1", 127.0), ("<i2", 32_767.0), ("<f8", np.inf))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in the smallest kind that holds them, with its place in KINDS first."""
    largest = np.abs(values).max(initial=0)
    at = next(i for i, (_, most) in enumerate(KINDS) if largest <= most)
    return bytes([at]) + values.astype(KINDS[at][0]).tobytes()


def _unpacked(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype=KINDS[data[0]][0], offset=1).reshape(rows, dim)


def _blocks(rows_a_block: int):
    """Packs rows of id and values into blocks of vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = defaultdict(list)

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            rows = held.pop(dim)
            made += 1
            ids = np.asarray([r[0] for r in rows], dtype="<i8").tobytes()
            values = _packed(np.floor(64.0 * np.asarray([r[1] for r in rows], dtype="<f8").reshape(len(rows), dim)))
            return pa.RecordBatch.from_pydict(
                {"task": pa.array([task], pa.int64()), "block": pa.array([made], pa.int64()), "dim": pa.array([dim], pa.int32()), "ids": pa.array([ids], pa.binary()), "vectors": pa.array([values], pa.binary())}
            )

        for batch in batches:
            for row in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                own = held[len(row[1])]
                own.append(row)
                if len(own) == rows_a_block:
                    yield block(len(row[1]))
        for dim in sorted(held):
            yield block(dim)

    return run


BLOCK = "task long, block long, dim int, ids binary, vectors binary"


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among (row, id, score): higher scores, then smaller ids."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = rank < k
    return rows[keep], ids[keep], scores[keep]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in single or double precision where all sums are exact in it, beyond
    with Python's integers, where a score beyond 64 bits becomes the nearest 64-bit one."""
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if bound < EXACT:
        kind = np.float32 if bound < EXACT_SINGLE else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    whole = lambda x: np.asarray([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


def _shard_tops(queries: tuple[np.ndarray, np.ndarray], shard: tuple[np.ndarray, np.ndarray], k: int):
    q_ids, q = queries
    ids, vectors = shard
    lists = []
    for at in range(0, len(ids), TILE):
        tile = ids[at : at + TILE]
        scores = _products(q, vectors[at : at + TILE])
        own = tile[None, :] == q_ids[:, None]
        scores[own] = np.iinfo(np.int64).min
        if len(tile) > k:
            least = np.partition(scores, len(tile) - k, axis=1)[:, len(tile) - k]
            chosen = (scores >= least[:, None]) & ~own
        else:
            chosen = ~own
        rows, columns = np.nonzero(chosen)
        lists.append(_best(rows, tile[columns], scores[rows, columns], k))
    return _best(*(np.concatenate(x) for x in zip(*lists, strict=True)), k)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, ready = None, defaultdict(list), {}
        for batch in batches:
            for shard, is_query, task, block, dim, ids, vectors in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if shard != current:
                    current, held, ready = shard, defaultdict(list), {}
                own = np.frombuffer(ids, dtype="<i8")
                own = own, _unpacked(vectors, len(own), dim)
                if not is_query:
                    held[dim].append(own)
                    continue
                if dim not in ready:
                    if dim not in held:
                        continue
                    ready[dim] = tuple(np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
                rows, found, scores = _shard_tops(own, ready[dim], k)
                # a query is known by its block and its place there, so that repeated ids stay apart
                yield pa.RecordBatch.from_pydict(
                    {
                        "task": pa.array([task] * len(rows), pa.int64()), "block": pa.array([block] * len(rows), pa.int64()), "place": pa.array(rows.astype(np.int32)),
                        "shard": pa.array([shard] * len(rows), pa.int32()), "query_id": pa.array(own[0][rows]), "vec_id": pa.array(found), "score": pa.array(scores),
                    }
                )

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query.

    Queries are the rows whose vec_id is divisible by `every`. Vectors that are null or hold null or
    non-finite components, and rows with a null id, take no part; only vectors of a query's own
    dimension are its candidates (an empty vector scores 0 with other empty ones). Rows with the query's
    own id are no candidates; repeated rows are queries and candidates each for itself. Ties go to
    the smaller vec_id. An empty table gives no rows. Other columns are not read.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    n, dim = usable.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    shard_rows = max(1, min(shard_rows, SHARD_BYTES // (2 * max(1, dim))))
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // shard_rows), min(2 * parallel, -(-n // BLOCK_ROWS)))
    rows_a_block = max(1, min(BLOCK_ROWS, -(-n // (4 * shards))))
    shard_of = F.pmod(F.xxhash64("task", "block"), F.lit(shards)).cast("int")
    candidates = usable.mapInArrow(_blocks(rows_a_block), BLOCK).select(shard_of.alias("shard"), F.lit(False).alias("is_query"), "*")
    queries = usable.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(_blocks(QUERY_ROWS), BLOCK)
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_query"), "*")
    dealt = candidates.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "is_query", "task", "block")
    tops = dealt.mapInArrow(_search(k), "task long, block long, place int, shard int, query_id long, vec_id long, score long")
    query = ["task", "block", "place"]
    best = [F.desc("score"), F.asc("vec_id")]
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        tops = tops.withColumn("shard", (F.col("shard") / FAN_IN).cast("int"))
        tops = tops.withColumn("rank", F.row_number().over(Window.partitionBy(*query, "shard").orderBy(*best))).where(F.col("rank") <= k).drop("rank")
    ranked = tops.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(*best))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
