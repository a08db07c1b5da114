"""Shared plumbing of the corpus operators: scratch tables, row ids, Arrow helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the corpus contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Largest lookup table, in rows, that is sent to every executor. Each table is counted first;
#: larger ones are joined by a salted shuffle instead.
BROADCAST_ROWS = 10_000
SALTS = 32

#: Files that rows are numbered by; their table is broadcast, 16 bytes a file. Tables of more files are written again first.
FILES = 100_000
ROWS_A_FILE = 1 << 40


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written tables: ``spark.checkpoint.dir``. A temporary one is made where it is unset and
    everything runs in one process; on a cluster no machine would see what another wrote there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tallybrook-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: The session, the path and the writing thread of each table that is still there.
_written: list[tuple[weakref.ref, str, int]] = []


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table through Hadoop's file system, so that any store works."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all() -> None:
    for ref, path, _ in _written:
        spark = ref()
        try:
            if spark is not None and spark._jvm is not None:
                drop_path(spark, path)
        except Exception:  # the session may have ended already
            return


atexit.register(_drop_all)


class Table:
    """A DataFrame written to the shared folder and read again: its lineage is one scan.

    It survives the loss of executors, since the files are in shared storage. ``drop`` deletes
    it as soon as nothing reads it any more; the rest goes when the driver ends.
    """

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.spark = spark
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        _written.append((weakref.ref(spark), self.path, threading.get_ident()))

    def drop(self) -> None:
        drop_path(self.spark, self.path)
        _written[:] = [x for x in _written if x[1] != self.path]


def saved(df: DataFrame, name: str) -> DataFrame:
    return Table(df, name).df


def settled(make: Callable[[], DataFrame], name: str) -> Table:
    """The table of what `make` returns, without those that were written on the way to it, by this thread."""
    before = {path for _, path, _ in _written}
    table = Table(make(), name)
    for ref, path, thread in list(_written):
        if path not in before and path != table.path and thread == threading.get_ident():
            drop_path(ref(), path)
            _written.remove((ref, path, thread))
    return table


def with_row_id(df: DataFrame, name: str = "_row", columns: list[str] | None = None) -> DataFrame:
    """The columns (all, if none are named) and a number for each row: its file's place among the table's files, and its place in the file.

    It is the same in every read, however the files are split. That needs a scan of Parquet files, at most ``FILES``;
    anything else is written once, and read from there."""
    meta, own = None, [F.col(f"`{c}`") for c in (df.columns if columns is None else columns)]
    if len(df.inputFiles()) <= FILES:
        try:
            meta = df.metadataColumn("_metadata")
            df.select(meta["row_index"])
        except AnalysisException:  # no scan, or of files that do not number their rows
            meta = None
    if meta is None:
        table = saved(df.select(*own), "numbered")
        # a table's files are named by the task that wrote them; each wrote one
        part = F.regexp_extract(table.metadataColumn("_metadata")["file_name"], "part-([0-9]+)-", 1).cast("long")
        return table.select(*own, (part * ROWS_A_FILE + table.metadataColumn("_metadata")["row_index"]).alias(name))
    seen = df.select(*own, F.xxhash64(meta["file_path"]).alias("_path"), meta["row_index"].alias("_index"))
    # one row for each of at most FILES files, of which only the number of rows is read here
    found = sorted(r.f for r in df.select(meta["file_path"].alias("f")).distinct().collect())
    files = df.sparkSession.createDataFrame(list(enumerate(found)), "_file long, path string").select("_file", F.xxhash64("path").alias("_path"))
    joined = seen.join(F.broadcast(files), "_path")
    return joined.select(*own, (F.col("_file") * ROWS_A_FILE + F.col("_index")).alias(name))


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join to a table with one row a key. It is broadcast only after its rows have been counted
    to be within ``limit``; a larger one is repeated per salt and joined by a shuffle in which
    a hot key is spread over ``SALTS`` tasks. `big` is read from a table, so that a task that is run again salts its rows alike."""
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), keys, how)
    salted = big.withColumn("_salt", (F.rand(7) * SALTS).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as 1, so they are in no held-out part of these contracts' (0 or 2)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(1))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null ones as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8, without decoding; null ones as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def tokenizer_dir() -> str:
    """Where the vocabulary files of public tokenizers are: TOKENIZER_DIR, or the installed package's folder."""
    if found := os.environ.get("TOKENIZER_DIR"):
        return found
    import public_tokenizers

    return os.path.dirname(public_tokenizers.__file__)


def tokenizer_path(name: str) -> str:
    return os.path.join(tokenizer_dir(), name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _sums(of):
    """One row a task: the sum of what `of` makes of its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(batch)
                total = part if total is None else total + part
        made = [] if total is None else [np.asarray(total, dtype="<f8").tobytes()]
        yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()] * len(made), pa.int32()), "sums": pa.array(made, pa.binary())})

    return run


def tree_sum(df: DataFrame, of, size: int, width: int = 32) -> np.ndarray:
    """The sum over all rows, added up by tasks, then by `width` tasks, and last on the driver, each in the order of tasks."""
    again = _sums(lambda batch: sum(np.frombuffer(x, dtype="<f8") for x in batch.column("sums").to_pylist()))
    parts = df.mapInArrow(_sums(of), "task int, sums binary").repartition(width, F.col("task") % width).sortWithinPartitions("task").mapInArrow(again, "task int, sums binary")
    return sum((np.frombuffer(r.sums, dtype="<f8") for r in sorted(parts.collect(), key=lambda r: r.task)), np.zeros(size))
