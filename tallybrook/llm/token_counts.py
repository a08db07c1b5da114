"""Operator 4: token counts by a map-side two-tier lookup, without any shuffle of pre-tokens.

Tier one is a compact table of the lengths, in tokens, of the corpus's frequent pre-tokens.
Each task keeps a bounded heavy-hitter summary (Misra and Gries) of the pre-tokens it reads;
only these summaries, one row a task, are merged, so no pre-token is ever a shuffle key. The
table has at most ``table_size`` entries of at most ``MAX_PIECE`` characters, which bounds what
is broadcast. Tier two is a cache in each Python worker: a miss is encoded once and kept, and
the cache is emptied when it reaches its size. The table never decides a count, only its speed.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import pretokens
from tallybrook.llm.common import documents, saved, texts_of, tokenizer_path

MAX_PIECE = 32
SUMMARY_SIZE = 16_384
TABLE_SIZE = 32_768
CACHE_SIZE = 400_000


def shrink(counts: Counter, size: int) -> Counter:
    """Misra-Gries: keep the `size` largest counts, less the next one, which bounds the error."""
    if len(counts) <= size:
        return counts
    ordered = counts.most_common(size + 1)
    floor = ordered[-1][1]
    return Counter({k: n - floor for k, n in ordered[:-1] if n > floor})


def pieces_of(text: str) -> list[str]:
    """What is looked up: pre-tokens, or in texts with characters from U+0100 on, where the engines' tables
    of letters may differ, the chunks that are apart in all of them."""
    return pretokens.latin_split(text) if pretokens.is_latin(text) else pretokens.chunks(text)


def _summaries(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch):
                counts.update(pieces_of(text))
                if len(counts) > 16 * size:
                    counts = shrink(counts, size)
        short = Counter({k: n for k, n in shrink(counts, size).items() if n > 1 and len(k) <= MAX_PIECE})
        yield pa.RecordBatch.from_pydict({"summary": pa.array([pickle.dumps(dict(short))], pa.binary())})

    return run


def _merge(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in batch.column("summary").to_pylist():
                counts.update(pickle.loads(part))
                counts = shrink(counts, size)
        yield pa.RecordBatch.from_pydict({"summary": pa.array([pickle.dumps(dict(counts))], pa.binary())})

    return run


def frequent_pretokens(docs: DataFrame, summary_size: int = SUMMARY_SIZE, table_size: int = TABLE_SIZE) -> list[str]:
    """The heavy hitters among all pre-tokens, most frequent first; at most `table_size`."""
    parts = saved(docs.select("text").mapInArrow(_summaries(summary_size), "summary binary"), "pretoken-summaries")
    width = max(1, round(parts.rdd.getNumPartitions() ** 0.5))
    merged = parts.repartition(width).mapInArrow(_merge(table_size), "summary binary")
    merged = merged.repartition(1).mapInArrow(_merge(table_size), "summary binary")
    found: Counter = Counter()
    for row in merged.collect():  # one row of at most table_size entries
        found.update(pickle.loads(row.summary))
    return [k for k, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:table_size]]


class TokenLengths(dict):
    """Pre-token to its number of tokens: the broadcast tier, then the worker's own cache."""

    def __init__(self, path: str, frequent: list[str], cache_size: int = CACHE_SIZE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache_size, self.model = cache_size, self.tokenizer.model
        self.first = {p: self._length(p) for p in frequent}
        super().__init__(self.first)

    def _length(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> int:
        # a pre-token needs the vocabulary's model alone; what a chunk is made of the library decides
        single = pretokens.is_latin(piece) and len(pretokens.latin_split(piece)) == 1
        n = len(self.model.tokenize(pretokens.as_letters(piece))) if single else self._length(piece)
        if len(piece) <= 4 * MAX_PIECE:
            if len(self) >= len(self.first) + self.cache_size:
                self.clear()
                self.update(self.first)
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        """Texts with special strings go to the library as a whole; all others through both tiers."""
        if any(s in text for s in self.special):
            return self._length(text)
        return sum(map(self.__getitem__, pieces_of(text)))


_loaded: dict = {}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, summary_size: int = SUMMARY_SIZE, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of `docs`.

    Null and empty texts count 0 tokens; ids may be null or repeated, and each row is counted
    for itself. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    frequent = frequent_pretokens(docs, summary_size, table_size)
    sent = spark.sparkContext.broadcast("\n".join(f.encode("unicode_escape").decode() for f in frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, sent.id if hasattr(sent, "id") else 0, len(sent.value))
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = TokenLengths(path, [x.encode().decode("unicode_escape") for x in sent.value.split("\n") if x])
        lengths = _loaded[key]
        for batch in batches:
            n = [lengths.count(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = sized.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
