"""Operator 7: byte-level BPE as a lazily determinised finite-state transducer.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours are: the
pair's own encoding is that pair. So the encodings of all prefixes of an input form a
nondeterministic transducer: an item is (tokens not yet emitted, last token, trie node of the
bytes read since). Reading a byte moves each item down the trie; an item that reaches a token
compatible with its last one also starts a new item at the root. A deterministic state is the
set of live items after their common first tokens have been emitted, which bounds the
lookahead by the longest token. States and transitions are made when first met and kept in a
table that is emptied at a fixed size. Decoding joins token bytes and follows a UTF-8 state
machine token by token, so that it can stop at any id and go on later.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallybrook.llm import pretokens
from tallybrook.llm.common import documents, texts_of, tokenizer_path

TRANSITIONS = 300_000
PAIRS = 500_000
CACHE_SIZE = 400_000
ROOT = 0
#: Above every rank.
NEVER = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes pre-tokens. ``encode`` is the transducer's whole output for one input."""

    def __init__(self, ranks: dict[bytes, int], transitions: int = TRANSITIONS):
        self.ranks, self.limit = ranks, transitions
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                found = self.children[node].get(byte)
                if found is None:
                    found = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = found
            self.token_at[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.histories: dict[int, tuple[list[int], list[bytes], list[bytes]]] = {}
        self._reset()

    def _reset(self) -> None:
        self.start = (((), -1, ROOT),)
        self.states: dict[tuple, int] = {self.start: 0}
        self.items: list[tuple] = [self.start]
        self.finals: list[tuple | None] = [()]
        self.steps: dict[int, tuple[tuple[int, ...], int]] = {}

    def history(self, token: int) -> tuple[list[int], list[bytes], list[bytes]]:
        """How a token's own bytes merge: the ranks in their order, and its first and last part
        before each merge and at the end."""
        known = self.histories.get(token)
        if known is None:
            data, ranks = self.bytes_of[token], self.ranks
            parts = [data[i : i + 1] for i in range(len(data))]
            order, first, last = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                rank, at = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if rank == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                order.append(rank)
                first.append(parts[0])
                last.append(parts[-1])
            order.append(NEVER)
            known = self.histories[token] = order, first, last
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their bytes are merged side by side: of the next merge
        within a, the one across the border and the next within b, the lowest rank comes first,
        and of equal ones the leftmost."""
        if a < 0:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            (left, _, ends), (right, starts, _) = self.history(a), self.history(b)
            i = j = 0
            ranks = self.ranks
            while True:
                across, x, y = ranks.get(ends[i] + starts[j], NEVER), left[i], right[j]
                if x <= across and x <= y:
                    if x == NEVER:
                        known = True
                        break
                    i += 1
                elif across <= y:
                    known = False
                    break
                else:
                    j += 1
            self.pairs[a, b] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        live, final = [], None
        children, token_at, pairs = self.children, self.token_at, self.pairs
        for out, last, node in self.items[state]:
            below = children[node].get(byte)
            if below is None:
                continue
            if children[below]:
                live.append((out, last, below))
            token = token_at[below]
            if token >= 0 and final is None:
                fits = pairs.get((last, token))
                if self.compatible(last, token) if fits is None else fits:
                    final = (*out, token)
        if final is None:
            raise ValueError("the vocabulary has no token for some byte")
        live.append((final, final[-1], ROOT))
        common, first = 0, live[0][0]
        for token in first:
            if any(out[common : common + 1] != (token,) for out, _, _ in live):
                break
            common += 1
        emitted = final[:common]
        # the items differ in depth and the deepest comes first, so equal sets are equal tuples
        items = tuple((out[common:], last, node) for out, last, node in live) if common else tuple(live)
        if len(self.steps) >= self.limit:
            self._reset()
        number = self.states.get(items)
        if number is None:
            number = self.states[items] = len(self.items)
            self.items.append(items)
            self.finals.append(final[common:])
        return emitted, number

    def encode(self, data: bytes) -> list[int]:
        ids: list[int] = []
        state = 0
        steps = self.steps
        for byte in data:
            done = steps.get(state << 8 | byte)
            if done is None:
                tables = self.items
                done = self._step(state, byte)
                if self.items is tables:
                    steps[state << 8 | byte] = done
                else:
                    steps = self.steps
            if done[0]:
                ids.extend(done[0])
            state = done[1]
        ids.extend(self.finals[state])
        return ids


class StreamDecoder:
    """Decodes ids in any portions. ``feed`` gives the text of the whole characters read so far;
    an incremental UTF-8 state machine holds an unfinished one back. ``finish`` gives the rest.
    Malformed bytes come out as lone surrogates, from which ``to_bytes`` gets them back unchanged."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("surrogateescape")

    def feed(self, ids: list[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


def to_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec(dict):
    """Pre-token to its ids as little-endian 32-bit numbers; misses run through the transducer."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        super().__init__()
        self.transducer, self.cache_size = Transducer(read_ranks(path)), cache_size
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece) or pack(self.transducer.encode(piece.encode()))
        if len(piece) <= 64:
            if len(self) >= self.cache_size:  # two generations: what is used again moves on
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, pretokens.split(text)))

    def decoder(self) -> StreamDecoder:
        return StreamDecoder(self.transducer.bytes_of)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of long) of every row; null texts are encoded as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [np.frombuffer(own.encode(t), dtype="<u4").astype(np.int64) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text and valid of rows of doc_id and ids; null ids are decoded as none. Malformed
    UTF-8 is replaced by U+FFFD in text and marked in valid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts, valid = [], []
            for ids in batch.column("ids").to_pylist():
                decoder = own.decoder()
                data = to_bytes(decoder.feed(ids or []) + decoder.finish())
                texts.append(data.decode("utf-8", "replace"))
                valid.append("\ufffd" not in texts[-1] or texts[-1].encode() == data)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(valid)], ["doc_id", "text", "valid"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string, valid boolean")


#: Ids that are decoded at a time.
PORTION = 1 << 16


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes, for every row of
    `docs`. Null texts count as empty; each row is treated for itself, so ids may be null or repeated.
    The ids of a text never leave its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            n, ids_sum, text_sum = [], [], []
            for text in texts_of(batch):
                data = own.encode(text)
                ids = np.frombuffer(data, dtype="<u4")
                decoder, digest = own.decoder(), hashlib.sha256()
                for at in range(0, len(ids), PORTION):
                    digest.update(to_bytes(decoder.feed(ids[at : at + PORTION].tolist())))
                digest.update(to_bytes(decoder.finish()))
                n.append(len(ids))
                ids_sum.append(hashlib.sha256(data).hexdigest())
                text_sum.append(digest.hexdigest())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sum, pa.string()), pa.array(text_sum, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"))
