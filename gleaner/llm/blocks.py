"""Corpus-wide values of keys brought to the documents that hold them.

A task gives its documents, one after another, to blocks, and each block has a dictionary: the distinct keys of its documents and
how often they occur. Dictionaries, not occurrences, are shuffled: they are summed over the corpus, whatever is made of the
sums comes back to every block that has the key, and the block's documents follow it through one task, one batch at a time.
A block ends when its dictionary has `most` keys, so a task's memory holds that many, however hot a key or long a corpus.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, staged

DOCS = 99  # kind of the rows that are documents; dictionaries have smaller kinds and come first
MOST = 1 << 20
SCAN = 48 << 20  # bytes of input for a task, if there are more than tasks need: the more text a dictionary serves, the fewer keys there are in all
PART = 1 << 20  # characters of text looked at together


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their n."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(n[order], starts) if len(keys) else n


class Sums:
    """Running sums by key; what is new waits until it is as much as what is held."""

    def __init__(self):
        self.keys, self.n, self.waiting, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((keys, n))
        self.size += len(keys)
        if self.size > max(len(self.keys), 1 << 16):
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            keys, n = zip((self.keys, self.n), *self.waiting, strict=True)
            self.keys, self.n = summed(np.concatenate(keys), np.concatenate(n))
            self.waiting, self.size = [], 0


class Places:
    """Where keys stand in an array of distinct keys, by a hash table with a sorted rest; -1 if nowhere."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(10, (2 * max(len(keys), 1)).bit_length()))
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        slots = self._slots(keys)
        self.table[slots] = np.arange(len(keys))
        rest = np.flatnonzero(self.table[slots] != np.arange(len(keys)))
        self.rest = rest[np.argsort(keys[rest])]
        self.rest_keys = keys[self.rest]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self.table[self._slots(keys)].astype(np.int64)
        missed = np.flatnonzero((at < 0) | (self.keys[at] != keys))
        at[missed] = -1
        if len(self.rest) and len(missed):
            i = np.minimum(np.searchsorted(self.rest_keys, keys[missed]), len(self.rest) - 1)
            found = self.rest_keys[i] == keys[missed]
            at[missed[found]] = self.rest[i[found]]
        return at


def parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch whose texts have about PART bytes together, or one row of more."""
    sizes = pc.binary_length(b.column("text")).to_numpy()
    upto, first = np.cumsum(sizes), 0
    while first < len(sizes):
        after = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PART, "right")))
        yield b.slice(first, after - first)
        first = after


def packed(rows: pa.RecordBatch) -> bytes:
    """Rows as Arrow's own format, compressed: texts are shuffled as small as they are stored."""
    out = io.BytesIO()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(rows)
    return out.getvalue()


def unpacked(data: bytes) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(data)


def _cut(count: Callable, most: int):
    names = ["block", "kind", "key", "n", "packed"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, dictionaries = TaskContext.get().partitionId() << 32, {}

        def ended() -> Iterator[pa.RecordBatch]:
            for kind, held in dictionaries.items():
                held.settle()
                for i in range(0, len(held.keys), 50_000):
                    keys, n = held.keys[i : i + 50_000], held.n[i : i + 50_000]
                    k = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.array(np.full(k, kind, np.int32)), pa.array(keys), pa.array(n), pa.nulls(k, pa.binary())], names=names)
            dictionaries.clear()

        for b in batches:
            for part in parts(b):
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([DOCS], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([packed(part)])], names=names)
                for kind, keys, n in count(part.column("text").to_pylist(), part.column("flag").to_numpy(zero_copy_only=False)):
                    dictionaries.setdefault(kind, Sums()).add(keys, n)
            if max((len(d.keys) for d in dictionaries.values()), default=0) >= most:
                yield from ended()
                block += 1
        yield from ended()

    return cut


def in_blocks(docs: DataFrame, count: Callable, flag: Column, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """The documents, some in a row (see packed), with the numbers of their blocks, and the blocks' dictionaries: (block, kind, key, n, packed), staged.

    count(texts, flags) gives (kind, keys, n) of a batch of documents, keys distinct or not; a key of n 0 is in the dictionary too.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), flag.alias("flag"))
    return staged(docs.mapInArrow(_cut(count, most), "block long, kind int, key long, n long, packed binary"), "blocks", SCAN)


def totals(blocks: DataFrame, kind: int) -> DataFrame:
    """(key, n) of one kind, summed over all blocks."""
    return blocks.where(F.col("kind") == kind).groupBy("key").agg(F.sum("n").alias("n"))


def _stream(columns: list[str], prepare: Callable, use: Callable):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, held = None, {}, None
        for b in batches:
            number, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi == lo:
                    continue
                if number[lo] != block:
                    block, waiting, held = number[lo], {}, None
                rows = b.slice(lo, hi - lo)
                if kind[lo] != DOCS:
                    waiting.setdefault(int(kind[lo]), []).append([rows.column(c).to_numpy() for c in columns])
                    continue
                if held is None:  # the dictionary is whole once documents come
                    held = {k: prepare(*(np.concatenate(x) for x in zip(*pieces, strict=True))) for k, pieces in waiting.items()}
                    waiting = {}
                yield from use(held, rows)

    return stream


def with_values(blocks: DataFrame, values: DataFrame, prepare: Callable, use: Callable, schema: str, words: tuple[str, ...] = ("key",), docs: tuple[str, ...] = ("packed",)) -> DataFrame:
    """What use(dictionaries, documents) gives for every batch of documents, staged.

    values: (kind, key, and further columns, one row a key). dictionaries[kind] is prepare(columns of `words`, then of the values) of the
    whole dictionary of the batch's block; the documents have the columns `docs`.
    """
    spark = blocks.sparkSession
    names = [*words, *(c for c in values.columns if c not in ("kind", "key"))]
    found = blocks.where(F.col("kind") != DOCS).select("block", "kind", *dict.fromkeys(["key", *words])).join(values.hint("merge"), ["kind", "key"]).select("block", "kind", *names)
    both = found.unionByName(blocks.where(F.col("kind") == DOCS).select("block", "kind", *docs), allowMissingColumns=True)
    both = both.repartition(shuffle_parts(spark), "block").sortWithinPartitions("block", "kind")
    return staged(both.mapInArrow(_stream(names, prepare, use), schema), "valued")
