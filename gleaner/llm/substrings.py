"""Removal of repeated passages of words by difference-cover anchors (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Windows, WordHashes, covered, kept_in_worker, mix64, staged, with_partner

# Perfect difference sets. Any two residues can be shifted by one amount so that both lie in the set.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


class Anchors:
    """Hashes of the words of a text, of its windows, and of the shorter windows that begin at cover positions.

    A match of `length` words at i in one text and j in another has a shift s < period with i + s and j + s both at
    cover positions, and an anchor of length - period + 1 words at that shift lies inside the match in both.
    """

    def __init__(self, length: int):
        self.length = length
        self.period = max((p for p in COVERS if p <= length // 2), default=1)
        cover = np.zeros(self.period, bool)
        cover[list(COVERS.get(self.period, (0,)))] = True
        self.cover = cover
        self.anchor = length - self.period + 1
        self.one = WordHashes(1)
        self.short, self.long, self.again = Windows(0x9E3779B97F4A7C15), Windows(0xC2B2AE3D27D4EB4F), Windows(0xA0761D6478BD642F)

    def at(self, n: int) -> np.ndarray:
        """Cover positions at which an anchor fits into n words."""
        i = np.arange(max(0, n - self.anchor + 1))
        return i[self.cover[i % self.period]]

    def anchors(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes."""
        if len(words) < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self.at(len(words))
        return at, self.short.of(self.one.of(words), self.anchor)[at].view(np.int64)

    def extend(self, words: list[bytes], shared: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and 128-bit hashes of the windows that hold a shared anchor."""
        at, h = self.anchors(words)
        at = at[np.isin(h, np.fromiter(shared, np.int64, len(shared)))]
        windows = max(0, len(words) - self.length + 1)
        first = np.maximum(at - (self.length - self.anchor), 0)
        edges = np.zeros(windows + 1, np.int32)
        inside = first < windows
        np.add.at(edges, first[inside], 1)
        np.add.at(edges, np.minimum(at[inside] + 1, windows), -1)
        starts = np.flatnonzero(np.cumsum(edges[:windows]) > 0)
        one = self.one.of(words)
        two = mix64(one ^ np.uint64(0x9FB21C651E98DF25))
        return starts, self.long.of(one, self.length)[starts].view(np.int64), self.again.of(two, self.length)[starts].view(np.int64)


def _of_worker(length: int) -> Anchors:
    return kept_in_worker(("anchors", length), lambda: Anchors(length))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for b in batches:
        counts, digests = [], []
        for text in b.column("text").to_pylist():
            words = text.split()
            counts.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).digest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_key"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary())],
            names=["doc_id", "text_key", "n_words", "sha"],
        )


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _of_worker(length)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                hashes = [np.unique(a.anchors((t or b"").split())[1]) for t in part.column("text").to_pylist()]
                counts = np.array([len(h) for h in hashes])
                docs = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(hashes)), counts)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes), pa.int64()), docs], names=["anchor", "doc_id"])

    return run


def _window_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _of_worker(length)
        for b in batches:
            for doc, key, text, shared in zip(*(b.column(c) for c in ("doc_id", "text_key")), b.column("text").to_pylist(), b.column("shared").to_pylist(), strict=True):
                starts, h1, h2 = a.extend(text.split(), set(shared))
                n = len(starts)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.repeat(doc, n), pa.repeat(key, n), pa.array(starts, pa.int32())], names=["h1", "h2", "doc_id", "text_key", "start"])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            removed, digests, texts = [], [], []
            for text, starts in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), strict=True):
                words = text.split()
                gone = covered(np.array(starts, np.int64), length, len(words))
                texts.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(texts[-1]).digest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(removed, pa.int64()), pa.array(digests, pa.binary()), pa.array([t.decode() for t in texts], pa.string())],
                names=["c_id", "c_key", "c_removed", "c_sha", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each word that lies in a window of `length` words that also starts in a document of smaller id.

    Documents of one word sequence keep the words of the least id only (if they hold a window at all); the others need
    no more work. Anchors are hashed at cover positions only, once a document, and kept where another document has
    them. The windows around those are then hashed whole (128 bits) and kept where a smaller id has them. Both are semi
    joins of a table with itself: one shuffle each, and a row looks no further than its first partner.

    Words are runs of other than ASCII white space, unchanged. Documents with fewer words lose none. Null text has no
    words. Rows of one id never remove from each other; a null id loses and removes nothing; repeated rows give
    repeated results; an empty table gives no rows. Other columns are ignored.

    Returns doc_id, n_words, n_removed, kept_sha256; with_text adds kept, the kept words of documents that lose some but not all.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = plain.schema["doc_id"].dataType.simpleString()
    every = staged(plain.mapInArrow(_digest, f"doc_id {kind}, text_key long, n_words long, sha binary"), "words")
    firsts = staged(every.where(F.col("doc_id").isNotNull()).groupBy(F.col("sha").alias("f_sha")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "firsts")  # a table of its own, so that the join can split a hot key
    every = every.join(firsts, F.col("sha") == F.col("f_sha"), "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_words") >= length))
    every = every.select("doc_id", "text_key", "n_words", "sha", "copy")

    known = plain.where(F.col("doc_id").isNotNull())
    anchors = known.select("doc_id", "text").mapInArrow(_anchor_rows(length), f"anchor long, doc_id {kind}")
    shared = with_partner(anchors, ["anchor"], F.col("other.doc_id") != F.col("mine.doc_id"))
    shared = shared.groupBy(F.col("doc_id").alias("s_id")).agg(F.collect_set("anchor").alias("shared"))
    look = every.where("not copy").select(F.col("doc_id").alias("l_id"), F.col("text_key").alias("l_key")).distinct().join(shared, F.col("l_id") == F.col("s_id"))
    candidates = staged(known.join(look, (F.col("doc_id") == F.col("l_id")) & (F.col("text_key") == F.col("l_key"))).select("doc_id", "text_key", "text", "shared"), "candidates")

    windows = candidates.mapInArrow(_window_rows(length), f"h1 long, h2 long, doc_id {kind}, text_key long, start int")
    again = with_partner(windows, ["h1", "h2"], F.col("other.doc_id") < F.col("mine.doc_id"))
    again = again.groupBy(F.col("doc_id").alias("a_id"), F.col("text_key").alias("a_key")).agg(F.collect_set("start").alias("starts"))
    hit = candidates.join(again, (F.col("doc_id") == F.col("a_id")) & (F.col("text_key") == F.col("a_key"))).select("doc_id", "text_key", "text", "starts")
    cut = hit.mapInArrow(_cut(length), f"c_id {kind}, c_key long, c_removed long, c_sha binary, kept string").dropDuplicates(["c_id", "c_key"])
    if not with_text:
        cut = cut.drop("kept")
    out = every.join(cut, (F.col("doc_id") == F.col("c_id")) & (F.col("text_key") == F.col("c_key")), "left")
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("c_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("c_sha", "sha")))).alias("kept_sha256"),
        *(["kept"] if with_text else []),
    )
