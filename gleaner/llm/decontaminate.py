"""Benchmark passages in documents by greedy string tiling (operator 5)."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Windows, WordHashes, kept_in_worker, staged, unused

_words = re.compile(r"\w+")
BITS_A_SEED = 1024  # of the filter of seeds, as long as it is not at its largest
MOST_BITS = 1 << 27  # 16 MB, whatever the benchmark holds
_ROW_BITS = 32768  # bits of one row that Spark's bitmap functions make


class Tokens:
    """Texts as arrays of hashed words: runs of letters, digits and underscores, lowered."""

    def __init__(self):
        self.hashes, self.windows = WordHashes(5), Windows(0x9E3779B97F4A7C15)

    def of(self, text: str | None) -> np.ndarray:
        got = _words.findall((text or "").lower())
        return np.fromiter(map(self.hashes.__getitem__, got), np.uint64, len(got))


def _of_worker() -> Tokens:
    return kept_in_worker(("tokens",), Tokens)


def tiles(item: np.ndarray, text: np.ndarray, least: int, windows: Windows) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token arrays: (place in item, place in text, length) of matches that don't overlap in either.

    Each round finds, by Karp-Rabin hashes of unmarked windows of the search length, all matches of at least that
    length, grown as far as they go, and marks the longest first. What earlier marks leave of a match goes back into
    the queue of the round if it is long enough, so a longer match is never marked after a shorter one. The search
    length begins at the longest possible and halves down to `least`.
    """
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    out, s = [], max(least, min(len(item), len(text)))
    while True:
        found = []
        at_i, at_t = _open(free_i, s), _open(free_t, s)
        if len(at_i) and len(at_t):
            hi, ht = windows.of(item, s)[at_i], windows.of(text, s)[at_t]
            order = np.argsort(ht, kind="stable")
            low, high = np.searchsorted(ht[order], hi, "left"), np.searchsorted(ht[order], hi, "right")
            for i, a, b in zip(at_i.tolist(), low.tolist(), high.tolist(), strict=True):
                t = at_t[order[a:b]]
                if i and free_i[i - 1]:  # not those grown from the left already
                    t = t[(t == 0) | ~free_t[t - 1] | (text[t - 1] != item[i - 1])]
                n, size = np.full(len(t), s), s
                growing = np.arange(len(t))
                while len(growing) and i + size < len(item) and free_i[i + size]:
                    after = t[growing] + size
                    growing, after = growing[after < len(text)], after[after < len(text)]
                    growing = growing[free_t[after] & (text[after] == item[i + size])]
                    size += 1
                    n[growing] = size
                found += zip((-n).tolist(), [i] * len(t), t.tolist(), strict=True)
        heapq.heapify(found)
        while found:
            n, i, t = heapq.heappop(found)
            n = -n
            free = free_i[i : i + n] & free_t[t : t + n]
            if free.all():
                free_i[i : i + n] = free_t[t : t + n] = False
                out.append((i, t, n))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= s:
                    heapq.heappush(found, (a - b, i + a, t + a))
        if s <= least:
            return sorted(out)
        s = max(least, s // 2)


def _open(free: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows that hold no marked token."""
    n = len(free) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(sums[length:] == sums[:n])


def _reach(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a window that begins at one of the distinct starts."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + length, n), -1)
    return np.cumsum(edges[:n]) > 0


def _seed_rows(least: int, share: float):
    """Of every item with enough tokens: its tokens, and its windows' hashes with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _of_worker()
        for b in batches:
            tokens = [words.of(t) for t in b.column("text").to_pylist()]
            seeds = [words.windows.of(t, least).view(np.int64) for t in tokens]
            keep = pa.array([len(t) >= least for t in tokens])
            kinds = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id"), b.column("item_key"), pa.array([t.view(np.int64) for t in tokens], kinds), pa.array(seeds, kinds)], names=["item_id", "item_key", "tokens", "seeds"]
            ).filter(keep)

    return run


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bitmap of the seeds' lowest bits: BITS_A_SEED for each while that is no more than MOST_BITS in all."""
    n = seeds.count()
    bits = min(MOST_BITS, max(_ROW_BITS, 1 << (BITS_A_SEED * n).bit_length()))
    slot = seeds.select(F.col("seed").bitwiseAND(F.lit(bits - 1)).alias("slot"))
    # At most MOST_BITS bits reach the driver and the tasks.
    rows = slot.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        first = (r.b - 1) * _ROW_BITS // 8
        out[first : first + _ROW_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _hit_rows(least: int, held: np.ndarray):
    """Of every document that has seeds of the filter: those, and the tokens inside their windows, with a 0 where others stood."""
    mask = np.uint64(8 * len(held) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _of_worker()
        for b in batches:
            at, parts, seeds = [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                t = words.of(text)
                h = words.windows.of(t, least)
                slot = h & mask
                hits = np.flatnonzero(held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                if len(hits):
                    inside = np.flatnonzero(_reach(hits, least, len(t)))
                    gaps = np.flatnonzero(np.diff(inside) > 1) + 1
                    at.append(k)
                    parts.append(np.insert(t[inside], gaps, np.uint64(0)).view(np.int64))
                    seeds.append(np.unique(h[hits]).view(np.int64))
            kinds = pa.list_(pa.int64())
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("text_key").take(rows), pa.array(parts, kinds), pa.array(seeds, kinds)], names=["doc_id", "text_key", "part", "seeds"])

    return run


def rare_places(places: np.ndarray, n: np.ndarray, words: int, least: int, share: float) -> np.ndarray:
    """The places of an item without its most frequent, as many as cannot reach `share` of the item together.

    places are all that any document shares, n how often. Whatever reaches the share has at least one place that is left, so nothing is lost,
    and the phrases that everything holds are joined with nothing as long as an item has others.
    """
    order = np.lexsort((places, -n))
    inside = np.zeros(words, bool)
    for k, place in enumerate(places[order].tolist()):
        inside[place : place + least] = True
        if inside.sum() >= share * words:
            return places[order[k:]]
    return places[:0]  # all together don't reach it: nothing can


def _rare_seeds(least: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, seeds = [], []
            for key, counts, own, tokens in zip(b.column("item_key").to_pylist(), b.column("counts"), b.column("seeds"), b.column("tokens"), strict=True):
                places, n = (x.to_numpy() for x in counts.values.flatten())
                got = own.values.to_numpy()[rare_places(places, n, len(tokens), least, share)]
                got = np.unique(got)
                keys += [key] * len(got)
                seeds.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *seeds]))], names=["item_key", "seed"])

    return run


def _tile_rows(least: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _of_worker().windows
        for b in batches:
            at, numbers = [], []
            for k, (item, part, own, held) in enumerate(zip(*(b.column(c) for c in ("tokens", "part", "seeds", "held")), strict=True)):
                item, part = (x.values.to_numpy().view(np.uint64) for x in (item, part))
                shared = np.flatnonzero(np.isin(own.values.to_numpy(), held.values.to_numpy()))
                if _reach(shared, least, len(item)).sum() < share * len(item):
                    continue  # with all shared windows
                got = tiles(item, part, least, windows)
                total = sum(n for *_, n in got)
                if total >= share * len(item):
                    at.append(k)
                    numbers.append((len(item), len(got), total))
            rows = pa.array(at, pa.int32())
            columns = np.array(numbers, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(rows) for c in ("doc_id", "text_key", "item_id")), *(pa.array(np.ascontiguousarray(columns[:, k])) for k in range(3)), pa.array(columns[:, 2] / columns[:, 0])],
                names=["doc_id", "text_key", "item_id", "item_words", "tiles", "tiled_words", "coverage"],
            )

    return run


def text_key(col: str | Column) -> Column:
    """128 bits of a text's hash; null texts have one of their own."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.md5(c.cast("binary")), F.lit(""))


def _leaks(docs: DataFrame, benchmark: DataFrame, share: float, least: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """Distinct (doc_id, text_key, item_id, ...) of the pairs; see find_leaks."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").select("doc_id", text_key("text").alias("text_key"), "text")
    kind, item_kind = plain.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    items = items.select("item_id", F.md5(F.to_json(F.struct("item_id", "text"))).alias("item_key"), "text")
    items = staged(items.mapInArrow(_seed_rows(least, share), f"item_id {item_kind}, item_key string, tokens array<long>, seeds array<long>"), "items")
    seeds = items.select("item_key", F.posexplode("seeds").alias("place", "seed"))
    held = seed_filter(seeds.select("seed").distinct())
    hits = staged(plain.mapInArrow(_hit_rows(least, held), f"doc_id {kind}, text_key string, part array<long>, seeds array<long>").dropDuplicates(["doc_id", "text_key"]), "hits")

    # A pair that reaches the share has a seed of those that `_rare_seeds` leaves.
    often = hits.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("n"))
    counted = seeds.join(often, "seed").groupBy("item_key").agg(F.collect_list(F.struct("place", "n")).alias("counts"))
    rare = counted.join(items, "item_key").mapInArrow(_rare_seeds(least, share), "item_key string, seed long")
    met = hits.select("doc_id", "text_key", F.explode("seeds").alias("seed")).join(staged(rare, "seeds"), "seed").select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), "item_key").distinct()
    same = F.col("m_id").eqNullSafe(F.col("doc_id")) & (F.col("m_key") == F.col("text_key"))
    pairs = staged(met.join(hits, same).select("doc_id", "text_key", "part", F.col("seeds").alias("held"), "item_key"), "pairs").join(items, "item_key")
    return pairs.mapInArrow(_tile_rows(least, share), f"doc_id {kind}, text_key string, item_id {item_kind}, item_words long, tiles long, tiled_words long, coverage double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, least: int = 4, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every pair of a document and a benchmark item of which at least `share` of the tokens is tiled by the document.

    Seeds, the hashed windows of `least` tokens, are joined in Spark. A bitmap of the benchmark's seeds, of bounded size,
    goes with the scan of the documents; only seeds that it holds, and the tokens inside their windows, leave the scan.
    They meet the benchmark's seeds in a join, for which each item lays aside its most frequent ones (see rare_places): a
    phrase in every item and every document makes no rows. A pair goes on if its shared windows could reach the share, and is
    then tiled. Tiles may stand in any order, so moved passages count. The driver gets the bitmap and nothing else.

    Items of fewer than `least` tokens, null texts and null items never match; null ids are documents like others.
    Repeated rows give repeated results; empty tables give none. Other columns are ignored.

    Returns doc_id, item_id, item_words, tiles, tiled_words, coverage.
    """
    pairs = _leaks(docs, benchmark, share, least, id_col, text_col, item_col, item_text_col)
    found = staged(pairs.withColumnsRenamed({"doc_id": "f_id", "text_key": "f_key"}), "leaks")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key"))).select("doc_id", "item_id", "item_words", "tiles", "tiled_words", "coverage")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, least: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, unchanged, without those that find_leaks pairs with an item.

    Null and empty texts stay; of null ids, and of rows that share an id, those with a leaked text go; an empty table
    gives no rows, and an empty benchmark takes none away. Columns may have any names.
    """
    pairs = _leaks(docs, benchmark, share, least, id_col, text_col, "item_id", "text")
    id_, key = unused(docs, "leak_id", "leak_key")
    gone = staged(pairs.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct(), "leaks")
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(id_)) & (text_key(text_col) == F.col(key)), "left_anti")
