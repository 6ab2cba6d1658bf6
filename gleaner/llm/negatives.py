"""Hard negatives by score windows (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, staged

ANCHORS, ROWS = 1024, 1 << 16  # most anchors of a block; rows that meet a block in one task
STEP = 2048  # rows multiplied at once
_EXACT = 1 << 53


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, vector array<long>) of the rows that take part: components become floor(scale * x), x as double.

    Rows with a null id, label or vector, or with a component that is null or not finite, are left out.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & fine)
    return rows.select("id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("vector"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """A row of integers for each list; shorter ones end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    values, width = lists.flatten().to_numpy(zero_copy_only=False), int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a with all of b: in doubles where none can exceed 2^53, else in 64-bit integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(width, 1)
    if bound < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The `most` rows of each place with the highest scores, ties by smaller id."""

    def __init__(self, places: int, most: int):
        self.most = most
        self.least = np.full(places, np.iinfo(np.int64).min)  # of a place that is full, the lowest score kept
        self.place, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, place: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        place, score, id_ = (np.concatenate(x) for x in ((self.place, place), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, -score, place))
        place = place[order]
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        rank = np.arange(len(place)) - np.repeat(starts, np.diff(np.append(starts, len(place))))
        kept = order[rank < self.most]
        last = order[rank == self.most - 1]
        self.place, self.score, self.id = np.concatenate([place[:0], place[rank < self.most]]), score[kept], id_[kept]
        self.least[place[rank == self.most - 1]] = score[last]

    def offer(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        """A row of scores for each of `places`, a column for each id."""
        allowed = allowed & (scores >= self.least[places][:, None])
        if scores.shape[1] > 4 * self.most:  # of a batch none below its own most-th best is kept
            floor = np.partition(np.where(allowed, scores, np.iinfo(np.int64).min), -self.most, axis=1)[:, -self.most]
            allowed &= scores >= floor[:, None]
        at, column = np.nonzero(allowed)
        if len(at):
            self.add(places[at], scores[at, column], ids[column])


def _positives(most: int):
    def found(anchors: dict, n: int):
        best, places = Best(n, most), np.arange(n)

        def offer(scores: np.ndarray, rows: dict) -> None:
            best.offer(scores, (anchors["label"][:, None] == rows["label"]) & (anchors["id"][:, None] != rows["id"]), rows["id"], places)

        return best, offer

    return found


def _negatives(most: int, low: int):
    def found(anchors: dict, n: int):
        uppers = anchors["uppers"]  # descending, padded with nulls
        slots = max(1, uppers.shape[1])
        best = Best(n * slots, most)

        def offer(scores: np.ndarray, rows: dict) -> None:
            other = anchors["label"][:, None] != rows["label"]
            for slot in range(uppers.shape[1]):
                here = uppers[:, slot]
                held, here = here != _NONE, np.maximum(here, 0)
                below = uppers[:, slot + 1] if slot + 1 < uppers.shape[1] else np.full(n, _NONE)
                least = low * (here // 100) + (low * (here % 100) + 99) // 100  # low % of it, upwards, where the product would not fit
                inside = other & held[:, None] & (scores <= here[:, None]) & (scores > below[:, None]) & (scores >= least[:, None])
                best.offer(scores, inside, rows["id"], np.arange(n) * slots + slot)

        return best, offer

    return found


_NONE = np.iinfo(np.int64).min


def _meet(make, slotted: bool):
    """Anchors of a block first, then the rows that meet them, a batch at a time; what is kept of each anchor and slot at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, state = None, [], None

        def ended() -> Iterator[pa.RecordBatch]:
            if state:
                anchors, best, slots, _ = state
                best.add(*(np.zeros(0, np.int64) for _ in range(3)))
                columns = (anchors["id"][best.place // slots], best.place % slots, best.id, best.score)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "slot", "id", "score"])

        for b in batches:
            block, part, is_row = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part", "is_row"))
            edges = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (is_row[1:] != is_row[:-1])) + 1), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi == lo:
                    continue
                if (block[lo], part[lo]) != key:
                    yield from ended()
                    key, parts, state = (block[lo], part[lo]), [], None
                piece = b.slice(lo, hi - lo)
                if not is_row[lo]:
                    parts.append(piece)
                    continue
                if not parts and not state:
                    continue  # no anchor fell into this block
                if not state:
                    held = pa.Table.from_batches(parts).combine_chunks()
                    anchors = {c: held.column(c).to_numpy() for c in ("id", "label")}
                    anchors["vector"] = _matrix(held.column("vector").chunk(0))
                    slots = 1
                    if slotted:
                        lists = held.column("uppers").to_pylist()
                        slots = max(map(len, lists), default=0) or 1
                        anchors["uppers"] = np.array([[*u, *[_NONE] * (slots - len(u))] for u in lists], np.int64).reshape(len(lists), slots)
                    best, offer = make(anchors, len(anchors["id"]))
                    state, parts = (anchors, best, slots, offer), []
                for i in range(0, piece.num_rows, STEP):
                    some = piece.slice(i, STEP)
                    rows = {c: some.column(c).to_numpy() for c in ("id", "label")}
                    state[3](products(state[0]["vector"], _matrix(some.column("vector"))), rows)
        yield from ended()

    return run


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _kept(anchors: DataFrame, rows: DataFrame, blocks: int, parts: int, make, slotted: bool) -> DataFrame:
    """(anchor_id, slot, id, score): what each part of the rows keeps of every anchor and slot.

    A block of anchors meets every part of the rows once: anchors are copied to `parts` parts, rows to `blocks` blocks, so their
    copies, not their pairs, are shuffled.
    """
    dealt_anchors = anchors.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(_numbers(parts)).alias("part"), F.lit(False).alias("is_row"), *anchors.columns)
    dealt_rows = rows.select(F.explode(_numbers(blocks)).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).alias("part"), F.lit(True).alias("is_row"), *rows.columns)
    both = dealt_anchors.unionByName(dealt_rows, allowMissingColumns=True)
    both = both.repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "is_row")
    return staged(both.mapInArrow(_meet(make, slotted), "anchor_id long, slot long, id long, score long"), "kept")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """Hard negatives of every anchor and each of its positives: rows of other labels scoring from `low` % to 100 % of the positive.

    vectors: (id, label, vector array<long>), as quantised gives them; is_anchor is a condition on them. A score is the inner
    product with the anchor, higher ones come first, ties by smaller id. Positives are the first `positives` other rows of the
    anchor's label. Their scores, in falling order, split all scores into disjoint slots: (next positive's, this positive's].
    Every part of the rows keeps the first `negatives` of each slot, the parts' are combined, and a positive's window gets the
    first of its own slot, then of the slots after it, in one ranking of all; those below its lower limit go.

    Scores are exact (they must fit 64 bits). Vectors of unlike lengths meet in the components that both have. An anchor without
    positives, a positive of negative score and windows without rows give no rows; repeated rows are
    candidates each, but of rows of one id only the least (label, vector) is an anchor, and none of them meets it. A label that holds most rows makes no task larger: parts are cut by id. An empty
    table gives no rows.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    rows = staged(vectors.select("id", "label", "vector"), "vectors")
    anchors = rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a")).select("id", "a.label", "a.vector")
    n, n_anchors = rows.count(), anchors.count()
    blocks = max(1, -(-n_anchors // ANCHORS))
    parts = max(1, -(-n // ROWS), -(-shuffle_parts(spark) // blocks))

    def first(kept: DataFrame, most: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
        return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    chosen = staged(first(_kept(anchors, rows, blocks, parts, _positives(positives), False), positives, "anchor_id"), "positives")
    uppers = chosen.where("score >= 0").groupBy("anchor_id").agg(F.reverse(F.array_sort(F.collect_set("score"))).alias("uppers"))  # at most `positives` each
    limited = anchors.join(uppers.withColumnRenamed("anchor_id", "id"), "id")
    best = first(_kept(limited, rows, blocks, parts, _negatives(negatives, low), True), negatives, "anchor_id", "slot").select("anchor_id", "slot", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    windows = chosen.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(uppers, "anchor_id")
    windows = windows.where("positive_score >= 0").select("anchor_id", "positive_id", "positive_score", (F.array_position("uppers", F.col("positive_score")) - 1).alias("from_slot"))
    merged = windows.join(best, "anchor_id").where(f"slot >= from_slot AND negative_score >= {low} * (positive_score div 100) + ({low} * (positive_score % 100) + 99) div 100")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy("slot", F.desc("negative_score"), "negative_id")
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
