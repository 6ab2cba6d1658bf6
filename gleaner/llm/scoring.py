"""Context-tree weighting over bytes (operator 12)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import MOST, Places, in_blocks, totals, unpacked, with_values
from .common import WordHashes, kept_in_worker, shuffle_parts, staged

DEPTH, TOP = 5, 2  # bytes of context; levels whose nodes meet across tasks
END = 0xFF  # no byte of UTF-8: stands before a text and ends it
GRAM, WORD = 0, 1
END_WORD = 0  # key of the end token
_LN2 = math.log(2)


def _log_gamma_table(first: float, n: int = 2048) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(n) + first))])


_HALVES, _WHOLES = _log_gamma_table(0.5), _log_gamma_table(1.0)  # ln of gamma(n + first) / gamma(first)


def _rising(n: np.ndarray, first: float, table: np.ndarray) -> np.ndarray:
    """ln gamma(n + first) - ln gamma(first), by the table or Stirling's series beyond it."""
    x = n + first
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) - math.lgamma(first)
    return np.where(n < len(table), table[np.minimum(n, len(table) - 1)], far)


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _rising(n0, 0.5, _HALVES) + _rising(n1, 0.5, _HALVES) - _rising(n0 + n1, 1.0, _WHOLES)


def next_one(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (n1 + 0.5) / (n0 + n1 + 1.0)


def weighted(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of a node's weighted probability, from its counts and the sum of its children's, and the share of its own estimate in it."""
    own = estimate(n0, n1)
    both = np.logaddexp(own, below) - _LN2
    return both, np.exp(own - _LN2 - both)


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


class Subtrees:
    """The tree of one bit of the next byte below depth TOP, for grams (nearest byte first, then the next byte) and their counts.

    Nodes are the contexts of each depth together with the bits before this one. Grams of count 0 make nodes without counts,
    whose probability is 1, so they change nothing and get the mixture of their ancestors.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, bit: int, depth: int):
        byte = grams & 0xFF
        context, self.prefix = grams >> 8, byte >> (8 - bit)
        key = (self.prefix << (8 * depth)) | context
        self.order = np.argsort(key)
        key, self.ones, n = key[self.order], ((byte >> (7 - bit)) & 1)[self.order], n[self.order]
        starts = _runs(key)
        self.leaf = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        n1 = np.add.reduceat(n * self.ones, starts)
        n0 = np.add.reduceat(n, starts) - n1
        self.chance, self.levels = next_one(n0, n1), []
        below, key = estimate(n0, n1), key[starts]
        for level in range(depth - 1, TOP - 1, -1):
            parents = key >> 8
            starts = _runs(parents)
            n0, n1, below = (np.add.reduceat(x, starts) for x in (n0, n1, below))
            up = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(parents))))
            key = parents[starts]
            if level == TOP:  # its sums may go on in another part
                self.up = up
                self.key, self.n0, self.n1, self.below = key, n0, n1, below
            else:
                both, share = weighted(n0, n1, below)
                self.levels.append((up, share, next_one(n0, n1)))
                below = both

    def logs(self, fixed: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 of the chance of each gram's bit; at depth TOP the mixture is fixed + rest * what its child says."""
        at, q = np.arange(len(self.chance)), self.chance
        for up, share, own in self.levels:
            at = up[at]
            q = share[at] * own[at] + (1 - share[at]) * q
        at = self.up[at]
        q = (fixed[at] + rest[at] * q)[self.leaf]
        out = np.empty(len(self.order))
        out[self.order] = np.log10(np.where(self.ones == 1, q, 1 - q))
        return out


def _parts(batches: Iterator[pa.RecordBatch], depth: int, most: int = 1 << 19) -> Iterator[tuple[pa.Table, bool]]:
    """Rows in order of key, cut where the context of TOP + 1 bytes changes, at least `most` in all but the last."""
    shift, waiting, size = 8 * (depth - TOP), [], 0
    for b in batches:
        waiting.append(b)
        size += b.num_rows
        if size >= most:
            rows = pa.Table.from_batches(waiting)
            context = rows.column("key").to_numpy() >> shift
            cut = int(_runs(context)[-1])
            if cut:
                yield rows.slice(0, cut)
                rows = rows.slice(cut)
            waiting, size = rows.combine_chunks().to_batches(), rows.num_rows
    if size:
        yield pa.Table.from_batches(waiting)


def _sums(depth: int):
    """Sums of the children of nodes at depth TOP: (node, bit, n0, n1, below), several of a node if it is in several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches, depth):
            grams, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
            for bit in range(8):
                t = Subtrees(grams, n, bit, depth)
                yield pa.RecordBatch.from_arrays([pa.array(t.key), pa.array(np.full(len(t.key), bit, np.int32)), pa.array(t.n0), pa.array(t.n1), pa.array(t.below)], names=["node", "bit", "n0", "n1", "below"])

    return run


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        both, share = weighted(*(b.column(c).to_numpy() for c in ("n0", "n1", "below")))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "bit", "n0", "n1")), pa.array(both), pa.array(share)], names=["node", "bit", "n0", "n1", "both", "share"])


def _top(rows: list) -> np.ndarray:
    """What the root and depth 1 say, as fixed and rest by [bit, bits before it, nearest byte]; rows: (node, bit, n0, n1, below) of depth 1."""
    out = np.zeros((8, 128, 256, 2))
    out[..., 1] = 1.0
    for bit in range(8):
        mine = [r for r in rows if r.bit == bit]
        if not mine:
            continue
        node, n0, n1, below = (np.array([r[k] for r in mine]) for k in ("node", "n0", "n1", "below"))
        both, share = weighted(n0, n1, below)
        prefix, byte = node >> 8, node & 0xFF
        sums = np.zeros((3, 128))
        for k, x in enumerate((n0, n1, both)):
            np.add.at(sums[k], prefix, x)
        _, root = weighted(sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2])
        root_one = next_one(sums[0], sums[1])
        w = root[prefix]
        out[bit, prefix, byte, 0] = w * root_one[prefix] + (1 - w) * share * next_one(n0, n1)
        out[bit, prefix, byte, 1] = (1 - w) * (1 - share)
    return out


def _logs(depth: int, top: np.ndarray):
    """log10 of the chance of each gram's last byte; rows of a node at depth TOP come before its grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[pa.RecordBatch] = []

        def grams() -> Iterator[pa.RecordBatch]:
            for b in batches:
                is_node = b.column("bit").is_valid().to_numpy(zero_copy_only=False)
                nodes.append(b.filter(pa.array(is_node)).select(["node", "bit", "n0", "n1", "share"]))
                if not is_node.all():
                    yield b.filter(pa.array(~is_node)).select(["key", "n"])

        for rows in _parts(grams(), depth):
            keys, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
            known = pa.Table.from_batches(nodes)
            node, bits, n0, n1, share = (known.column(c).to_numpy() for c in ("node", "bit", "n0", "n1", "share"))
            logs = np.zeros(len(keys))
            for bit in range(8):
                t = Subtrees(keys, n, bit, depth)
                mine = np.flatnonzero(bits == bit)
                mine = mine[np.argsort(node[mine])]
                at = mine[np.searchsorted(node[mine], t.key)]
                above = top[bit, t.key >> (8 * TOP), (t.key >> (8 * TOP - 8)) & 0xFF]
                fixed = above[:, 0] + above[:, 1] * share[at] * next_one(n0[at], n1[at])
                logs += t.logs(fixed, above[:, 1] * (1 - share[at]))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(logs)], names=["key", "log"])
            last = int(keys[-1] >> (8 * (depth + 1 - TOP)))
            here = (node & ((1 << (8 * TOP)) - 1)) >= last  # earlier ones have had their grams
            nodes[:] = known.filter(pa.array(here)).combine_chunks().to_batches() or nodes[:1]

    return run


def gram_logs(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, log): log10 of the chance of each gram's last byte after its context, under the tree of all grams' counts.

    grams: (key, n), a row for each distinct gram; key is the context, nearest byte first, and then the byte. Grams are dealt by
    the TOP nearest bytes and go through a task in parts of about half a million. Nodes at depth TOP are summed in Spark; those of
    depth 1 and the root, at most 256 * 255 and 255 whatever the corpus, are weighed in the driver.
    """
    spark, near = grams.sparkSession, 8 * (depth + 1 - TOP)
    tasks, low = shuffle_parts(spark), (1 << (8 * TOP)) - 1
    grams = staged(grams, "grams")
    dealt = grams.withColumn("pair", F.shiftright("key", near)).repartition(tasks, "pair").sortWithinPartitions("pair", "key").select("key", "n")
    kind = "node long, bit int, n0 long, n1 long"
    sums = dealt.mapInArrow(_sums(depth), f"{kind}, below double").groupBy("node", "bit").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below")))
    nodes = staged(sums.mapInArrow(_weights, f"{kind}, both double, share double"), "nodes")
    first = nodes.groupBy(F.shiftright("node", 8 * (TOP - 1)).alias("node"), "bit").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("both").alias("below"))
    top = _top(first.collect())
    pairs = nodes.select(F.col("node").bitwiseAND(low).alias("pair"), "node", "bit", "n0", "n1", "share")
    both = pairs.unionByName(grams.withColumn("pair", F.shiftright("key", near)), allowMissingColumns=True)
    return both.repartition(tasks, "pair").sortWithinPartitions("pair", F.col("bit").isNull(), "key").mapInArrow(_logs(depth, top), "key long, log double")


def grams_of(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all bytes of the texts and of their ends, and the place of each text's first."""
    gap = bytes([END]) * depth
    data = np.frombuffer(gap + gap.join(t + bytes([END]) for t in texts), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    key, n = np.zeros(len(data) - depth, np.int64), len(data) - depth
    for k in range(depth):
        key = (key << 8) | data[depth - 1 - k : depth - 1 - k + n]
    key = (key << 8) | data[depth:]
    keep = np.ones(n, bool)  # not those that end inside a gap
    inner = (first + depth * np.arange(len(texts)))[1:]
    keep[(inner[:, None] - depth + np.arange(depth)).ravel()] = False
    return key[keep], first


def lowered(texts: list[str]) -> list[bytes]:
    return [t.encode().lower() for t in texts]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has. No word has the key of the end token."""
    known = kept_in_worker(("words",), WordHashes)
    words = [t.split() for t in texts]
    keys = known.of([w for ws in words for w in ws])
    return np.where(keys == END_WORD, np.uint64(1), keys).view(np.int64), np.fromiter(map(len, words), np.int64, len(words))


def _count(depth: int):
    def count(texts: list[str], learns: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for flag in (True, False):
            mine = lowered([t for t, x in zip(texts, learns, strict=True) if x == flag])
            if not mine:
                continue
            words, _ = words_of(mine)
            for kind, keys in ((GRAM, grams_of(mine, depth)[0]), (WORD, words)):
                keys, n = np.unique(keys, return_counts=True)
                yield kind, keys, n * int(flag)
            yield WORD, np.array([END_WORD]), np.array([len(mine) * int(flag)])

    return count


_COLUMNS = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(depth: int, tokens: int, distinct: int, id_type: pa.DataType):
    def part(held: dict, rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = lowered(rows.column("text").to_pylist())
        places, logs = held[GRAM]
        grams, first = grams_of(texts, depth)
        scores = np.add.reduceat(logs[places.of(grams)], first)
        places, n = held[WORD]
        keys, sizes = words_of(texts)
        count = n[places.of(keys)].astype(np.int64)
        end = int(n[places.of(np.array([END_WORD]))[0]])
        doc = np.repeat(np.arange(len(texts)), sizes)
        base = np.bincount(doc, np.log10((count + 1) / (tokens + distinct + 1)), len(texts)) + math.log10((end + 1) / (tokens + distinct + 1))
        known = np.bincount(doc, count > 0, len(texts)).astype(np.int64) + int(end > 0)
        held_out = ~rows.column("flag").to_numpy(zero_copy_only=False)
        columns = [rows.column("doc_id"), pa.array(held_out), pa.array(sizes + 1), pa.array(known), pa.array(np.full(len(texts), tokens)), pa.array(base), pa.array(scores)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def score(held: dict, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for data in rows.column("packed").to_pylist():
            for some in unpacked(data):
                yield part(held, some)

    return score


def score_texts(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """log10 probability of every whole text under a context tree weighted over the texts for which `learns` holds.

    The tree: every byte of a text (A-Z lowered) and its end is eight binary choices, each with the `depth` bytes before it as
    context; bytes before the text are END. Every node, for a context of 0 to `depth` bytes and the bits already chosen, has a
    Krichevsky-Trofimov estimate of its counts; half of a node's probability is its own estimate, half the product of its
    children's, so a choice's chance mixes all depths by what the corpus has shown of each. -score * log2(10) / bytes is the
    code length per byte.

    base_score is the sum over tokens (words and one end) of log10((c + 1) / (N + V + 1)). Words are told apart by 64-bit hashes.
    All documents' distinct grams and words go to block dictionaries (see blocks), so what is gathered grows with the corpus.

    Null or empty text is its end alone; null in `learns` counts as true; repeated rows are scored, and learned, as often as they
    occur; without rows to learn from every bit has chance 1/2 and N and V are 0; an empty table gives no rows. Other columns
    are ignored.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    blocks = in_blocks(docs, _count(depth), F.coalesce(learns, F.lit(True)), id_col, text_col, most)
    id_type = docs.schema[id_col].dataType
    words = staged(totals(blocks, WORD), "words")
    seen = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    logs = gram_logs(totals(blocks, GRAM), depth)
    values = words.select(F.lit(WORD).alias("kind"), "key", F.col("n").cast("double").alias("value")).unionByName(logs.select(F.lit(GRAM).alias("kind"), "key", F.col("log").alias("value")))
    return with_values(blocks, values, lambda keys, value: (Places(keys), value), _score(depth, seen.n or 0, seen.v or 0, to_arrow_type(id_type)), f"doc_id {id_type.simpleString()}, {_COLUMNS}")
