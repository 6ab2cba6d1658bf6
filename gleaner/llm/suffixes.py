"""Removal of repeated byte strings by column-wise construction of suffix collections (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Windows, kept_in_worker, shuffle_parts, staged, with_partner

GRAM = 52  # bytes of a minimizer: long enough that few texts share one by chance
PIECE = 1 << 22  # window starts of a text that are looked at together; positions inside take 24 bits


class Cutter:
    """Cuts a text's windows into runs that share their minimizer: the leftmost GRAM bytes, inside the window, of least hash.

    Equal windows have equal minimizers at equal places, so all windows that could be equal meet under one hash.
    """

    def __init__(self, length: int):
        self.length, self.gram = length, min(GRAM, length)
        self.table = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64)
        self.hashes = Windows(0x9E3779B97F4A7C15)

    def runs(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Minimizer hash, first window start, number of windows, and bytes from that start to the minimizer, of each run."""
        out = []
        for at in range(0, max(0, len(text) - self.length + 1), PIECE):
            out.append(self._piece(text[at : at + PIECE + self.length - 1], at))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none, none)

    def _piece(self, text: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = self.hashes.of(self.table[np.frombuffer(text, np.uint8)], self.gram)
        w = self.length - self.gram + 1
        key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        # sliding minimum: each window spans two blocks of w keys, a suffix of one and a prefix of the next
        n = len(h) - w + 1
        padded = np.full(-(-len(key) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(key)] = key
        blocks = padded.reshape(-1, w)
        prefix = np.minimum.accumulate(blocks, axis=1).ravel()
        suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(suffix[:n], prefix[w - 1 : w - 1 + n])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        return h[place[first]].view(np.int64), first + at, np.diff(np.append(first, n)), place[first] - first


def _common_prefixes(ordered: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each string with the one before it; 0 for the first."""
    width = max(map(len, ordered), default=0)
    out = np.zeros(len(ordered), np.int64)
    if width and len(ordered) > 1:
        rows = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in ordered), np.uint8).reshape(-1, width)
        unlike = rows[1:] != rows[:-1]
        first = np.where(unlike.any(1), unlike.argmax(1), width)
        lengths = np.array([len(x) for x in ordered])
        out[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return out


def suffix_classes(strings: list[bytes], length: int, begin: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, class) of the windows of `length` bytes of the strings that start at `begin` or before it; equal windows, as far from begin, have equal classes.

    The strings enter together, from begin (their ends, if not given) to their fronts. What stands from begin on is put
    in order first, each such tail as a whole; then round j inserts, of every string that has one, the suffix that
    starts j bytes before begin. Kept in suffix order are the Burrows-Wheeler transform (the symbol before each
    suffix), the common prefix of each suffix with the one above it, and the suffix's string and length. The symbol c
    written before a suffix at q goes, as the head of the new suffix, below all suffixes of smaller heads and of as many
    suffixes of head c as there are c above q; its common prefix is one more than the least common prefix between q and
    the last c above. Each round reads and rewrites the columns in order, nothing else.

    Tails stand above all inserted suffixes, so a suffix of j symbols before a tail is only ever compared with others of
    j symbols: windows that share a minimizer are equal only at equal distances from it.
    """
    n = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    begins = sizes if begin is None else np.array(begin, np.int64)
    ends = np.cumsum(sizes) - sizes + begins
    data = np.frombuffer(b"".join(strings), np.uint8)
    small = np.int16 if sizes.max(initial=0) < 1 << 15 else np.int32
    tails = [s[b:] for s, b in zip(strings, begins.tolist(), strict=True)]
    sorted_tails = sorted(range(n), key=tails.__getitem__)
    tails = [tails[i] for i in sorted_tails]
    # columns in suffix order; the tails come first
    symbol = np.zeros(n, np.int16)  # 0: not known yet, or the beginning of a string
    common = _common_prefixes(tails).astype(small)
    owner, size = np.array(sorted_tails, np.int32), np.array([len(t) for t in tails], small)
    place = np.empty(n, np.int64)  # where each string's last suffix stands
    place[owner] = np.arange(n)
    for j in range(1, int(begins.max(initial=0)) + 1):
        active = np.flatnonzero(begins >= j)
        at = place[active]
        symbol[at] = data[ends[active] - j].astype(np.int16) + 1
        # all known symbols in order of symbol, then of place: so stand the suffixes that they head
        known = np.flatnonzero(symbol)
        heads = symbol[known]
        order = known[np.argsort(heads.astype(np.uint16), kind="stable")]
        total = n + len(order)
        fresh = np.zeros(len(symbol), bool)
        fresh[at] = True
        is_new = fresh[order]
        head = symbol[order]
        same = np.concatenate([[False], head[1:] == head[:-1]])
        # common prefixes of the new suffixes and of those right below them
        touched = is_new.copy()
        touched[1:] |= is_new[:-1]
        t = np.flatnonzero(touched)
        value = np.zeros(len(t), small)
        pair = same[t]
        low, high = order[t[pair] - 1] + 1, order[t[pair]] + 1
        if len(low):
            by_place = np.argsort(low, kind="stable")
            bounds = np.empty(2 * len(low), np.int64)
            bounds[::2], bounds[1::2] = low[by_place], high[by_place]
            least = np.minimum.reduceat(np.append(common, small(0)), bounds)[::2]
            got = np.empty(len(low), small)
            got[by_place] = least + 1
            value[pair] = got
        mask = np.zeros(total, bool)
        mask[n:] = is_new
        where = np.empty(len(symbol), np.int64)  # of a new suffix, by the place of the suffix that it grew from
        where[order] = n + np.arange(len(order))
        place[active] = where[at]
        grown = owner[order[is_new]]
        old = ~mask
        columns = []
        for column, new in ((symbol, np.int16(0)), (common, small(0)), (owner, grown), (size, (sizes - begins)[grown] + j)):
            fuller = np.empty(total, column.dtype)
            fuller[old] = column
            fuller[mask] = new
            columns.append(fuller)
        symbol, common, owner, size = columns
        common[n + t] = value
    keep = size >= length
    run = np.cumsum(~((common >= length) & np.concatenate([[False], keep[:-1]]))) if len(common) else common
    return owner[keep].astype(np.int64), sizes[owner[keep]] - size[keep], run[keep]


def _of_worker(length: int) -> Cutter:
    return kept_in_worker(("cutter", length), lambda: Cutter(length))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for b in batches:
        texts = b.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_key"), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
            names=["doc_id", "text_key", "n_bytes", "sha"],
        )


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _of_worker(length)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                hashes, nth = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
                for text in part.column("text").to_pylist():
                    h, counts = np.unique(cutter.runs(text)[0], return_counts=True)
                    twice = h[counts > 1]
                    hashes.append(np.concatenate([h, twice]))
                    nth.append(np.repeat(np.array([0, 1], np.int8), [len(h), len(twice)]))
                docs = part.column("doc_id").take(pa.array(np.repeat(np.arange(part.num_rows), [len(h) for h in hashes[1:]])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), docs, pa.array(np.concatenate(nth))], names=["anchor", "doc_id", "nth"])

    return run


def _run_rows(length: int):
    """Runs of windows under a shared minimizer; r1 and r2 are a 128-bit hash of the run's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cutter, digest = _of_worker(length), xxhash.xxh3_128_digest
        names = ["anchor", "r1", "r2", "start", "windows", "left", "doc_id", "text_key"]
        for b in batches:
            for low in range(0, b.num_rows, 200):
                part = b.slice(low, 200)
                columns, counts, ids = [], [], []
                for text, shared in zip(part.column("text").to_pylist(), part.column("shared").to_pylist(), strict=True):
                    h, start, count, left = cutter.runs(text)
                    keep = np.isin(h, np.array(shared, np.int64))
                    columns.append((h[keep], start[keep], count[keep], left[keep]))
                    counts.append(int(keep.sum()))
                    ids += [digest(text[s : s + c]) for s, c in zip(start[keep].tolist(), (count[keep] + length - 1).tolist(), strict=True)]
                h, start, count, left = map(np.concatenate, zip(*columns, strict=True))
                halves = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
                at = pa.array(np.repeat(np.arange(part.num_rows), counts))
                numbers = [h, np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), start]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, numbers), pa.array(count, pa.int32()), pa.array(left, pa.int32()), part.column("doc_id").take(at), part.column("text_key").take(at)], names=names
                )

    return run


_STRING = ["context", "string", "begin", "doc_id", "text_key", "start"]


def _string_rows(length: int):
    """The bytes of the runs that are asked for, with the place of the minimizer in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 200):
                part = b.slice(low, 200)
                asked = part.column("asked")
                flat = asked.flatten()
                at = pa.array(np.repeat(np.arange(part.num_rows), np.diff(asked.offsets.to_numpy())))
                anchor, start, windows, left, many = (flat.field(k) for k in ("anchor", "start", "windows", "left", "many"))
                texts = part.column("text").to_pylist()
                strings = [texts[i][s : s + w + length - 1] for i, s, w in zip(at.to_pylist(), start.to_pylist(), windows.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([anchor, pa.array(strings, pa.binary()), left, part.column("doc_id").take(at), part.column("text_key").take(at), start, many], names=[*_STRING, "many"])

    return run


def split_context(string: bytes, begin: int, span: int, length: int) -> list[tuple[int, bytes, int, int]]:
    """A string, whose windows all hold the `span` bytes from begin, cut in two whose windows all hold about half of the missing bytes more.

    The windows that reach `half` bytes or more to the left of begin go to the first, the others, which reach further to
    the right, to the second: (offset in the string, bytes, begin, span).
    """
    half = (length - span + 1) // 2
    out = []
    if begin >= half:
        out.append((0, string[: begin - half + length], begin - half, span + half))
    low = max(0, begin - half + 1)
    if len(string) - low >= length:
        out.append((low, string[low:], begin - low, length + 1 - half))
    return out


def _split_rows(length: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names, types = [*_STRING, "span", "r1", "r2"], [pa.int64(), pa.binary(), pa.int32(), kind, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        for b in batches:
            rows = []
            for string, begin, doc, key, start, span in zip(*(b.column(c).to_pylist() for c in [*_STRING[1:], "span"]), strict=True):
                for offset, part, at, wide in split_context(string, begin, span, length):
                    r1, r2 = np.frombuffer(xxhash.xxh3_128_digest(part), np.int64).tolist()
                    context = np.frombuffer(xxhash.xxh3_64_digest(part[at : at + wide]), np.int64)[0].item()
                    rows.append((context, part, at, doc, key, start + offset, wide, r1, r2))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _spans(docs: list, keys: list, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "text_key", "start", "end"])


def _repeats(rows: list[tuple], length: int, kind: pa.DataType) -> pa.RecordBatch | None:
    """Of a bucket of distinct runs (string, begin, doc, key, start), the windows that stand earlier in another run."""
    string, offset, run = suffix_classes([r[0] for r in rows], length, [r[1] for r in rows])
    rank = {d: i for i, d in enumerate(sorted({r[2] for r in rows}))}
    doc, start = np.array([rank[r[2]] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
    at = start[string] + offset
    key = doc[string] << np.int64(40) | at
    if not len(run):
        return None
    firsts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    least = np.repeat(np.minimum.reduceat(key, firsts), np.diff(np.append(firsts, len(run))))
    late = key > least
    string, at = string[late], at[late]
    if not len(string):
        return None
    order = np.lexsort((at, string))
    string, at = string[order], at[order]
    edge = np.flatnonzero(np.concatenate([[True], (string[1:] != string[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.append(edge[1:], len(at)) - 1
    return _spans([rows[i][2] for i in string[edge]], [rows[i][3] for i in string[edge]], at[edge], at[last] + 1, kind)


def _buckets(length: int, most: int, kind: pa.DataType):
    """Rows sorted by context: whole groups of one context are gathered into buckets of about `most` runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, last = [], None
        for b in batches:
            for context, *row in zip(*(b.column(c).to_pylist() for c in _STRING), strict=True):
                if context != last:
                    if len(bucket) >= most:
                        if (out := _repeats(bucket, length, kind)) is not None:
                            yield out
                        bucket = []
                    last = context
                bucket.append(row)
        if bucket and (out := _repeats(bucket, length, kind)) is not None:
            yield out

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            removed, spans, digests, kept_bytes = [], [], [], []
            for text, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True):
                edges = np.zeros(len(text) + 1, np.int64)
                np.add.at(edges, np.array([s["start"] for s in found]), 1)
                np.add.at(edges, np.array([s["end"] - 1 + length for s in found]), -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                digests.append(hashlib.sha256(kept).digest())
                kept_bytes.append(kept)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept_bytes, pa.binary())],
                names=["c_id", "c_key", "c_removed", "c_spans", "c_sha", "kept"],
            )

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = 100, bucket: int = 2_000, group: int = 20_000, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each byte that lies in a string of `length` bytes that also starts earlier: in a smaller id, or before it in the same document.

    Documents of one text keep the bytes of the least id only. Of the others, windows are cut into runs under one
    minimizer, and only minimizers that occur twice go on. Equal runs are one string of the collection, that of the
    earliest; the others are repeats of it. Where a minimizer has different runs, their bytes meet, once each, and each
    bucket of them is ordered by suffix_classes, whose common prefixes of `length` or more give the windows that are
    equal in different runs. Groups of one minimizer of more than `group` runs are split by longer contexts around it
    (split_context), which takes equal windows to one group again; the parts become distinct anew and are split further
    while they are larger, at most until the context is a whole window.

    Texts are UTF-8 bytes; null is empty; a null id loses and removes nothing; rows that share an id count as one
    document, in which a string that starts at a smaller place comes first; repeated rows give repeated results; an empty
    table gives no rows. Other columns are ignored.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept, the kept bytes of documents that lose some.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = plain.schema["doc_id"].dataType.simpleString()
    arrow_kind = to_arrow_type(plain.schema["doc_id"].dataType)
    every = staged(plain.mapInArrow(_digest, f"doc_id {kind}, text_key long, n_bytes long, sha binary"), "bytes")
    firsts = staged(every.where(F.col("doc_id").isNotNull()).groupBy(F.col("sha").alias("f_sha")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "firsts")  # a table of its own, so that the join can split a hot key
    every = every.join(firsts, F.col("sha") == F.col("f_sha"), "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_bytes") >= length))
    every = every.select("doc_id", "text_key", "n_bytes", "sha", "copy")

    known = plain.where(F.col("doc_id").isNotNull())
    anchors = known.select("doc_id", "text").mapInArrow(_anchor_rows(length), f"anchor long, doc_id {kind}, nth byte")
    shared = with_partner(anchors, ["anchor"], F.lit(True)).groupBy(F.col("doc_id").alias("s_id")).agg(F.collect_set("anchor").alias("shared"))
    look = every.where("not copy").select(F.col("doc_id").alias("l_id"), F.col("text_key").alias("l_key")).distinct().join(shared, F.col("l_id") == F.col("s_id"))
    candidates = known.join(look, (F.col("doc_id") == F.col("l_id")) & (F.col("text_key") == F.col("l_key"))).select("doc_id", "text_key", "text", "shared")
    candidates = staged(candidates, "candidates")

    runs = staged(candidates.mapInArrow(_run_rows(length), f"anchor long, r1 long, r2 long, start long, windows int, left int, doc_id {kind}, text_key long"), "runs")
    earlier = (F.col("other.doc_id") < F.col("mine.doc_id")) | ((F.col("other.doc_id") == F.col("mine.doc_id")) & (F.col("other.start") < F.col("mine.start")))
    spans = with_partner(runs, ["anchor", "r1", "r2"], earlier).select("doc_id", "text_key", "start", (F.col("start") + F.col("windows")).alias("end"))

    several = runs.groupBy(F.col("anchor").alias("s_anchor")).agg(F.min("r1").alias("low"), F.max("r1").alias("high")).where("low < high").select("s_anchor")
    distinct = runs.join(staged(several, "several"), F.col("anchor") == F.col("s_anchor")).groupBy("anchor", "r1", "r2").agg(F.min(F.struct("doc_id", "start", "text_key", "windows", "left")).alias("f"))
    distinct = staged(distinct.select("anchor", "f.*"), "distinct")
    large = distinct.groupBy(F.col("anchor").alias("g_anchor")).agg((F.count("*") > group).alias("many")).where("many")
    asked = distinct.join(large, F.col("anchor") == F.col("g_anchor"), "left").select(F.col("doc_id").alias("q_id"), F.col("text_key").alias("q_key"), F.struct("anchor", "start", "windows", "left", F.coalesce("many", F.lit(False)).alias("many")).alias("a"))
    asked = asked.groupBy("q_id", "q_key").agg(F.collect_list("a").alias("asked"))
    texts = candidates.select("doc_id", "text_key", "text").join(asked, (F.col("doc_id") == F.col("q_id")) & (F.col("text_key") == F.col("q_key"))).select("doc_id", "text_key", "text", "asked")
    strings = staged(texts.mapInArrow(_string_rows(length), f"context long, string binary, begin int, doc_id {kind}, text_key long, start long, many boolean"), "strings")
    whole = F.lit(GRAM >= length)  # a context can't grow
    met = strings.where(whole | ~F.col("many")).select(*_STRING)

    rest = strings.where(~whole & F.col("many")).select(*_STRING, F.lit(GRAM).alias("span"))
    while not rest.isEmpty():  # at most as often as the missing bytes of a context can be halved
        parts = staged(rest.mapInArrow(_split_rows(length, arrow_kind), f"context long, string binary, begin int, doc_id {kind}, text_key long, start long, span int, r1 long, r2 long"), "parts")
        keys = parts.select("context", "r1", "r2", "doc_id", "text_key", "start", (F.octet_length("string") - length + 1).alias("windows"))
        spans = spans.unionByName(with_partner(keys, ["context", "r1", "r2"], earlier).select("doc_id", "text_key", "start", (F.col("start") + F.col("windows")).alias("end")))
        distinct = staged(parts.groupBy("context", "r1", "r2").agg(F.min(F.struct("doc_id", "start", "text_key", "begin", "span", "string")).alias("f")).select("context", "f.*"), "distinct")
        sizes = distinct.groupBy(F.col("context").alias("g_context")).agg(F.count("*").alias("n")).where("n > 1")
        sized = staged(distinct.join(sizes, F.col("context") == F.col("g_context")), "sized")
        met = met.unionByName(sized.where((F.col("n") <= group) | (F.col("span") >= length)).select(*_STRING))
        rest = sized.where((F.col("n") > group) & (F.col("span") < length)).select(*_STRING, "span")

    found = met.repartition(shuffle_parts(spark), "context").sortWithinPartitions("context", "doc_id", "start").mapInArrow(_buckets(length, bucket, arrow_kind), f"doc_id {kind}, text_key long, start long, end long")
    spans = spans.unionByName(found)
    spans = staged(spans.groupBy(F.col("doc_id").alias("a_id"), F.col("text_key").alias("a_key")).agg(F.collect_set(F.struct("start", "end")).alias("found")), "spans")
    hit = candidates.join(spans, (F.col("doc_id") == F.col("a_id")) & (F.col("text_key") == F.col("a_key"))).select("doc_id", "text_key", "text", "found")
    cut = hit.mapInArrow(_cut(length), f"c_id {kind}, c_key long, c_removed long, c_spans long, c_sha binary, kept binary")
    if not with_text:
        cut = cut.drop("kept")
    out = every.join(cut.dropDuplicates(["c_id", "c_key"]), (F.col("doc_id") == F.col("c_id")) & (F.col("text_key") == F.col("c_key")), "left")
    return out.select(
        "doc_id", "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("c_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("c_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("c_sha", "sha")))).alias("kept_sha256"),
        *(["kept"] if with_text else []),
    )
