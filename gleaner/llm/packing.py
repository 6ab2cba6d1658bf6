"""Packing of token sequences (operator 6)."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, staged

# Letters and numbers that every Unicode version has alike reach to U+024F; texts with others go to the tokenizer whole.
_BEYOND = re.compile("[ɐ-\U0010ffff]")

# Sequences are numbered within parts: partitions first, then, from MERGED on, the groups of leftovers of each level.
MERGED, GROUPS = 1 << 30, 1 << 20


class Ids:
    """Token ids of texts as little-endian 32-bit bytes, from a byte-level BPE file of the tokenizers library.

    Texts are encoded whole by ranks read from that file, which is faster than the tokenizer. Texts with letters that
    Unicode versions may know differently, and those that hold the string of a special token, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.added = sorted(x["content"] for x in held["added_tokens"])
        added = set(self.added)
        # Fixed rule of byte-level files: printable bytes stand for themselves, the others follow from U+0100.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in k): v for k, v in held["model"]["vocab"].items() if k not in added}
        # Fixed value: the splitting pattern of such files.
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.ranks = tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """By the tokenizer itself."""
        return b"".join(i.to_bytes(4, "little") for i in self.model.encode(text, add_special_tokens=False).ids)

    def of(self, text: str) -> bytes:
        if any(s in text for s in self.added) or not text.isascii() and _BEYOND.search(text):
            return self.encode(text)
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


class Bins:
    """Open windows of one partition: best fit; when none fits, the fullest leaves."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.by_room: list[tuple[int, int]] = []  # (room, number), ascending
        self.held: dict[int, list] = {}
        self.next = 0

    def room_for(self, length: int) -> int | None:
        """Place in by_room of the tightest window that has room for length."""
        i = bisect_left(self.by_room, (length, -1))
        return i if i < len(self.by_room) else None

    def put(self, i: int, piece: tuple, length: int) -> list | None:
        """Add to the window at i; its pieces if it is now full."""
        room, n = self.by_room.pop(i)
        self.held[n].append(piece)
        if room == length:
            return self.held.pop(n)
        insort(self.by_room, (room - length, n))
        return None

    def open(self) -> int:
        n, self.next = self.next, self.next + 1
        self.held[n] = []
        insort(self.by_room, (self.size, n))
        return bisect_left(self.by_room, (self.size, n))

    def fullest(self) -> list:
        _, n = self.by_room.pop(0)
        return self.held.pop(n)


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "seq", "offset", "left"]


def _rows(window: list, part: int, seq: int, left: bool) -> list[tuple]:
    out, offset = [], 0
    for doc, start, length, crc, total in window:
        out.append((doc, start, length, crc, total, part, seq, offset, left))
        offset += length
    return out


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, *[pa.int64()] * 7, pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)


def _pack(path: str, size: int, most: int, slack: int, id_type: pa.DataType):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bins, rows, seq, part = kept_in_worker(("ids", path), lambda: Ids(path)), Bins(size, most), [], 0, TaskContext.get().partitionId()
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = ids.of(text or "") + b"\0\0\0\0"
                total, at = len(data) // 4, 0
                while at < total:
                    length = min(size, total - at)
                    i = bins.room_for(length)
                    if i is None and len(bins.by_room) >= most:
                        room = bins.by_room[0][0]
                        if room > slack:  # cut: the fullest leaves full, the rest is placed anew
                            i, length = 0, room
                        else:
                            rows += _rows(bins.fullest(), part, seq, False)
                            seq += 1
                    if i is None:
                        i = bins.open()
                    piece = (doc, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), total)
                    at += length
                    if full := bins.put(i, piece, length):
                        rows += _rows(full, part, seq, False)
                        seq += 1
                if len(rows) >= 20_000:
                    yield _batch(rows, id_type)
                    rows = []
        for n in list(bins.held):
            rows += _rows(bins.held[n], part, seq, True)
            seq += 1
        if rows:
            yield _batch(rows, id_type)

    return pack


def _merge(size: int, level: int, id_type: pa.DataType):
    """Leftover windows of several partitions, each kept whole, put together best fit in falling order of length."""

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        windows: dict[tuple, list] = {}
        for r in rows.sort_by([("part", "ascending"), ("seq", "ascending"), ("offset", "ascending")]).to_pylist():
            windows.setdefault((r["part"], r["seq"]), []).append(tuple(r[k] for k in _NAMES[:5]))
        bins, out, seq = Bins(size, len(windows)), [], 0
        used = {k: sum(p[2] for p in w) for k, w in windows.items()}
        for k in sorted(windows, key=lambda k: (-used[k], k)):
            i = bins.room_for(used[k])
            if i is None:
                i = bins.open()
            room, n = bins.by_room.pop(i)
            bins.held[n] += windows[k]
            insort(bins.by_room, (room - used[k], n))
        part = MERGED + level * GROUPS + key[0].as_py()
        # What is half empty can still be put together with that of other groups.
        for room, n in bins.by_room:
            out += _rows(bins.held[n], part, seq, 2 * room >= size)
            seq += 1
        return pa.Table.from_batches([_batch(out, id_type)])

    return merge


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, open_windows: int = 64, slack: int = 8, fan_in: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `size` tokens.

    Each partition keeps at most open_windows windows. A piece (a document, or `size` tokens of one) goes to the window
    that it fits best. When none fits, the fullest leaves: as it is if at most `slack` tokens are free, else filled up
    with the head of the piece, whose rest is placed anew. What stays open at a partition's end is put together with
    the leftovers of fan_in partitions, then of fan_in such groups and so on, so no task gets more than fan_in *
    open_windows windows. `size` - length ids of padding end a sequence, but for lengths that are a power of two.

    Null or empty text is the end id (0) alone; documents of any length are cut; repeated rows are packed as often as
    they occur; an empty table gives no rows. Other columns are ignored.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, part long, seq long, offset long, left boolean"
    packed = staged(docs.mapInArrow(_pack(tokenizer, size, open_windows, slack, to_arrow_type(kind)), schema), "packed")
    done = [packed.where("not left")]
    rest, level = packed.where("left"), 0
    groups = (rest.agg(F.max("part")).first()[0] or 0) + 1
    while groups > 1 or level == 0:
        groups = -(-groups // fan_in)
        number = F.when(F.col("part") < MERGED, F.col("part")).otherwise(F.col("part") % GROUPS)
        rest = staged(rest.withColumn("group", F.floor(number / fan_in).cast("long")).groupBy("group").applyInArrow(_merge(size, level, to_arrow_type(kind)), schema), "merged")
        done.append(rest.where("not left"))
        rest, level = rest.where("left"), level + 1
    out = done[0]
    for d in [*done[1:], rest]:
        out = out.unionByName(d)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("part") * (1 << 32) + F.col("seq")).alias("sequence_id"), "offset")
