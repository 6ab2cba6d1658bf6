"""Alignment of two tokenizers over the same bytes (operator 11)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import DOCS, SCAN, parts, totals, with_values
from .common import kept_in_worker, staged
from .packing import _BEYOND, Ids

LINK = 0
# A space after one of these signs, which are white space to no version of Unicode, begins a token of both tokenizers.
_BEFORE = "!-~¡-ᙿ、-퟿"
_SPACE = re.compile(f"(?<=[{_BEFORE}]) ")
_ODD_SPACE = re.compile(f"(?<![{_BEFORE}]) ")
_CLEAN = re.compile(f"[{_BEFORE}]$")


class Signs(dict):
    """At most two entries for each id of both vocabularies: texts of ids with the sign after them: 2 * id before `|` and 2 * id + 1 before `,` of the first side; -2 - 2 * id before `,` and one less before `;` of the other."""

    def __missing__(self, k: int) -> str:
        i, odd = divmod(k if k >= 0 else -2 - k, 2)
        self[k] = text = f"{i}{(',' if odd else '|') if k >= 0 else (';' if odd else ',')}"
        return text


class Tokens:
    """Tokens of space + text by both tokenizers, as ids and byte lengths, of segments that are remembered.

    A segment is a space and what follows it up to the next space that begins a token for certain; neither tokenizer puts bytes of two segments
    in one token: byte-level files split there, and no piece of the other has a space after anything else (else texts are
    one segment). A segment whose tokens don't give back its bytes makes its text one without tokens.
    """

    def __init__(self, a_path: str, b_path: str, most: int = 6_000_000):
        import sentencepiece

        a = Ids(a_path)
        self.slow, self.fast = a.model, a.ranks
        self.slow.encode_special_tokens = True  # their strings are plain text here
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = [self.fast.decode_single_token_bytes(i) for i in range(self.fast.n_vocab)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.most, self.signs = most, Signs()
        self.forget()

    def forget(self) -> None:
        """Tokens of `most` are held of both tokenizers together, then all are forgotten."""
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]  # of all segments, one after another
        self.sizes = [np.zeros(0, np.int64), np.zeros(0, np.int64)]  # how many each segment has
        self.good = np.zeros(0, bool)

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of a space and the text."""
        plain = text.isascii() or not _BEYOND.search(text)
        a = self.fast.encode_to_numpy(" " + text, disallowed_special=()) if plain else self.slow.encode(" " + text, add_special_tokens=False).ids
        return np.asarray(a, np.int32), np.asarray(self.b.encode(text), np.int32)

    def _rightly(self, a: np.ndarray, b: np.ndarray, data: bytes) -> bool:
        return all(b"".join(map(table.__getitem__, ids.tolist())) == data for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))

    def learn(self, segments: list[str]) -> None:
        """Tokens of new segments (without their first spaces): of those that end where a token does, all at once."""
        together = [s for s in segments if s and _CLEAN.search(s)]
        if sum(map(len, together)) > 40 * len(together):
            together = []  # long ones would wait for each other
        alone = [s for s in segments if s not in set(together)] if len(together) < len(segments) else []
        if together:
            text = " ".join(together)
            a, b = self._encode(text)
            if self._rightly(a, b, (" " + text).encode()):
                ends = np.cumsum([len(s.encode()) + 1 for s in together])
                upto = [np.searchsorted(np.cumsum(size[ids]), ends) + 1 for ids, size in ((a, self.a_size), (b, self.b_size))]
                self._hold(together, [a, b], [np.diff(u, prepend=0) for u in upto], np.ones(len(together), bool))
            else:
                alone += together
        for s in alone:
            a, b = self._encode(s)
            good = self._rightly(a, b, (" " + s).encode())
            held = (a, b) if good else (a[:0], b[:0])
            self._hold([s], list(held), [np.array([len(x)]) for x in held], np.array([good]))

    def _hold(self, segments: list[str], ids: list[np.ndarray], sizes: list[np.ndarray], good: np.ndarray) -> None:
        self.known.update(zip(segments, range(len(self.good), len(self.good) + len(segments)), strict=True))
        for k in (0, 1):
            self.ids[k], self.sizes[k] = np.concatenate([self.ids[k], ids[k]]), np.concatenate([self.sizes[k], sizes[k]])
        self.good = np.concatenate([self.good, good])

    def segments(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        # Several spaces, or other white space before one: only those after a sign divide.
        out = _SPACE.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        if not out[-1]:  # a space at the end
            out[-2:] = [out[-2] + " "]
        return out

    def of(self, texts: list[str]) -> tuple:
        """Of both tokenizers (ids, byte lengths, how many each text has); texts without tokens have none."""
        if sum(map(len, self.ids)) > self.most:
            self.forget()
        found = [self.segments(t) if t else [] for t in texts]
        flat = [s for own in found for s in own]
        numbers = list(map(self.known.get, flat))
        if None in numbers:
            self.learn(list(dict.fromkeys(s for s, n in zip(flat, numbers, strict=True) if n is None)))
            numbers = list(map(self.known.__getitem__, flat))
        numbers, doc = np.array(numbers, np.int64), np.repeat(np.arange(len(texts)), list(map(len, found)))
        bad = np.bincount(doc[~self.good[numbers]], minlength=len(texts)) > 0
        if bad.any():
            numbers, doc = numbers[~bad[doc]], doc[~bad[doc]]
        out = []
        for ids, sizes, table in zip(self.ids, self.sizes, (self.a_size, self.b_size), strict=True):
            first, n = (np.cumsum(sizes) - sizes)[numbers], sizes[numbers]
            upto = np.cumsum(n)
            tokens = ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - (upto - n), n)]
            out.append((tokens, table[tokens], np.bincount(doc, n, len(texts)).astype(np.int64)))
        return tuple(out)


def shared_cuts(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> np.ndarray:
    """Whether each of the ends in a is one in b too, by dividing and conquering many texts at once.

    a, b: ascending ends of tokens; a_last, b_last: places in them of the last tokens of every text, which end alike. An
    interval is a run of tokens of either side between two shared ends. Of each, the end of the token in a's middle is looked
    for in b by bisection; if it is not there, the nearest ends to its right, of one side and the other in turn, are, and then
    those to its left, until one is shared. Both halves are divided in the next round. An interval without a cut, or of one token
    on a side, is a leaf.
    """
    cut = np.zeros(len(a), bool)
    cut[a_last] = True
    lo_a, hi_a = np.concatenate([[-1], a_last[:-1]]), a_last  # the tokens (lo, hi]
    lo_b, hi_b = np.concatenate([[-1], b_last[:-1]]), b_last
    while True:
        open_ = (hi_a - lo_a > 1) & (hi_b - lo_b > 1)
        lo_a, hi_a, lo_b, hi_b = lo_a[open_], hi_a[open_], lo_b[open_], hi_b[open_]
        if not len(lo_a):
            return cut
        start = (lo_a + hi_a) // 2
        at_a, at_b = np.full(len(start), -1), np.full(len(start), -1)
        for step in (1, -1):
            left = np.flatnonzero(at_a < 0)
            i = start[left] if step == 1 else start[left] - 1
            while len(left):
                inside = (i < hi_a[left]) & (i > lo_a[left])
                left, i = left[inside], i[inside]
                # From the end of a's token to b's nearest in this direction, and back to a's nearest of that.
                j = np.searchsorted(b, a[i], "left" if step == 1 else "right") - (step == -1)
                found = (j > lo_b[left]) & (j < hi_b[left]) & (b[np.clip(j, 0, len(b) - 1)] == a[i])
                at_a[left[found]], at_b[left[found]] = i[found], j[found]
                left, i, j = left[~found], i[~found], j[~found]
                inside = (j > lo_b[left]) & (j < hi_b[left])
                left, j = left[inside], j[inside]
                i = np.searchsorted(a, b[j], "left" if step == 1 else "right") - (step == -1)
        split = at_a >= 0
        cut[at_a[split]] = True
        lo_a, hi_a = np.stack([lo_a, at_a], 1)[split].ravel(), np.stack([at_a, hi_a], 1)[split].ravel()
        lo_b, hi_b = np.stack([lo_b, at_b], 1)[split].ravel(), np.stack([at_b, hi_b], 1)[split].ravel()


class Aligned:
    """Groups and links of a batch of texts."""

    def __init__(self, tokens: Tokens, texts: list[str]):
        (self.a, a_size, self.n_a), (self.b, b_size, self.n_b) = tokens.of(texts)
        self.signs = tokens.signs
        self.a_end, self.b_end = np.cumsum(a_size), np.cumsum(b_size)
        full = self.n_a > 0
        a_upto, b_upto = np.cumsum(self.n_a), np.cumsum(self.n_b)
        self.cut = shared_cuts(self.a_end, self.b_end, a_upto[full] - 1, b_upto[full] - 1)
        self.b_cut = np.zeros(len(self.b), bool)
        self.b_cut[np.searchsorted(self.b_end, self.a_end[self.cut])] = True
        before = np.concatenate([[0], np.cumsum(self.cut)])
        self.n_groups = before[a_upto] - before[a_upto - self.n_a]
        self.n_links = self.n_a + self.n_b - self.n_groups  # within a group each further token of a side is one more

    def links(self) -> np.ndarray:
        """(a id, b id) of every link as one number, in order: bytes between two neighbouring ends, of either side, belong to one token of each."""
        b_only = self.b_end[~self.b_cut]
        ends = np.insert(self.a_end, np.searchsorted(self.a_end, b_only), b_only)
        return (self.a[np.searchsorted(self.a_end, ends)].astype(np.int64) << 32) | self.b[np.searchsorted(self.b_end, ends)]

    def groups(self) -> Iterator[tuple]:
        """Of every text: ids of a and b, and how many of each every group has."""
        a = b = 0
        for n_a, n_b in zip(self.n_a, self.n_b, strict=True):
            counts = (np.diff(np.flatnonzero(c), prepend=-1) for c in (self.cut[a : a + n_a], self.b_cut[b : b + n_b]))
            yield self.a[a : a + n_a], self.b[b : b + n_b], *counts
            a, b = a + n_a, b + n_b

    def digests(self) -> list[str]:
        """SHA-256 of each text's `a1,a2|b1;a3|b2,b3`; '' of one without tokens."""
        group_a = np.cumsum(self.cut) - self.cut
        group_b = np.cumsum(self.b_cut) - self.b_cut
        groups = int(self.cut.sum())
        a_before, b_before = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=groups))]) for g in (group_a, group_b))
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + b_before[group_a]] = np.where(self.cut, -1, 0) + 2 * self.a.astype(np.int64) + 1
        order[np.arange(len(self.b)) + a_before[group_b + 1]] = -2 - (2 * self.b.astype(np.int64) + self.b_cut)
        parts = list(map(self.signs.__getitem__, order.tolist()))
        out, at = [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256("".join(parts[at : at + n])[:-1].encode()).hexdigest() if n else "")
            at += n
        return out


def _tokens(a_path: str, b_path: str) -> Tokens:
    return kept_in_worker(("tokens", a_path, b_path), lambda: Tokens(a_path, b_path))


_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
_FOUND = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]


def _found(x: Aligned, pairs: dict[int, int]) -> tuple[dict[str, pa.Array], np.ndarray]:
    """The columns _FOUND of a batch of texts, and how often each pair of ids is linked; pairs are numbered in the block as they come.

    A text's pairs are ascending numbers, each as the step from the one before, with how often it has them.
    """
    keys, inverse = np.unique(x.links(), return_inverse=True)
    number = np.fromiter((pairs.setdefault(k, len(pairs)) for k in keys.tolist()), np.int64, len(keys))[inverse]
    n = np.bincount(number, minlength=len(pairs))
    doc = np.repeat(np.arange(len(x.n_a)), x.n_links)
    held, times = np.unique((doc << 32) | number, return_counts=True)
    number = held & 0xFFFFFFFF
    upto = np.cumsum(np.bincount(held >> 32, minlength=len(x.n_a)))
    first = np.concatenate([[0], upto[:-1]])
    steps = np.diff(number, prepend=0)  # ascending in each text, from 0 on
    begins = first[first < upto]
    steps[begins] = number[begins]
    offsets = pa.array(np.concatenate([[0], upto]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (steps, times)]
    counts = (pa.array(c.astype(np.int64)) for c in (x.n_a, x.n_b, x.n_groups, x.n_links))
    return dict(zip(_FOUND, [*counts, pa.array(x.digests(), pa.string()), *lists], strict=True)), n


_ROW = {"block": "long", "kind": "int", "key": "long", "n": "long", "at": "int", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "pairs": "array<int>", "times": "array<int>"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _link(a_path: str, b_path: str, most: int, id_type: pa.DataType):
    """Rows of documents, with what _found says, and of the pairs of each block: (block, kind, key, n, at)."""
    types = {"doc_id": id_type} | {c: _ARROW[t] for c, t in _ROW.items()}

    def rows(size: int, block: int, kind: int, given: dict) -> pa.RecordBatch:
        given = given | {"block": pa.array(np.full(size, block)), "kind": pa.array(np.full(size, kind, np.int32))}
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(size, t) for c, t in types.items()], names=list(types))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(a_path, b_path)
        block, pairs, total = TaskContext.get().partitionId() << 32, {}, np.zeros(0, np.int64)
        for b in batches:
            for part in parts(b):
                columns, n = _found(Aligned(tokens, part.column("text").to_pylist()), pairs)
                yield rows(part.num_rows, block, DOCS, {"doc_id": part.column("doc_id")} | columns)
                total = np.pad(total, (0, len(pairs) - len(total))) + np.pad(n, (0, len(pairs) - len(n)))
                if len(pairs) >= most:
                    yield from ended(block, pairs, total)
                    block, pairs, total = block + 1, {}, np.zeros(0, np.int64)
        yield from ended(block, pairs, total)

    def ended(block: int, pairs: dict[int, int], total: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for i in range(0, len(keys), 50_000):
            some = keys[i : i + 50_000]
            yield rows(len(some), block, LINK, {"key": pa.array(some), "n": pa.array(total[i : i + len(some)]), "at": pa.array(np.arange(i, i + len(some), dtype=np.int32))})

    return link


def _in_order(at: np.ndarray, n: np.ndarray, is_best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(at)
    return n[order], is_best[order]


def _report(held: dict, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lists, times = (rows.column(c) for c in ("pairs", "times"))
    upto = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    steps, often = (x.flatten().to_numpy().astype(np.int64) for x in (lists, times))
    sums = [np.zeros(rows.num_rows, np.int64)] * 2
    if len(steps):
        walked = np.cumsum(steps)
        before = np.concatenate([[0], walked])[upto[:-1]]  # each text's numbers begin anew
        number = walked - np.repeat(before, np.diff(upto))
        sums = []
        for value in held[LINK]:
            run = np.concatenate([[0], np.cumsum(value[number] * often)])
            sums.append(run[upto[1:]] - run[upto[:-1]])
    total, best = sums
    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(best), pa.array(total), rows.column("groups_sha256")], names=_NAMES)


def _groups(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(Aligned(_tokens(a_path, b_path), b.column("text").to_pylist()).groups())
            columns = [pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "a_ids", "b_ids", "a_counts", "b_counts"])

    return run


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tokens of space + text by both tokenizers, and the groups between the byte offsets where both end.

    Texts are divided at shared ends near the middle, found by bisection (see shared_cuts). Null and empty texts, and those
    whose joined tokens are not their bytes, have empty arrays. Repeated rows come as often as they occur, an empty table gives
    none, other columns are ignored.

    Returns doc_id, a_ids, b_ids, a_counts, b_counts (tokens of every group).
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_groups(a_path, b_path), f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_counts array<int>, b_counts array<int>")


def link_counts(links: DataFrame) -> DataFrame:
    """(key, n, is_best): whether a pair of ids is linked as often as any that has its id of the second tokenizer; ties all are.

    A window over ids of the second tokenizer: it has at most as many rows for one id as the first has ids.
    """
    of_b = Window.partitionBy(F.col("key").bitwiseAND((1 << 32) - 1))
    return links.select("key", "n", (F.col("n") == F.max("n").over(of_b)).cast("long").alias("is_best"))


def link_report(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = 1 << 19) -> DataFrame:
    """How each text's tokens by two tokenizers group and link, against the counts of linked id pairs over all documents.

    Tokens are linked where their bytes overlap; see align for the groups. Texts are encoded once; each then carries which
    pairs of ids it links, by their numbers in the dictionary of its block (see blocks). Pairs are summed over the corpus and their counts
    brought back to the blocks that have them. Null and empty texts, and those whose
    tokens don't give back their bytes, have zeros and '' and add nothing to counts. Repeated rows count as often as they
    occur; an empty table gives no rows; other columns are ignored.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in _ROW.items())
    blocks = staged(docs.mapInArrow(_link(a_path, b_path, most, to_arrow_type(kind)), schema), "blocks", SCAN)
    values = link_counts(totals(blocks, LINK)).select(F.lit(LINK).alias("kind"), "key", "n", "is_best")
    out = ", ".join(f"{c} long" for c in _NAMES[1:-1])
    return with_values(blocks, values, _in_order, _report, f"doc_id {kind.simpleString()}, {out}, groups_sha256 string", ("at",), ("doc_id", *_FOUND))
