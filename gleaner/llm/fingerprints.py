"""I-Match fingerprints (operator 4)."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, mix64, range_bucket, shuffle_parts, staged

DENSITIES = (16, 64, 256, 1024, 4096)  # a subset of the lexicon keeps one term in so many
SUBSETS = 16  # randomised subsets of each density, which share no term


class Terms(dict):
    """64-bit hash of the term in a word, 0 for none. Terms are words without the signs around them, ASCII letters lowered."""

    signs = b"""!"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\"""

    def __init__(self, most: int = 1 << 19):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        term = word.strip(self.signs).lower()
        self[word] = h = (xxhash.xxh3_64_intdigest(term) or 1) if term else 0
        return h

    def of(self, text: bytes) -> np.ndarray:
        words = set(text.split())
        got = np.unique(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
        return got[1:] if len(got) and got[0] == 0 else got


def _count(most: int = 1 << 20):
    """How many documents of the task hold each term; what was counted leaves whenever it is more than `most` terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_in_worker(("terms",), Terms)
        terms, df, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merge():
            every = np.concatenate([terms, *waiting])
            weights = np.concatenate([df, np.ones(len(every) - len(df), np.int64)])
            got, place = np.unique(every, return_inverse=True)
            return got, np.bincount(place, weights, len(got)).astype(np.int64)

        out = lambda: pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df)], names=["term", "df"])
        for b in batches:
            for text in b.column(0).to_pylist():
                got = known.of(text or b"")
                waiting.append(got)
                size += len(got)
                if size > most:
                    terms, df = merge()
                    waiting, size = [], 0
                    if len(terms) > most:
                        yield out()
                        terms, df = terms[:0], df[:0]
        terms, df = merge()
        yield out()

    return count


def lexicon(docs: DataFrame, text_col: str = "text", low: float = 0.2, high: float = 0.95) -> tuple[DataFrame, list[int]]:
    """(term) of the terms whose normalised inverse document frequency is in [low, high], counted over all documents, and those below the band.

    The normalised frequency is log(N/df)/log(N). Terms are told apart by 64-bit hashes; each task sums its own first.
    Terms below the band are in N^(1-low) documents or more each, so there are at most N^low times as many as a
    document has on average.
    """
    n = docs.count()
    got = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(_count(), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    scale = float(np.log(max(n, 2)))
    idf = (scale - F.log(F.col("df").cast("double"))) / scale
    got = staged(got.select("term", idf.alias("idf")).where(F.col("idf") <= high), "terms")
    return got.where(F.col("idf") >= low).select("term"), [r.term for r in got.where(F.col("idf") < low).collect()]


class Signer:
    """16-bit signatures of a set of terms, one for each randomised subset of the lexicon: a hash of the terms that it keeps, 0 for none."""

    def __init__(self, seed: int = 7):
        self.salts = mix64(np.arange(1, len(DENSITIES) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def of(self, terms: np.ndarray) -> np.ndarray:
        return self.of_many([terms])[0]

    def of_many(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row for each set of distinct terms."""
        width = len(DENSITIES) * SUBSETS
        out = np.zeros(len(sets) * width, np.uint64)
        first = np.repeat(np.arange(len(sets)) * width, [len(s) for s in sets])
        x = mix64(np.concatenate(sets) * np.uint64(0xD6E8FEB86659FD93))
        for k, (salt, density) in enumerate(zip(self.salts, DENSITIES, strict=True)):
            subset = mix64(x ^ salt) & np.uint64(density - 1)
            mine = np.flatnonzero(subset < SUBSETS)
            np.add.at(out, first[mine] + subset[mine].astype(np.int64) + k * SUBSETS, x[mine] | np.uint64(1))
        out = mix64(out)
        held = out != 0  # mix64 keeps 0
        out &= np.uint64(0xFFFF)
        out[held & (out == 0)] = 1
        return out.astype(">u2").reshape(-1, width)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(likenesses(a[None], b[None])[0])


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each two rows, the share of equal signatures, of those that either text has, at the density where it is largest; 1 if all are equal.

    A density counts if at least a quarter of its subsets hold terms; the densest always does.
    """
    shape = (len(a), len(DENSITIES), SUBSETS)
    equal = a == b
    same, held = (equal & (a > 0)).reshape(shape).sum(2), ((a > 0) | (b > 0)).reshape(shape).sum(2)
    counts = held >= SUBSETS // 4
    counts[:, 0] = True
    return np.where(equal.all(1), 1.0, np.where(counts, same / np.maximum(held, 1), 0.0).max(1))


def from_text(fingerprint: str) -> np.ndarray:
    """The signatures that a fingerprint's hex digits hold."""
    return np.frombuffer(bytes.fromhex(fingerprint), ">u2")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _following(batches: Iterator[pa.RecordBatch], look) -> Iterator[tuple]:
    """(bucket, place in it, doc_id, text, look(text), next text, look(next text)) of every row; `extra` rows only follow, the first of them."""
    before, at = None, 0  # the row whose following one is due, and its place
    for b in batches:
        for bucket, extra, doc, text in zip(*(b.column(k).to_pylist() for k in ("bucket", "extra", "doc_id", "text")), strict=True):
            text = text or ""
            if before and before[0] != bucket:
                before, at = None, 0
            if extra and not before:
                continue  # a further copy of the same successor
            seen = look(text)
            if before:
                yield (*before, text, seen)
                at += 1
            before = None if extra else (bucket, at, doc, text, seen)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 2000) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)


def _edit(text: str, following: str) -> tuple[str, str]:
    new = edited(text, following)
    return new, hashlib.sha256(new.encode()).hexdigest()


def _pair(kept: np.ndarray, id_type: pa.DataType):
    """Fingerprints of rows in order, with a lexicon that every task holds."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signer = kept_in_worker(("terms",), Terms), Signer()

        def banded(sets: list[np.ndarray]) -> list[np.ndarray]:
            """The terms of each set that the lexicon has, or all if it has none."""
            every = np.concatenate(sets)
            inside = kept[np.minimum(np.searchsorted(kept, every), len(kept) - 1)] == every if len(kept) else np.zeros(len(every), bool)
            cuts = np.cumsum([len(x) for x in sets])[:-1]
            return [x[i] if i.any() else x for x, i in zip(sets, np.split(inside, cuts), strict=True)]

        source = _following(batches, lambda text: known.of(text.encode()))
        while rows := list(itertools.islice(source, 500)):
            _, _, docs, texts, own, following, after = map(list, zip(*rows, strict=True))
            edits = [_edit(t, f) for t, f in zip(texts, following, strict=True)]
            # The next row's own terms are those that follow this one, but for the last of a bucket or of this part.
            other = [k for k in range(len(rows)) if k + 1 == len(rows) or rows[k + 1][0] != rows[k][0]]
            prints = signer.of_many(banded([*own, *(known.of(new.encode()) for new, _ in edits), *(after[k] for k in other)]))
            n = len(rows)
            mine, new = prints[:n], prints[n : 2 * n]
            follows = np.vstack([mine[1:], mine[:1]])
            follows[other] = prints[2 * n :]
            hexes = [[x.tobytes().hex() for x in xs] for xs in (mine, new)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, id_type), pa.array(map(len, texts), pa.int64()), pa.array([sha for _, sha in edits]), *map(pa.array, hexes), pa.array(likenesses(mine, new)), pa.array(likenesses(mine, follows))], names=_NAMES
            )

    return pair


def _term_rows(below: np.ndarray, id_type: pa.DataType):
    """The same rows with their terms and those of the edited and the next text, without the terms below the band, and with the fingerprints of all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signer = kept_in_worker(("terms",), Terms), Signer()

        def look(text: str) -> tuple:
            got = known.of(text.encode())
            return np.setdiff1d(got, below, assume_unique=True).view(np.int64), signer.of(got).tobytes()

        def rows():
            for bucket, at, doc, text, own, following, after in _following(batches, look):
                new, sha = _edit(text, following)
                sides = [own, look(new), after]
                yield bucket, at, doc, len(text), sha, *(x for side in sides for x in side)

        types = [pa.int32(), pa.int64(), id_type, pa.int64(), pa.string(), *[pa.list_(pa.int64()), pa.binary()] * 3]
        return _batches(rows(), ["bucket", "at", "doc_id", "n_chars", "edited_sha256", *(f"{x}{k}" for k in range(3) for x in ("terms", "all"))], types)

    return run


def _sign_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signer = Signer()
    for b in batches:
        prints = [signer.of(np.array(t, np.int64).view(np.uint64)).tobytes() for t in b.column("band").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("b"), b.column("a"), b.column("side"), pa.array(prints, pa.binary())], names=["b", "a", "side", "print"])


def _like_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own, new, after = ([np.frombuffer(x or y, ">u2") for x, y in zip(b.column(f"print{k}").to_pylist(), b.column(f"all{k}").to_pylist(), strict=True)] for k in range(3))
        texts = [pa.array([x.tobytes().hex() for x in xs], pa.string()) for xs in (own, new)]
        near = [pa.array([likeness(x, y) for x, y in zip(own, ys, strict=True)], pa.float64()) for ys in (new, after)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_chars"), b.column("edited_sha256"), *texts, *near], names=_NAMES)


def _joined(rows: DataFrame, kept: DataFrame, below: list[int], kind: str, id_type: pa.DataType) -> DataFrame:
    """As _pair, for a lexicon that no task could hold: terms meet it in a join, those below the band left out before."""
    sides = ", ".join(f"terms{k} array<long>, all{k} binary" for k in range(3))
    held = staged(rows.mapInArrow(_term_rows(np.array(below, np.int64).view(np.uint64), id_type), f"bucket int, at long, doc_id {kind}, n_chars long, edited_sha256 string, {sides}"), "rows")
    flat = held.select(F.col("bucket").alias("b"), F.col("at").alias("a"), F.posexplode(F.array(*(f"terms{k}" for k in range(3)))).alias("side", "terms"))
    band = flat.select("b", "a", "side", F.explode("terms").alias("term")).join(kept.hint("merge"), "term", "left_semi").groupBy("b", "a", "side").agg(F.collect_list("term").alias("band"))
    prints = band.mapInArrow(_sign_rows, "b int, a long, side int, print binary").groupBy("b", "a").agg(*(F.max(F.when(F.col("side") == k, F.col("print"))).alias(f"print{k}") for k in range(3)))
    return held.drop("terms0", "terms1", "terms2").join(prints, (F.col("bucket") == F.col("b")) & (F.col("at") == F.col("a")), "left").mapInArrow(_like_rows, f"doc_id {kind}, {_COLUMNS}")


def imatch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.2, high: float = 0.95, most: int = 1 << 22) -> DataFrame:
    """I-Match fingerprint of every document and of its edited text, with how like they are.

    Terms in the inverse-document-frequency band (see lexicon; all terms of a text that has none there) are sorted and
    hashed within SUBSETS random subsets of the lexicon at each of several densities; the fingerprint is the signatures
    of four hex digits, 0000 for a subset that holds none of the text's terms. The next document is the next in order of
    id, after the last the first; the documents go to ranges of ids, and the first document of a range also goes, as an
    extra row, to the range before.

    A lexicon of at most `most` terms (8 bytes each) goes to the tasks; a larger one meets the documents' terms in a
    join, with the same rows.

    Null text is empty; rows of one id follow in order of text; a null id comes first. One document alone follows
    itself. Other columns are ignored. Ranges are cut by the ids' numbers; ids that are no numbers are all in one.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType
    kind, arrow = id_type.simpleString(), to_arrow_type(id_type)
    kept, below = lexicon(docs, "text", low, high)
    parts = shuffle_parts(spark)
    bucket = range_bucket(docs, "doc_id", 4 * parts)
    # At most 4 rows a shuffle partition: the first id of every range.
    heads = sorted((r.bucket, r.first is not None, r.first) for r in docs.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).getField("doc_id").alias("first")).collect())
    if not heads:
        return spark.createDataFrame([], f"doc_id {kind}, {_COLUMNS}")
    after = [(first, heads[i - 1][0], 0 if i else 1) for i, (_, _, first) in enumerate(heads)]
    goes = spark.createDataFrame(after, f"head {kind}, prior int, wraps int")
    here = F.struct(bucket.alias("bucket"), F.lit(0).alias("extra"))
    # One row for every range: the broadcast is bounded.
    rows = docs.join(F.broadcast(goes), F.col("doc_id").eqNullSafe(F.col("head")), "left").select(
        "doc_id", "text", F.explode(F.when(F.col("prior").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("prior").alias("bucket"), (1 + F.col("wraps")).alias("extra"))))).alias("at")
    )
    rows = rows.select("at.bucket", "at.extra", "doc_id", "text").repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", "doc_id", "text")
    if kept.count() > most:
        return _joined(rows, kept, below, kind, arrow)
    terms = np.sort(kept.toArrow().column("term").combine_chunks().to_numpy().view(np.uint64))
    return rows.mapInArrow(_pair(terms, arrow), f"doc_id {kind}, {_COLUMNS}")
