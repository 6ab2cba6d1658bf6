"""Language identification in two steps: family, then one-versus-one linear SVMs (operator 10)."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, staged, unused

DIMS = 1 << 12
# Families of closely related languages; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ca", "ro", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
PASS, LOST = 0.05, 0.005  # fixed values: shares of doubtful texts that may pass, and of clean texts that may go, where the score has its floor
_ascii_letter = re.compile("[A-Za-z]")
SPACE = 1 << 62  # hashed ids
UNIT = float(1 << 32)  # weights are summed as whole numbers of 1/UNIT, so their sums do not hang on an order
LIMITS = 1 / (1 + np.exp(-np.arange(5, 51) / 25))  # floors that are tried


def _gram_table() -> np.ndarray:
    """A random 64-bit number for each byte."""
    return np.random.default_rng(10).integers(0, 1 << 63, 256, np.uint64)


def gram_counts(texts: list[str]) -> Iterator[np.ndarray]:
    """Of each text the hashed counts of 1- to 4-grams of its lowered UTF-8 bytes, of letters and single spaces only."""
    table = _gram_table()
    for text in texts:
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
        raw = np.where(letter, raw, 32).astype(np.uint8)
        raw = raw[letter | np.concatenate([[True], letter[:-1]])]
        one = table[raw]
        total = np.zeros(DIMS, np.int64)
        grams = one
        for n in (1, 2, 3, 4):
            if len(grams) == 0:
                break
            total += np.bincount((grams * np.uint64(0x9E3779B97F4A7C15 + 2 * n) >> np.uint64(52)).astype(np.int64), minlength=DIMS)
            grams = grams[:-1] * np.uint64(6364136223846793005) + one[n:]
        yield total


def scaled(counts: Iterable[np.ndarray], n: int) -> np.ndarray:
    """The n rows of counts, root-scaled to length 1."""
    out = np.zeros((n, DIMS), np.float32)
    for row, total in zip(out, counts, strict=True):
        row[:] = np.sqrt(total)
        size = float(np.sqrt(row @ row))
        if size:
            row /= size
    return out


def vectors(texts: list[str]) -> np.ndarray:
    """The scaled gram counts of texts."""
    return scaled(gram_counts(texts), len(texts))


def pressed(total: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs each, compressed, behind that number of bytes."""
    small = total.astype(np.min_scalar_type(int(total.max())))
    return bytes([small.itemsize]) + pa.compress(small.tobytes(), "zstd", asbytes=True)


def unpressed(raw: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[1:], raw[0] * DIMS, "zstd", asbytes=True), f"u{raw[0]}").astype(np.int64)  # a root of bytes would have two bytes


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss, by dual coordinate descent; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, a, own = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1) + 0.5 / c
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = max(0.0, a[i] - (y[i] * (w @ x[i]) - 1 + a[i] * 0.5 / c) / own[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w.astype(np.float32)


class Model:
    """families: names in order; root: one-versus-rest weights of each family; pairs: weights of each two languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        fam = [_FAMILY.get(v, v) for v in langs]
        self.families = sorted(set(fam))
        self.members = {f: sorted({v for v, g in zip(langs, fam, strict=True) if g == f}) for f in self.families}
        at = np.array(langs)
        many = len(self.families) > 1
        self.root = np.stack([svm(x, np.where(np.array(fam) == f, 1.0, -1.0)) for f in self.families]) if many else None
        self.pairs = {}
        for members in self.members.values():
            for a, b in itertools.combinations(members, 2):
                pick = (at == a) | (at == b)
                self.pairs[a, b] = svm(x[pick], np.where(at[pick] == a, 1.0, -1.0))

    def parts(self) -> Iterator[tuple[str, str, str | None, np.ndarray]]:
        """Each language with nothing, each family with its weights, and each pair of languages with theirs."""
        yield from (("language", v, None, np.zeros(1)) for v in self.langs)
        if self.root is not None:
            yield from (("family", f, None, w) for f, w in zip(self.families, self.root, strict=True))
        yield from (("pair", a, b, w) for (a, b), w in self.pairs.items())

    @classmethod
    def of(cls, parts: list[tuple[str, str, str | None, np.ndarray]]) -> Model:
        """The model whose parts() these are. What was never learned, as two languages were in no chunk together, has weights 0."""
        self, none = cls.__new__(cls), np.zeros(DIMS + 1, np.float32)
        held = {(kind, a, b): w.astype(np.float32) for kind, a, b, w in parts}
        self.langs = sorted(a for kind, a, _ in held if kind == "language")
        self.families = sorted({_FAMILY.get(v, v) for v in self.langs})
        self.members = {f: [v for v in self.langs if _FAMILY.get(v, v) == f] for f in self.families}
        self.root = np.stack([held.get(("family", f, None), none) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {p: held.get(("pair", *p), none) for m in self.members.values() for p in itertools.combinations(m, 2)}
        return self

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row and a score in (0, 1): the least of the logistic values of the margins that decided."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margin = x @ self.root.T if self.root is not None else np.ones((len(x), 1), np.float32)
        first = margin.argmax(1)
        best = margin[np.arange(len(x)), first]
        if margin.shape[1] > 1:
            second = np.partition(margin, -2, axis=1)[:, -2]
            best = (best - second) / 2
        out, score = np.empty(len(x), object), best.astype(np.float64)
        for k, family in enumerate(self.families):
            rows = np.flatnonzero(first == k)
            members = self.members[family]
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(members)))
            least = np.full((len(rows), len(members)), np.inf)
            for (a, b), w in ((p, w) for p, w in self.pairs.items() if p[0] in members and p[1] in members):
                m, i, j = x[rows] @ w, members.index(a), members.index(b)
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
            # Most duels won; of equals, the one that lost by least.
            top = (votes + 0.5 / (1 + np.exp(-np.clip(least, -30, 30)))).argmax(1)
            out[rows] = np.array(members, object)[top]
            duel = least[np.arange(len(rows)), top]
            score[rows] = np.where(np.isfinite(duel), np.minimum(score[rows], duel), score[rows])
        return list(out), 1 / (1 + np.exp(-4 * np.clip(score, -7, 7)))


def has_letter(text: str | None) -> bool:
    """Whether text has a character of Unicode's categories of letters (L); numbers of any kind are none."""
    return bool(text) and (_ascii_letter.search(text) is not None or any(map(str.isalpha, text)))


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id, as text, is divisible by folds; a null id is not held out and not learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def lowest(wanted: int, count: int) -> int:
    """Below which of SPACE hashed ids a share of wanted/count lies."""
    return min(SPACE, -(-wanted * SPACE // max(1, count)))


def in_chunks(docs: DataFrame, size: int, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, Column] | None:
    """(doc_id as text, text, lang) of every labelled document that meets `where`, and the chunks each belongs to (None without any).

    A chunk has about size documents, as languages have them, by a hash of id and text. Of a language with less than size/32
    documents for each chunk, that many go to a chunk (all, if it has no more), so a document of it is in several.
    Only the number of distinct labels grows what reaches the driver.
    """
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    ids = ids.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).where(where).withColumn("doc_id", F.col("doc_id").cast("string"))
    counts = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    chunks = -(-sum(counts.values()) // size)
    parts = {v: max(1, min(chunks, n // max(1, size // 32))) for v, n in counts.items()}
    of = lambda number: F.create_map(*(F.lit(x) for v, n in parts.items() for x in (v, number(n))))[F.col("lang")]
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SPACE))
    first = F.call_function("div", place, of(lambda n: lowest(1, n))) if chunks > 1 else F.lit(0).cast("long")
    return ids.withColumn("first", first), F.explode(F.sequence("first", F.lit(chunks - 1).cast("long"), of(int).cast("long"))).alias("chunk")


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose text has a letter, with its counts in its place."""
    for b in batches:
        b = b.filter(pa.array(list(map(has_letter, b.column("text").to_pylist())), pa.bool_()))
        counts = pa.array(map(pressed, gram_counts(b.column("text").to_pylist())), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), counts, b.column("lang"), b.column("first")], names=["doc_id", "counts", "lang", "first"])


def _fitted(rows: pa.Table) -> pa.Table:
    """The parts of a model of one chunk; the order of rows is that of ids and counts."""
    rows = sorted(zip(rows["doc_id"].to_pylist(), rows["counts"].to_pylist(), rows["lang"].to_pylist(), strict=True))
    model = Model(scaled((unpressed(c) for _, c, _ in rows), len(rows)), [v for _, _, v in rows])
    kind, a, b, w = zip(*model.parts(), strict=True)
    return pa.table({"kind": pa.array(kind), "a": pa.array(a), "b": pa.array(b, pa.string()), "weights": pa.array([np.rint(UNIT * v.astype(np.float64)).astype(np.int64) for v in w], pa.list_(pa.int64()))})


def train(docs: DataFrame, chunk: int = 1600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None) -> Model | None:
    """Learn from every document with a label and a letter (None without any).

    Tasks fit a model to each chunk of about so many documents; a machine's weights are the mean of those it has in the chunks that
    know both of its sides. What a task holds hangs on chunk and the number of labels, not on the length of texts.
    """
    dealt = in_chunks(docs, chunk, ~held_out(F.col("doc_id")) if where is None else where, id_col, text_col, lang_col)
    if dealt is None:
        return None
    rows = dealt[0].mapInArrow(_pressed, "doc_id string, counts binary, lang string, first long").select("doc_id", "counts", "lang", dealt[1])
    fitted = rows.repartition(shuffle_parts(docs.sparkSession), "chunk").groupBy("chunk").applyInArrow(_fitted, "kind string, a string, b string, weights array<long>")
    each = fitted.select("kind", "a", "b", F.posexplode("weights").alias("at", "w")).groupBy("kind", "a", "b", "at").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    parts = staged(each, "weights").groupBy("kind", "a", "b").agg(F.array_sort(F.collect_list(F.struct("at", "w", "n"))).alias("w")).collect()  # a row for each machine
    return Model.of([(r.kind, r.a, r.b, np.array([v.w / v.n for v in r.w]) / UNIT) for r in parts]) if parts else None


def doubtful(texts: list[str], langs: list[str], seed: int = 0) -> list[str]:
    """Texts in no one language, made of whole labelled ones: as much of one language as of another put together, and words of random letters."""
    rng, by = np.random.default_rng(seed), {}
    for t, v in zip(texts, langs, strict=True):
        by.setdefault(v, []).append(t)
    mixed = [x[: len(y)] + " " + y[: len(x)] for a, b in itertools.combinations(sorted(by), 2) for x, y in zip(by[a], by[b], strict=False)]
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    noise = [" ".join("".join(rng.choice(letters, n)) for n in rng.integers(2, 10, rng.integers(6, 100))) for _ in texts]
    return mixed + noise


def tried(model: Model, texts: list[str], langs: list[str], seed: int = 0) -> np.ndarray:
    """Of labelled texts: how many are told rightly, how many told wrongly or doubtful(), then for each of LIMITS how many of the former lie below it and of the latter not."""
    if not texts:
        return np.zeros(2 + 2 * len(LIMITS), np.int64)
    pred, score = model.predict(vectors(texts))
    right = np.array([p == v for p, v in zip(pred, langs, strict=True)])
    bad = np.concatenate([score[~right], model.predict(vectors(doubtful(texts, langs, seed)))[1]])
    lost, passed = (score[right][:, None] < LIMITS).sum(0), (bad[:, None] >= LIMITS).sum(0)
    return np.concatenate([[right.sum(), len(bad)], lost, passed])


def doubt(docs: DataFrame, model: Model, chunk: int = 400) -> float:
    """The score below which a language is doubtful, from every labelled document that is held out, which the model has not learned from.

    It is the middle between the lowest that lets at most PASS of the doubtful() texts and of those told wrongly through
    and the highest below which at most LOST of the texts told rightly lie; the latter alone where it is the lower one. Scores are half a logistic curve: 0.5
    would reject nothing, so the margins tried begin above 0. Without any text told rightly it is the first of them.
    Tasks count a chunk each, and the counts are added.
    """

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = sorted((i, t, v) for i, t, v in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), rows["lang"].to_pylist(), strict=True) if has_letter(t))
        return pa.table({"counts": pa.array([tried(model, [t for _, t, _ in rows], [v for _, _, v in rows], key[0].as_py())], pa.list_(pa.int64()))})

    dealt = in_chunks(docs, chunk, held_out(F.col("doc_id")))
    if dealt is None:
        return float(LIMITS[0])
    rows = dealt[0].select("doc_id", "text", "lang", dealt[1]).repartition(shuffle_parts(docs.sparkSession), "chunk")
    each = rows.groupBy("chunk").applyInArrow(run, "counts array<long>").select(F.posexplode("counts").alias("at", "n"))
    right, bad, *counts = (r.n for r in staged(each.groupBy("at").agg(F.sum("n").alias("n")), "doubt").orderBy("at").collect())
    if not right:
        return float(LIMITS[0])
    lost, passed = np.array(counts[: len(LIMITS)]) / right, np.array(counts[len(LIMITS) :]) / bad
    apart = int(np.argmax(passed <= PASS)) if (passed <= PASS).any() else len(LIMITS) - 1
    clean = max(0, int((lost <= LOST).sum()) - 1)
    return float(LIMITS[min(clean, (apart + clean) // 2)])


def classify(docs: DataFrame, model: Model | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns of docs, and <prefix>lang_pred and <prefix>score.

    Texts that are null or have no letter are `und` with score 0, as are all texts when there was nothing to learn from.
    """
    schema_in, cols = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            preds, scores = ["und"] * len(texts), [0.0] * len(texts)
            good = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
            for at in range(0, len(good), 512):
                part = good[at : at + 512]
                got, sure = model.predict(vectors([texts[i] for i in part]))
                for i, p, s in zip(part, got, sure, strict=True):
                    preds[i], scores[i] = p, float(s)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*cols, prefix + "lang_pred", prefix + "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    return docs.mapInArrow(run, StructType([*schema_in.fields]).add(prefix + "lang_pred", StringType()).add(prefix + "score", DoubleType()))


def _with_letters(text_col: str = "text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(list(map(has_letter, b.column(text_col).to_pylist())), pa.bool_()))

    return run


def identify(docs: DataFrame, chunk: int = 1600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict the language of every document from its text, learned from all labelled documents that are not held out.

    Null ids are not held out; repeated rows get equal results; other columns are ignored; an empty table gives no rows.

    Returns doc_id, held_out, lang_pred, score.
    """
    model = train(docs, chunk, id_col, text_col, lang_col)
    plain = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return classify(plain, model).select("doc_id", "held_out", "lang_pred", "score")


def reject(docs: DataFrame, chunk: int = 1600, least: float | None = None) -> DataFrame:
    """The documents, unchanged, without those that have no letter or whose score is below least.

    The model learns from all labelled documents that are not held out; unless given, least is that of doubt() on all that are. With
    labels of one language only, there are no margins, and without any label there is nothing to judge by: then only
    texts without a letter go. Null texts go; null ids are judged like others; repeated rows fare alike; an empty table
    gives no rows; columns may have any names.
    """
    model = train(docs, chunk)
    if least is None:
        least = doubt(docs, model, max(1, chunk // 4)) if model else 0.5
    cols = docs.columns
    if model is None:
        return docs.mapInArrow(_with_letters(), docs.schema)
    pred, score = unused(docs, "lang_pred", "score")
    return classify(docs, model, prefix=pred.removesuffix("lang_pred")).where((F.col(pred) != "und") & (F.col(score) >= least)).select(*cols)
