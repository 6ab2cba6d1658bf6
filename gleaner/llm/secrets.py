"""Secrets and who owns them (operator 3)."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unused

# The base patterns, the order of their kinds, and the least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "owned"]
LEAST = {"assign": 6, "access": 20, "hex": 24}

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# A run that is too short can't hold another match of these two kinds, so the length can stand in the pattern.
_access = re.compile(r"AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4))
_hex = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
_bare = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_digit = re.compile(r"[0-9]")
_words = re.compile(r"pass|secret|token|api", re.IGNORECASE | re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, value) of the base matches, in order; spans count code points."""
    found = []
    if _words.search(text):
        found += [(m.start(), 0, m.end(), m[2]) for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end(), m[0]) for m in _access.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _hex.finditer(text)]
    return sorted(found)


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def bare_values(text: str, spans: list[tuple[int, int, int, str]], bits: float) -> list[tuple[int, int, str]]:
    """Strings that look like keys and touch no base span: long, with letters and digits, of high entropy."""
    out, starts, reach = [], [s for s, *_ in spans], [0]
    for _, _, e, _ in spans:
        reach.append(max(reach[-1], e))  # furthest end of the spans so far
    for m in _bare.finditer(text):
        value = m[0]
        if _digit.search(value) and not value.isdigit() and reach[bisect_left(starts, m.end())] <= m.start() and entropy(value) >= bits:
            out.append((m.start(), m.end(), value))
    return out


_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("h", pa.string())])
_SPAN_SQL = "array<struct<start:int,rank:int,end:int,h:string>>"


def _text_key(col: str) -> Column:
    """128-bit hash of a text; null is as empty text."""
    return F.md5(F.coalesce(F.col(col), F.lit("")).cast("binary"))


def _scan(bits: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, keys = [], []
            for text, key in zip(b.column("text").to_pylist(), b.column("key").to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                rows = [(s, r, e, xxhash.xxh3_128_hexdigest(v)) for s, r, e, v in base]
                rows += [(s, 3, e, xxhash.xxh3_128_hexdigest(v)) for s, e, v in bare_values(text, base, bits)]
                spans.append([dict(zip(("start", "rank", "end", "h"), x, strict=True)) for x in sorted(rows)])
                keys.append(key if rows else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("owner"), b.column("repo"), pa.array(keys, pa.string()), pa.array(spans, pa.list_(_SPAN))],
                names=["doc_id", "owner", "repo", "key", "spans"],
            )

    return scan


def value_counts(held: DataFrame) -> DataFrame:
    """Of every value h: n_owners, n_repos, and whether one owner holds every text that has it (one_holds).

    held has h, key (of the text), owner and repo. Copies of one text count once as repositories: by the least that holds them.
    """
    held = held.select("h", "key", "owner", "repo").distinct()
    by_owner = held.groupBy("h", "owner").agg(F.count_distinct("key").alias("texts")).groupBy("h").agg(F.count("*").alias("n_owners"), F.max("texts").alias("most"))
    by_text = held.groupBy("h", "key").agg(F.min("repo").alias("repo")).groupBy("h").agg(F.count("*").alias("n_texts"), F.count_distinct("repo").alias("n_repos"))
    return by_owner.join(by_text, "h").select("h", "n_owners", "n_repos", (F.col("most") == F.col("n_texts")).alias("one_holds"))


def secret_spans(
    docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", id_col: str = "doc_id", text_col: str = "text",
    live_owners: int = 1, example_owners: int = 3, bits: float = 3.0, example_repos: int = 10,
) -> DataFrame:
    """Secrets of every document, each judged by how many owners and repositories in the whole corpus hold its value.

    Candidates are the base matches and bare key-like strings. Their values' hashes are counted over the corpus by
    distinct owners (owner_col) and distinct repositories (repo_col; copies of one text are one). A value of
    example_owners or example_repos or more counts as an example that was copied about. Any other counts as live if it has
    at most live_owners owners, or if one owner holds every text with it, so that others have mere copies of its texts.
    Bare strings become spans of kind `owned` if they are live; base spans stay whatever their count.

    Null or empty text has no spans. A null owner or repository is unknown: each text stands for one of its own. Repeated
    rows give repeated results; an empty table gives no rows. Other columns are ignored.

    Returns doc_id, text_key (null without candidates), base and spans (arrays of start, rank, end), n_live, n_example, and
    values (array of start, rank, end, n_owners, n_repos of every candidate).
    """
    key = _text_key(text_col)
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), key)  # noqa: E731  no key begins with =
    seen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), known(owner_col).alias("owner"), known(repo_col).alias("repo"), key.alias("key"))
    id_type = seen.schema["doc_id"].dataType.simpleString()
    seen = staged(seen.mapInArrow(_scan(bits), f"doc_id {id_type}, owner string, repo string, key string, spans {_SPAN_SQL}"), "secrets")
    held = seen.where("key is not null").select("doc_id", "key", "owner", "repo", F.explode("spans").alias("s")).withColumn("h", F.col("s.h"))
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    live = ~example & ((F.col("n_owners") <= live_owners) | F.col("one_holds"))
    span, value = F.struct("s.start", "s.rank", "s.end"), F.struct("s.start", "s.rank", "s.end", "n_owners", "n_repos")
    judged = (
        held.select("doc_id", "key", "h", "s").distinct().join(value_counts(held), "h").withColumn("live", live)
        .groupBy("doc_id", "key")
        .agg(
            F.array_sort(F.collect_list(F.when((F.col("s.rank") < 3) | F.col("live"), span))).alias("kept"),
            F.array_sort(F.collect_list(value)).alias("counted"),
            F.count_if("live").alias("live"),
            F.count_if(example).alias("example"),
        )
    )
    none = lambda more="": F.array().cast(f"array<struct<start:int,rank:int,end:int{more}>>")
    base = F.transform(F.filter("spans", lambda s: s["rank"] < 3), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    alone = seen.select("doc_id", "key", base.alias("base"))
    return alone.join(judged.withColumnsRenamed({"doc_id": "j_id", "key": "j_key"}), F.col("key").eqNullSafe(F.col("j_key")) & F.col("doc_id").eqNullSafe(F.col("j_id")), "left").select(
        "doc_id", F.col("key").alias("text_key"), "base", F.coalesce("kept", none()).alias("spans"),
        F.coalesce("live", F.lit(0)).alias("n_live"), F.coalesce("example", F.lit(0)).alias("n_example"),
        F.coalesce("counted", none(",n_owners:bigint,n_repos:bigint")).alias("values"),
    )


def spans_text(col: str):
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """The digest of secret_spans: counts by kind, checksum of the base spans, all spans as text, and start:owners:repositories of every candidate.

    Null and empty texts have zeros, the checksum of nothing and no spans; a row for every row, so repeated rows come as often as they occur; spans that begin together
    are ordered by kind; an empty table gives no rows.
    """
    s = secret_spans(docs, **options)
    count = lambda k: F.size(F.filter("base", lambda x: x["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = F.array_join(F.transform("values", lambda v: F.concat_ws(":", *(v[k].cast("string") for k in ("start", "n_owners", "n_repos")))), ",")
    return s.select("doc_id", count(0), count(1), count(2), F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"), "n_live", "n_example", counts.alias("counts"))


def redact(docs: DataFrame, owner_col: str = "source", mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with every span replaced by `mark`; columns stay as they are, n_chars (if there) is counted anew.

    Overlapping spans are replaced as one. Documents without spans, null and empty texts are unchanged. Spans are matched to
    documents by id, null or not, and text, so repeated rows fare alike; an empty table gives no rows; columns may have any names.
    """
    spans = secret_spans(docs, owner_col=owner_col, id_col=id_col, text_col=text_col, **options).where("size(spans) > 0")
    id_, key, spans_col = unused(docs, "hit_id", "hit_key", "hit_spans")
    hit = spans.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("spans").alias(spans_col)).distinct()
    joined = docs.join(hit, F.col(id_col).eqNullSafe(F.col(id_)) & (_text_key(text_col) == F.col(key)), "left")
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found in zip(b.column(text_col).to_pylist(), b.column(spans_col).to_pylist(), strict=True):
                if found:
                    parts, at = [], 0
                    for s in found:
                        if s["start"] >= at:
                            parts += [text[at : s["start"]], mark]
                        at = max(at, s["end"])
                    text = "".join(parts) + text[at:]
                out.append(text)
            counts = [None if x is None else len(x) for x in out]
            arrays = [pa.array(out, pa.string()) if c == text_col else pa.array(counts, b.column(c).type) if c == "n_chars" else b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return joined.mapInArrow(cut, docs.schema)
