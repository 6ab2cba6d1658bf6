"""What the corpus operators share: staging in the cluster's shared folder, hashing, ordering."""

from __future__ import annotations

import functools
import operator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..sources.staging import shared_dir, staged  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, all with as many underscores before them as it takes for df to have no such column (in either case of letters)."""
    held, before = {c.lower() for c in df.columns}, ""
    while any((before + n).lower() in held for n in names):
        before += "_"
    return [before + n for n in names]


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bucket(df: DataFrame, col: str, buckets: int) -> Column:
    """Number of a range of col, ascending; the cuts are approximate quantiles, so at most `buckets` numbers reach the driver.

    Nulls, and what is no number, are in range 0. The expression depends on the value alone, so a retried task puts a row where it was.
    """
    steps = [i / buckets for i in range(1, buckets)]
    numeric = isinstance(df.schema[col].dataType, NumericType)
    cuts = sorted(set(df.approxQuantile(col, steps, 0.25 / buckets))) if steps and numeric else []
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(col).cast("double"))), F.lit(0))


def with_partner(rows: DataFrame, keys: list[str], partner: Column) -> DataFrame:
    """The rows for which another row of equal keys meets the condition.

    Merge joined, since either side may be large. The last condition is always true; naming every column in it, and
    asking for no nulls (there are none), keeps both sides alike, so that they share one shuffle.
    """
    rows = rows.where(functools.reduce(operator.and_, (F.col(c).isNotNull() for c in rows.columns)))
    rest = [c for c in rows.columns if c not in keys]
    same = [F.col(f"mine.{k}") == F.col(f"other.{k}") for k in keys]
    unlike = functools.reduce(operator.or_, (F.col(f"mine.{c}") != F.col(f"other.{c}") for c in rest))
    on = functools.reduce(operator.and_, [*same, partner, unlike])
    return rows.alias("mine").join(rows.alias("other").hint("merge"), on, "left_semi")


def kept_in_worker(key: tuple, make):
    """What make() gives, made once in a Python worker and kept for its later tasks; only the last one asked for is kept."""
    import sys
    import types

    module = sys.modules.setdefault("gleaner_kept", types.ModuleType("gleaner_kept"))
    held = module.__dict__.setdefault("held", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets all when it holds `most` words, so memory stays bounded."""

    def __init__(self, seed: int = 0, most: int = 1 << 19):
        import xxhash

        super().__init__()
        self.digest, self.seed, self.most = xxhash.xxh3_64_intdigest, seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = self.digest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Stir the bits of 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Polynomial hashes, modulo 2^64, of all windows of a sequence of 64-bit numbers."""

    def __init__(self, factor: int):
        self.factor = factor | 1
        self.inverse = pow(self.factor, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.factor), ("down", self.inverse)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def of(self, values: np.ndarray, length: int) -> np.ndarray:
        n = len(values) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        self._grow(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return mix64((sums[length:] - sums[:n]) * self.down[:n])


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of the given length that begins at one of starts."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + length, n), -1)
    return np.cumsum(edges[:n]) > 0
