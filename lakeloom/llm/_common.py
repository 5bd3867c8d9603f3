"""What the operators share: table access, cut points, bounded broadcasts and vectorised words."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.cuts import cut as cut
from lakeloom.sources.cuts import drop_cut as drop_cut
from lakeloom.sources.cuts import shared_dir as shared_dir

#: Text handled at once by one Python worker, in bytes; one longer text is taken whole.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Hold the batches that go to Python to so many bytes while jobs run inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_enough(rows: int, bytes_per_row: int, limit_mb: int = 32) -> bool:
    """Whether a side with so many rows of at most that width may be broadcast."""
    return rows * bytes_per_row <= limit_mb << 20


def maybe_broadcast(df: DataFrame, rows: int, bytes_per_row: int, limit_mb: int = 32) -> DataFrame:
    """Hint a broadcast when the measured size allows it; otherwise the join shuffles."""
    return F.broadcast(df) if small_enough(rows, bytes_per_row, limit_mb) else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Vectorised words ---------------------------------------------------------------------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts, A-Z lower-cased, as flat arrays.

    raw: bytes of all texts, each ended by a space; start, end: of each word in raw; hash: 64 bits of each word;
    first: index of each text's first word, and one entry more for the end.
    """

    def __init__(self, texts: list[bytes], lower: bool = True) -> None:
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.raw = _LOWER[raw] if lower else raw
        gap = _SPACE[raw]
        before = np.empty(len(gap), bool)
        before[0], before[1:] = True, gap[:-1]
        self.start = np.flatnonzero(before & ~gap)
        after = np.empty(len(gap), bool)
        after[-1], after[:-1] = True, gap[1:]
        self.end = np.flatnonzero(after & ~gap) + 1
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.first = np.searchsorted(self.start, np.concatenate(([0], np.cumsum(sizes))))
        if not len(self.start):
            self.hash = np.empty(0, np.uint64)
            return
        length = self.end - self.start
        power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(int(length.max()), _BASE | np.uint64(1), np.uint64))))
        letters = self.raw[~gap]
        at = np.concatenate(([0], np.cumsum(length)[:-1]))
        place = np.arange(len(letters)) - np.repeat(at, length)
        self.hash = mix(np.add.reduceat(_BYTE[letters] * power[place], at) + length.astype(np.uint64))


def chunks(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Bounded runs of texts as UTF-8 (null: empty), each with the index of its first."""
    at, run, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else (t or b"")
        if run and size + len(b) > limit:
            yield at, run
            at, run, size = i, [], 0
        run.append(b)
        size += len(b)
    if run:
        yield at, run
