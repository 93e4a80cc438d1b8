"""Helpers of the text operators: words, word hashes, shingles, tables and sized broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks: what separates words in every operator here (bytes.split() uses the same set).
BLANKS = "[\\x20\\x09-\\x0D]"

#: Largest number of rows of a side that is broadcast (16 bytes a row: 16 MB); beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


#: Rows of an Arrow batch while texts are read: with Spark's own 10,000 a batch of long texts fills a worker.
BATCH_KEY, SPARKS_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts.  Arrow batches become smaller, unless the session has a size of its own."""
    if spark.conf.get(BATCH_KEY, SPARKS_ROWS) == SPARKS_ROWS:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def small_side(side: DataFrame) -> DataFrame:
    """``side`` (a written table) marked for broadcast if its row count allows it."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text of an Arrow column; null gives b''."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads sums of products over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, always the same ones."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)


class WordHasher:
    """64-bit hashes of the words of texts, computed over all bytes of a block of texts at once.

    A word's hash is a polynomial in its bytes, taken from differences of prefix sums over the block.
    """

    block = 1 << 18  # bytes of texts that are hashed together (at least one text)

    def __init__(self, lower: bool = False):
        """lower: A-Z count as a-z."""
        self.base = odd_constants(1, 41)[0]
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.blank = np.zeros(256, bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True
        self.values[self.blank] = 0
        if lower:
            self.values[65:91] = self.values[97:123]
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, self.block)
            self.up, self.down = (np.full(n, x, np.uint64) for x in (self.base, self.inverse))
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)

    def blocks(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hashes, ends) of some texts after each other: words ends[i] to ends[i + 1] are a text's.  Null is empty."""
        texts = texts.cast(pa.large_binary())
        texts = texts.fill_null(b"") if texts.null_count else texts
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + self.block, "right")) - 1)
            yield self.hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            low = high

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        self._powers(n)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        blank = self.blank[data]
        begins, ends = ~blank, ~blank
        begins[1:] &= blank[:-1] | edge[1:n]
        ends[:-1] &= blank[1:] | edge[1:n]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
        sums = self.values[data]
        sums *= self.up[:n]
        np.cumsum(sums, out=sums)
        before = sums[begins] - self.values[data[begins]] * self.up[begins]
        return mixed((sums[ends] - before) * self.down[begins]), np.searchsorted(begins, offsets)

    def of(self, text: bytes) -> np.ndarray:
        return self.hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]


def each_shingles(hashes: np.ndarray, ends: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The shingles of each text of a block."""
    whole = shingles(hashes, width) if len(hashes) >= width else hashes[:0]
    for low, high in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield whole[low : high - width + 1] if high - low >= width else shingles(hashes[low:high], width)


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    if len(x) < 2:
        return x
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; a shorter text is one shingle, an empty one has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < width:
        return mixed((hashes * odd_constants(n, n)).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    factors = odd_constants(width, 977)
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total += hashes[j : n - width + 1 + j] * factors[j]
    return mixed(total)
